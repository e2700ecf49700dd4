"""Vectorised text primitives on numpy arrays, shared by the operators that need Python."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that are handled at once; longer texts are handled alone. Bounds a worker's memory.
CHUNK = 1_000_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(sizes: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to ``most`` at most; a larger item comes alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points end to end, and the offsets of the texts in them."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate(([0], np.cumsum(lengths)))


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    table = np.zeros(0x110000, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = value
    return table


def _contractions(cp: np.ndarray, cls: np.ndarray, at: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of token starts ``at`` that hold an apostrophe, those that begin a contraction, and the length after the apostrophe."""
    n = len(cp)
    a = cp[np.minimum(at + 1, n - 1)]
    b = cp[np.minimum(at + 2, n - 1)]
    in1 = (at + 1 < n) & ~begins[np.minimum(at + 1, n - 1)]
    in2 = in1 & (at + 2 < n) & ~begins[np.minimum(at + 2, n - 1)]
    one = in1 & np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
    two = in2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
    length = np.where(one, 1, np.where(two, 2, 0))
    keep = length > 0
    return at[keep], length[keep]


def pre_tokens(cp: np.ndarray, offsets: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens.

    ``keep_space``: the byte-level pattern, where one space goes with what follows and other white space stays;
    otherwise white space goes and each number character stands alone.
    """
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = class_table()[cp]
    begins = np.zeros(n, bool)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    run = begins.copy()
    run[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    if keep_space:
        start = run.copy()
        after_space = np.zeros(n, bool)
        after_space[1:] = (cp[:-1] == 32) & ~begins[1:]
        start &= space | ~after_space
        last = space.copy()  # the last of a white-space run, with something after it in the same text
        last[:-1] &= ~space[1:] & ~begins[1:]
        last[-1] = False
        start |= last
    else:
        start = (run | (cls == NUMBER)) & ~space
    quote = np.flatnonzero(start & (cp == 0x27))
    if len(quote):
        at, length = _contractions(cp, cls, quote, begins)
        start[at + 1] = False
        over = at + 1 + length
        ok = over < n
        over = over[ok]
        over = over[(cls[over] == LETTER) & ~begins[over]]
        start[over] = True
    starts = np.flatnonzero(start)
    ends = np.concatenate((starts[1:], [n]))
    if not keep_space and len(starts):
        first_space = run & space
        stops = np.append(np.flatnonzero(first_space), n)
        ends = np.minimum(ends, stops[np.searchsorted(stops, starts)])
    return starts, ends


@functools.cache
def _mixed() -> np.ndarray:
    """An odd 64-bit word for each code point."""
    return mix64(np.arange(0x110000)) | np.uint64(1)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate((one, np.full(n, _MULT)))), np.cumprod(np.concatenate((one, np.full(n, inverse))))


def range_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of code points: a polynomial over prefix sums, mixed with the length."""
    size = CHUNK + 1
    while size < len(cp) + 1:
        size *= 2
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_mixed()[cp] * power[: len(cp)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mix64(h ^ mix64((ends - starts).astype(np.uint64)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and flat values of a list column without null lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets - offsets[0], values


@functools.cache
def _bytes_table() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are ASCII white space, and an odd 64-bit word for each byte, A-Z as a-z."""
    code = np.arange(256)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    lower = np.where((code >= 65) & (code <= 90), code + 32, code)
    return space, mix64(lower + 0x9D2C) | np.uint64(1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word between ASCII white space, A-Z in lower case, and the texts' offsets in them.

    Words are found in the texts' UTF-8 bytes and hashed by prefix sums, as in ``range_hashes``, in parts of about CHUNK
    bytes; a longer word comes alone.
    """
    text = pc.fill_null(texts, "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string())
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    space, mixed = _bytes_table()
    full = np.concatenate((~space[data], [False]))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], full[:-1]))
    starts = np.flatnonzero(full & (~before | edge))
    ends = np.flatnonzero(before & (~full | edge))
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        z = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        part = data[starts[i] : ends[z - 1]]
        s, e = starts[i:z] - starts[i], ends[i:z] - starts[i]
        size = CHUNK + 1
        while size < len(part) + 1:
            size *= 2
        power, inverse = _powers(size)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(mixed[part] * power[: len(part)], out=sums[1:])
            out[i:z] = mix64((sums[e] - sums[s]) * inverse[s] ^ mix64((e - s).astype(np.uint64)))
        i = z
    return out, np.searchsorted(starts, at)


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each text as sorted 64-bit hashes, flat, with offsets.

    Lower-cases A-Z, takes words between ASCII white space; a text of fewer words is one shingle; none without words.
    """
    h, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(made)))
    flat = np.zeros(at[-1], np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            rolled = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                rolled = mix64(rolled * _MULT + h[j : len(h) - k + 1 + j] + np.uint64(1))
            long = counts >= k
            flat[ragged(at[:-1][long], made[long])] = rolled[ragged(offsets[:-1][long], made[long])]
        for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
            x = np.full(1, counts[i], np.uint64)
            for w in h[offsets[i] : offsets[i + 1]]:
                x = mix64(x * _MULT + w + np.uint64(1))
            flat[at[i]] = x[0]
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        flat[a:z].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[at[:-1][made > 0]] = True
    return flat[keep], np.concatenate(([0], np.cumsum(keep)))[at]
