"""Byte-pair encoding of whole texts by way of distinct pre-tokens.

Texts are split into pre-tokens with array operations, equal pre-tokens are found by hash, and only distinct ones that
this worker has not met before are encoded. The cache is bounded and only saves time.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata

import numpy as np

from helixspark.llm import textkit

#: Distinct pre-tokens that a worker remembers; beyond it the cache starts anew.
CACHE = 1_500_000


class Known:
    """Hashes of pre-tokens already met, sorted, with an int64 value for each; starts anew beyond ``CACHE`` entries."""

    def __init__(self):
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ``hashes`` (sorted, distinct) that aren't known."""
        at = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return np.arange(len(hashes))
        return np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes)

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.values = np.insert(self.hashes, at, hashes), np.insert(self.values, at, values)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.hashes, hashes)]


def _slices(texts: list[str], starts: np.ndarray, ends: np.ndarray) -> list[str]:
    joined = "".join(texts)
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class ByteEncoder:
    """Token ids of whole texts by the byte-level vocabulary file at ``path`` (the ``tokenizers`` library's ids).

    Where ids are in the order of the merges, a distinct pre-token is encoded by the ranks alone; else by the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, byte = spec["model"]["vocab"], {c: b for b, c in enumerate(_byte_letters())}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        plain = {t: i for t, i in vocab.items() if t not in self.special}
        self.ranks = None
        if made == sorted(made) and all(len(t) == 1 or i >= 256 for t, i in plain.items()):
            ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
            self.ranks = tiktoken.Encoding("file", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.known = Known()
        self.flat, self.starts, self.counts = np.zeros(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if self.ranks:
            ids = [self.ranks.encode_ordinary(p) for p in pieces]
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.known.add(hashes, np.arange(len(self.counts), len(self.counts) + len(ids)))
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and offsets. Texts that hold a special token's string go to the library itself."""
        odd = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if odd:
            texts = ["" if i in odd else t for i, t in enumerate(texts)]
        ids, counts = [], []
        for a, b in textkit.chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
            x, n = self._chunk(texts[a:b])
            ids.append(x)
            counts.append(n)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        per = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if odd:
            offsets = np.concatenate(([0], np.cumsum(per)))
            parts = [np.array(odd[i], np.uint32) if i in odd else flat[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            per = np.fromiter(map(len, parts), np.int64, len(parts))
            flat = np.concatenate(parts)
        return flat, np.concatenate(([0], np.cumsum(per)))

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, offsets = textkit.code_points(texts)
        starts, ends = textkit.pre_tokens(cp, offsets, keep_space=True)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        known, first, inverse = np.unique(textkit.range_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        if len(self.known.hashes) > CACHE:
            self._clear()
        new = self.known.missing(known)
        if len(new):
            self._learn(known[new], _slices(texts, starts[first[new]], ends[first[new]]))
        slot = self.known[known][inverse]
        counts = self.counts[slot]
        ids = self.flat[textkit.ragged(self.starts[slot], counts)]
        sums = np.concatenate(([0], np.cumsum(counts)))
        at = np.searchsorted(starts, offsets)
        return ids, np.diff(sums[at])


class WordCounter:
    """Token counts of whole texts by rank-synchronous merging over the word-end vocabulary file at ``path``."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splits = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        letter = _byte_letters()
        self.inner = np.array([vocab[c] for c in letter], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letter], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.known = Known()

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols of each non-empty piece survive: in every round each sequence applies its lowest-ranked pair at all its places at once."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[raw]
        symbols[np.cumsum(lengths) - 1] = self.final[raw[np.cumsum(lengths) - 1]]
        out, owner, none = lengths.copy(), np.arange(len(pieces)), np.int64(1 << 40)
        while len(owner):
            keep = lengths > 1
            symbols, owner, lengths = symbols[np.repeat(keep, lengths)], owner[keep], lengths[keep]
            if not len(owner):
                break
            stops = np.cumsum(lengths)
            starts = stops - lengths
            key = symbols * self.width
            key[:-1] += symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.rank[at], none)
            rank[stops - 1] = none
            least = np.minimum.reduceat(rank, starts)
            live = least < none
            chosen = (rank == np.repeat(least, lengths)) & (rank < none)
            i = np.flatnonzero(chosen)  # a pair of equal symbols can overlap itself: every other place of such a run
            if len(i):
                fresh = np.concatenate(([True], np.diff(i) != 1))
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - run) % 2 == 0]
            symbols[i] = self.made[at[i]]
            stay = np.ones(len(symbols), bool)
            stay[i + 1] = False
            gone = np.zeros(len(symbols), np.int64)
            gone[i + 1] = 1
            lengths = lengths - np.add.reduceat(gone, starts)
            symbols = symbols[stay]
            out[owner] = lengths
            symbols, owner, lengths = symbols[np.repeat(live, lengths)], owner[live], lengths[live]
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each whole text."""
        total = np.zeros(len(texts), np.int64)
        parts, of = [], []
        for i, t in enumerate(texts):
            if self.splits and "<|" in t and (found := self.splits.findall(t)):
                total[i] += len(found)
                pieces = self.splits.split(t)
            else:
                pieces = [t]
            parts += pieces
            of += [i] * len(pieces)
        parts = [self._normal(p) for p in parts]
        of = np.array(of, np.int64)
        for a, b in textkit.chunks(np.fromiter(map(len, parts), np.int64, len(parts))):
            np.add.at(total, of[a:b], self._chunk(parts[a:b]))
        return total

    @staticmethod
    def _normal(text: str) -> str:
        """Canonical composition and lower case, each character by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _chunk(self, texts: list[str]) -> np.ndarray:
        cp, offsets = textkit.code_points(texts)
        starts, ends = textkit.pre_tokens(cp, offsets, keep_space=False)
        if not len(starts):
            return np.zeros(len(texts), np.int64)
        known, first, inverse = np.unique(textkit.range_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        if len(self.known.hashes) > CACHE:
            self.known = Known()
        new = self.known.missing(known)
        if len(new):
            pieces = _slices(texts, starts[first[new]], ends[first[new]])
            self.known.add(known[new], self.merged([p.encode("utf-8", "surrogatepass") for p in pieces]))
        counts = self.known[known][inverse]
        sums = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(sums[np.searchsorted(starts, offsets)])


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


@functools.cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@functools.cache
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)
