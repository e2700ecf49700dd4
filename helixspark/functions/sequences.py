"""Token sequences: rank bins, padding, masks, pooling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixspark.functions.text import shuffle_key


def rank_bin(rank: Column, length: Column, n_bins: int) -> Column:
    """n_bins for rank 1, down with the rank in equal steps of the length."""
    return (F.lit(n_bins) - F.floor(((rank - 1) * n_bins) / length)).cast("long")


def padded(values: Column, k: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(0).cast("int"), F.greatest(F.lit(0), F.lit(k) - F.size(values))))


def mask_positions(tokens: Column, id_: Column, ratio: float = 0.15, seed: int = 42, pad: int = 0, cls_index: int | None = 0) -> Column:
    """True at positions drawn with probability ``ratio``, never at padding nor at the class token; repeatable by id, position and seed."""
    chosen = lambda i: shuffle_key(id_, seed, 4099, i) < int(ratio * 2147483647)
    free = lambda x, i: (x != pad) & (F.lit(True) if cls_index is None else i != cls_index)
    return F.transform(tokens, lambda x, i: free(x, i) & chosen(i))


def masked(tokens: Column, mask: Column, mask_id: int) -> Column:
    return F.zip_with(tokens, mask, lambda x, m: F.when(m, F.lit(mask_id)).otherwise(x))


def attention_mask(tokens: Column, pad: int = 0, low: float = -10000.0) -> Column:
    return F.transform(tokens, lambda x: F.when(x == pad, F.lit(low)).otherwise(F.lit(0.0)))


def pool(vectors: Column, how: str = "mean", scores: Column | None = None) -> Column:
    """One vector for an array of token vectors: the first ("cls"), the mean, or by "attention" the mean weighted by the softmax of the tokens' scores."""
    if how == "cls":
        return F.get(vectors, F.lit(0))
    if how == "attention":
        raised = F.transform(scores, lambda s: F.exp(s.cast("double") - F.array_max(scores)))
        total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
        weighted = F.zip_with(vectors, raised, lambda v, w: F.transform(v, lambda x: x.cast("double") * w / total))
        return F.aggregate(weighted, F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double") * 0), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    n = F.size(vectors)
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double") * 0)
    total = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)
