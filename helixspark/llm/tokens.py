"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from helixspark.llm import bpe


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text by rank-synchronous merging over a word-end vocabulary.

    One scan, no shuffle; memory is bounded by a chunk of code points and a bounded cache of pre-tokens. Returns one row
    per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). A null text counts as empty (0
    bytes, 0 tokens); a null id stays null; repeated rows stay; an empty table gives an empty table; other columns are
    not read. ``vocabulary`` is a path that every executor can open, as installed packages are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.word_counter(vocabulary)
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            n = pa.array(counter.count(text.to_pylist()), pa.int64())
            size = pc.binary_length(text.cast(pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
