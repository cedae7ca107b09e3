"""Token counts of documents, from counts at every prefix.

Method: prefix dynamic programming (``bpe.PrefixCounter``).  The exact count of
every prefix answers how long a text is, where to cut it for a budget, and what
any cut costs, without encoding anything again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.bpe import PrefixCounter
from webgrain.llm.common import make_once, map_batches, ship, whole

LIMIT = 1024


def vocabulary(path: str) -> str:
    """The text of a tokenizer file, read where the job is defined."""
    return Path(path).read_text(encoding="utf-8")


def _counter(spec: str) -> PrefixCounter:
    name = f"prefix-{hashlib.sha256(spec.encode()).hexdigest()}"
    return make_once(name, lambda: PrefixCounter(spec))


def token_counts(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs``.

    NULL text is empty and has no tokens.  NULL and repeated ids are passed on;
    extra columns are ignored; an empty table gives an empty result.  Special
    strings inside a text count as the one token that the library makes of them.
    """
    spec = vocabulary(tokenizer)
    shared = ship(docs.sparkSession, spec, len(spec))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counter.counts(batch.column(2).to_pylist()), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    text = whole(F.col(text_col))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    out = map_batches(given, work, "doc_id long, n_bytes long, n_tokens long", keeps="prefix-")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts: tokens of every prefix, from the empty one to the whole text.

    One integer for each character: store it for texts whose cuts are asked about often.
    """
    spec = vocabulary(tokenizer)
    shared = ship(docs.sparkSession, spec, len(spec))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([counter.prefix_counts(text)], pa.list_(pa.int32()))], ["doc_id", "counts"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("t"))
    return map_batches(given, work, "doc_id long, counts array<int>", keeps="prefix-")


def cut_points(counts: DataFrame, budget: int) -> DataFrame:
    """From stored prefix counts: doc_id, n_chars: the longest prefix of at most ``budget`` tokens."""
    fits = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i)))
    return counts.select("doc_id", fits.cast("long").alias("n_chars"))
