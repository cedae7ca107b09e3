"""What several operators of this package share: columns, words, worker state."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The package's only notion of white space: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD_JAVA = r"[^\x20\x09-\x0D]+"
BLANK_RUN_JAVA = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# Stands for a NULL id where ids are ordered: a document without one comes last.
LAST_ID = 2**63 - 1
# Parameters that go to every executor (models, vocabularies) may not be larger.
BROADCAST_LIMIT = 256 << 20


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def whole(text: Column) -> Column:
    """NULL counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def text_digest(text: Column) -> Column:
    """Tells rows of one id apart by their whole text; NULL as empty."""
    return F.unhex(F.sha2(whole(text), 256))


def ship(spark: SparkSession, value: object, size: int) -> Broadcast:
    """Broadcast ``value`` after checking its ``size`` in bytes against the fixed bound."""
    if size > BROADCAST_LIMIT:
        raise ValueError(f"{size} bytes are too many to send to every executor (limit {BROADCAST_LIMIT})")
    return spark.sparkContext.broadcast(value)


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that caches outlast a task."""
    home = sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state"))
    return home.__dict__.setdefault(name, {})


def make_once(name: str, build: Callable[[], object]) -> object:
    """``build()``, once for the life of a Python worker."""
    kept = worker_state("models")
    if name not in kept:
        kept[name] = build()
    return kept[name]


def forget_models(but: str | None = None) -> None:
    """Drop what earlier tasks kept in this worker, except the models whose names begin with ``but``."""
    kept = worker_state("models")
    for name in [n for n in kept if but is None or not n.startswith(but)]:
        del kept[name]


def give_back() -> None:
    """Return what a task has freed to the machine: an idle worker then holds its models and little else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other libraries do without
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str, keeps: str | None = None,
) -> DataFrame:
    """``mapInArrow`` that skips empty batches, so that ``work`` sees rows only.

    Workers live on after a task; only models that ``keeps`` names outlast it, so
    that the stages of a pipeline don't pile up their memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_models(keeps)
        try:
            yield from work(b for b in batches if b.num_rows)
        finally:
            give_back()

    return df.mapInArrow(run, ddl)


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` as one struct beside ``columns``, so that no name can clash."""
    return docs.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in columns.items()])


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that ``carried`` packed, with their own ``columns``."""
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in columns])
