"""Tables: captures in, results, archives, memory, alerts and logs out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webgrain.operators.ordered import latest
from webgrain.operators.repeats import split_repeats
from webgrain.schemas import CAPTURE

# --- fixed values -----------------------------------------------------------
ALERT_DEFAULTS = {"url": "", "platform": "unknown", "alert_type": "", "severity": "info"}
PAGE_LIMIT = 100
# --- end of fixed values ----------------------------------------------------


# --- A1 -------------------------------------------------------------------------
def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: captured pages with the fixed schema (no inference pass)."""
    return spark.read.schema(CAPTURE).format(fmt).load(path)


def stream_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: the same as a stream of files."""
    return spark.readStream.schema(CAPTURE).format(fmt).load(path)


def as_captures(df: DataFrame, **columns: Column) -> DataFrame:
    """A1: fit any page table to the capture schema.

    Columns not given come from ``df`` by name, else from the defaults: status
    200, strategy 'http', everything else NULL.
    """
    defaults = {"status_code": F.lit(200), "strategy": F.lit("http")}
    out = []
    for part in _capture_fields():
        name, kind = part
        if name in columns:
            value = columns[name]
        elif name in df.columns:
            value = F.col(name)
        else:
            value = defaults.get(name, F.lit(None))
        out.append(value.cast(kind).alias(name))
    rest = [c for c in df.columns if c not in {n for n, _ in _capture_fields()}]
    return df.select(*rest, *out)


def _capture_fields() -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(CAPTURE).fields]


# --- A2-A4 results ------------------------------------------------------------------
def result_rows(results: DataFrame) -> DataFrame:
    """A2: storage form of results.

    ``results``: id, url, success, output (unified struct or NULL), created_at,
    ai_assisted.  The platform is 'unknown' without output, flags become 0/1.
    """
    out = F.col("output")
    return results.select(
        "id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(out.platform, F.lit("unknown")).alias("platform"),
        out.content_type.alias("content_type"),
        F.col("success").cast("int").alias("success"),
        F.when(out.isNotNull(), F.to_json(out)).alias("output_json"),
        "created_at",
        out.scraping_strategy.alias("scraping_strategy"),
        F.coalesce(F.col("ai_assisted"), F.lit(False)).cast("int").alias("ai_assisted"),
    )


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A2/A10: append rows to a Parquet table."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def result_by_id(stored: DataFrame, result_id: Column | str) -> DataFrame:
    """A3: one result; rows without output do not count.  The filter reaches the scan."""
    return stored.filter((F.col("id") == result_id) & F.col("output_json").isNotNull())


def list_results(stored: DataFrame, *, platform: str | None = None, limit: int = PAGE_LIMIT,
                 offset: int = 0) -> DataFrame:
    """A4: one page of results, newest first, ties by id.

    Rows without output are dropped after paging, so a page can be short.
    """
    rows = stored if platform is None else stored.filter(F.col("platform") == platform)
    page = rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)
    return page.filter(F.col("output_json").isNotNull())


# --- A5, A6 archive ------------------------------------------------------------------
def archive_id(url: Column, html: Column) -> Column:
    """A5: short name of a page version, from its URL and content alone; for display, never a key.

    NULL parts count as empty here; ``archive_key`` tells them apart.
    """
    return F.left(F.sha2(F.concat(F.coalesce(url, F.lit("")), F.lit(":"), F.coalesce(html, F.lit(""))), 256), F.lit(16))


def archive_key(url: Column, html: Column) -> Column:
    """A5: key of a page version: the full digest of its parts, each marked with its length or as NULL."""
    marked = lambda c: F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(marked(url), F.lit("|"), marked(html)), 256)


def archive_rows(captures: DataFrame, metadata: dict[str, Column] | None = None) -> DataFrame:
    """A5: archive table; the given metadata wins over url, archive_id, created_at.

    ``captures``: url, html, timestamp.  Equal versions, by their full key,
    collapse to the earliest one.  Hashes alone are counted first; a page body moves
    only if its hash repeats, and digests are computed once for a row.
    """
    once, again = split_repeats(captures, F.xxhash64("url", "html"))
    columns = ["archive_id", "url", "html", "metadata"]

    def rows(of: DataFrame) -> DataFrame:
        named = of.withColumn("archive_key", archive_key(F.col("url"), F.col("html"))).withColumn(
            "archive_id", archive_id(F.col("url"), F.col("html")))
        base = {
            "url": F.col("url"), "archive_id": F.col("archive_id"),
            "created_at": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        }
        fields = {**base, **(metadata or {})}
        return named.select(
            "archive_key", *columns[:-1], "timestamp", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("metadata"))

    out = rows(once).select("archive_key", *columns)
    if again is None:
        return out
    first = rows(again).groupBy("archive_key").agg(
        F.min_by(F.struct(*columns), F.struct("timestamp", "metadata")).alias("v")
    ).select("archive_key", "v.*")
    return out.unionByName(first)


def with_archive(results: DataFrame, archives: DataFrame) -> DataFrame:
    """Results, by their ``archive_key``, with their archived page."""
    own = [c for c in archives.columns if c not in results.columns or c == "archive_key"]
    return results.join(archives.select(*own), "archive_key", "left")


# --- A7-A9 keyed state --------------------------------------------------------------------
def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after applying ``changes``; the latest row per key stays."""
    return latest(current.unionByName(changes), keys, order)


def current_baselines(history: DataFrame) -> DataFrame:
    """Latest baseline per URL; its id is that of the URL's first row."""
    rest = [c for c in history.columns if c not in ("url", "id")]
    return history.groupBy("url").agg(
        F.min_by("id", F.struct("updated_at", "id")).alias("baseline_id"),
        F.max_by(F.struct(*rest), F.struct("updated_at", "id")).alias("row"),
    ).select("url", "baseline_id", "row.*")


# --- A10-A13 ------------------------------------------------------------------------------
def alert_rows(alerts: DataFrame) -> DataFrame:
    """A10: alerts with defaults for missing values."""
    return alerts.select(
        *[
            F.coalesce(F.col(c), F.lit(ALERT_DEFAULTS[c])).alias(c) if c in ALERT_DEFAULTS else F.col(c)
            for c in alerts.columns
        ]
    )


def audit_lines(df: DataFrame, event_type: str, ts: str = "ts") -> DataFrame:
    """One JSON line per row, type and time first."""
    rest = [c for c in df.columns if c != ts]
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return df.select(
        F.to_json(
            F.struct(F.lit(event_type).alias("event_type"), stamp.alias("timestamp"), *rest)
        ).alias("value")
    )


def export_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines, one file per partition."""
    df.write.mode("overwrite").json(path)


def read_memory_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Domain memory kept as JSON; an unreadable line keeps its text in ``rejected``, all else NULL."""
    return spark.read.schema(f"{schema}, rejected string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "rejected"
    ).json(path)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Any JDBC database through Spark's own writer (needs a driver jar)."""
    df.write.mode("append").options(**options).jdbc(url, table)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Read back; pass partitionColumn, lowerBound, upperBound, numPartitions to split."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
