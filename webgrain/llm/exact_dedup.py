"""Exact duplicates by skew-safe combining.

Method: deduplicate locally (map-side combine inside each task), merge salted
digest groups, combine the salt winners globally.  The full normalised text is a
grouping key beside its digest at every stage, so texts that merely share a
digest never merge.

Only digests whose narrow count passes ``hot`` are salted; for all others the
salted merge is already final.  After the local stage a hot digest has at most
one row per task, and after the salted stage at most ``salts`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import BLANK_RUN_JAVA, LAST_ID, whole
from webgrain.session import materialized

SALTS = 32
HOT = 1000


def normalised(text: Column) -> Column:
    """Each run of blanks as one space."""
    return F.regexp_replace(whole(text), BLANK_RUN_JAVA, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def duplicate_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, hot: int = HOT,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays.  NULL text counts as empty and equals
    other empty texts.  A NULL id comes after all others, so such a row stays only
    if no equal row has an id (``keep_id`` is then NULL); rows that repeat the
    staying id with an equal text are the same document, and all of them are
    marked as kept.  Extra columns are ignored, and an empty table gives an empty
    result.  ``digest`` may be any function of the text, also a weak one.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("_id"), norm.alias("_norm")).withColumn(
        "_dig", digest(F.col("_norm")))
    # Narrow counts find the hot digests: at most one in ``hot`` rows.
    busy = materialized(rows.groupBy("_dig").count().where(F.col("count") > hot).select("_dig", F.lit(True).alias("_hot")), "busy")
    salted = rows.join(busy, "_dig", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.spark_partition_id() % salts).otherwise(F.lit(-1)))
    # Map-side combine: local deduplication; its exchange: the salted merge.
    merged = salted.groupBy("_dig", "_salt", "_norm").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
    # Salt winners of one content meet; all others come alone and only their narrow row moves on.
    winners = materialized(merged.select(
        "_dig", "_salt", "_keep", "_size", F.when(F.col("_salt") >= 0, F.col("_norm")).alias("_norm")), "winners")
    final = (
        winners.where("_salt >= 0").groupBy("_dig", "_norm").agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"))
        .select("_dig", "_keep", "_size")
        .unionByName(winners.where("_salt < 0").select("_dig", "_keep", "_size"))
    )
    contents = final.groupBy("_dig").agg(
        F.count("*").alias("_contents"), F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    # A digest with one content identifies it.  One with several is looked up by content again.
    shared = materialized(contents.where("_contents > 1").select("_dig"), "shared")
    # Stored, so that both sides of the join are plain shuffles: Spark splits the rows of a hot digest.
    single = materialized(contents.where("_contents = 1 AND _size > 1").drop("_contents"), "groups")
    narrow = rows.select("_id", "_dig", sha256(F.col("_norm")).alias("text_sha256"))
    plain = narrow.join(shared, "_dig", "left_anti").join(single, "_dig", "left")
    clashing = rows.join(shared, "_dig", "left_semi")
    by_content = materialized(clashing.groupBy("_dig", "_norm").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size")), "clashing")
    exact = clashing.join(by_content, ["_dig", "_norm"]).select(
        "_dig", "_id", sha256(F.col("_norm")).alias("text_sha256"), "_keep", "_size")
    both = plain.unionByName(exact)
    keep = F.coalesce("_keep", "_id")
    nullable = lambda c: F.when(c != LAST_ID, c)
    return both.select(
        nullable(F.col("_id")).alias("doc_id"), nullable(keep).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), (keep == F.col("_id")).alias("kept"), "text_sha256",
    )
