"""Repeats told apart by a bounded filter; hot keys are split in joins."""

import re

import pytest
from pyspark.sql import functions as F

from webgrain.operators import enrich, normalize, repeats, retention
from webgrain.sources import tables


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 15])
def test_rows_that_stand_alone(spark, monkeypatch, most_bits):
    monkeypatch.setattr(repeats, "MOST_BITS", most_bits)
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id < 9000 THEN id DIV 2 ELSE id END AS k", "id", "repeat('x', 50) AS body")
    once, again = repeats.split_repeats(rows, F.xxhash64("k"))
    counts = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    alone, others = [r.k for r in once.collect()], [r.k for r in again.collect()]
    assert len(alone) + len(others) == 30_000 and all(counts[k] == 1 for k in alone)
    if most_bits > 1 << 15:  # few rows that stand alone are taken for others
        assert sum(counts[k] == 1 for k in others) < 0.1 * len(alone)
    distinct = rows.select("id")
    assert repeats.split_repeats(distinct, F.xxhash64("id"))[1] is None


def test_archive_moves_no_body_that_stands_alone(spark):
    rows = spark.range(2_000).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id) END AS url",
        "CASE WHEN id % 70 = 0 THEN NULL WHEN id % 3 = 0 THEN 'same' ELSE concat('<p>', id) END AS html",
        "timestamp'2024-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS timestamp")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tables.archive_rows(rows, {"n": F.lit(1)})
        got = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = rows.groupBy("url", "html").agg(F.min("timestamp").alias("t")).collect()
    assert sorted((repr(r.url), repr(r.html)) for r in got) == sorted((repr(r.url), repr(r.html)) for r in want)
    first = {(r.url, r.html): r.t.strftime("%Y-%m-%dT%H:%M") for r in want}
    assert all(first[r.url, r.html] in r.metadata for r in got) and len({r.archive_key for r in got}) == len(got)
    # The one branch that shuffles rows is that of repeats; no row meets another table by a shuffle.
    assert "SortMergeJoin" not in plan and len(re.findall(r"Exchange hashpartitioning\(archive_key", plan)) == 1


def split(spark, frame):
    """Run a frame with everything a hot key makes large made small, and say whether Spark split it."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = frame()
        rows = out.collect()
        return rows, "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_domain_is_split(spark, tmp_path):
    spark.range(6_000).selectExpr("id", "concat('https://', CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('h', id % 40) END, '.org/', id) AS url", "'x' AS platform") \
        .repartition(6).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    memory = spark.range(41).selectExpr("concat(CASE WHEN id = 40 THEN 'hot' ELSE concat('h', id) END, '.org') AS domain", "id % 2 = 0 AS http_ok", "true AS browser_ok")
    rows, cut = split(spark, lambda: normalize.with_strategy(pages, memory.groupBy("domain").agg(F.max("http_ok").alias("http_ok"), F.max("browser_ok").alias("browser_ok"))))
    assert len(rows) == 6_000 and cut


def test_a_hot_robots_host_is_split(spark, tmp_path):
    spark.range(6_000).selectExpr("id", "concat('https://', CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('h', id % 40) END, '.org/a', id) AS url").repartition(6) \
        .write.parquet(str(tmp_path / "urls"))
    urls = spark.read.parquet(str(tmp_path / "urls"))
    plain = spark.range(41).selectExpr("concat(CASE WHEN id = 40 THEN 'hot' ELSE concat('h', id) END, '.org') AS host", "'/a1' AS prefix", "false AS allow")
    rows, cut = split(spark, lambda: retention.allowed_by_robots(urls, plain, key="id"))
    assert cut and sum(not r.allowed for r in rows) == sum(str(i).startswith("1") for i in range(6_000))
    named = plain.select("host", F.lit("*").alias("agent"), F.lit("/a*1$").alias("pattern"), "allow")
    rows, cut = split(spark, lambda: retention.robots_verdicts(urls, named, "bot", key="id"))
    assert cut and sum(not r.allowed for r in rows) == 600


def test_a_shared_content_is_split(spark, tmp_path):
    spark.range(6_000).selectExpr("id AS page_id", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE concat('c', id) END AS cache_key", "CAST(NULL AS STRING) AS title").repartition(6) \
        .write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    answers = pages.select("cache_key").distinct().selectExpr("cache_key", "0 AS chunk_no", "concat('t', cache_key) AS title")
    lacking = pages.select("page_id", "cache_key")
    rows, cut = split(spark, lambda: enrich.merge_chunks(pages, lacking, answers, {"title": "string"}))
    assert cut and sum(r.title == "thot" for r in rows) == 4_000 and len(rows) == 6_000
