"""Nothing is cut: whole texts, NULL parts, late and unreadable rows, chunks and shared contents."""

import pytest
from pyspark.sql import functions as F

from webgrain.functions import gates, scalars
from webgrain.operators import enrich, normalize
from webgrain.session import TASK_ROWS, spread, work_folder
from webgrain.sources import tables


def test_archive_keeps_null_parts_apart(spark):
    rows = [("a", "x"), ("a", "x"), (None, "x"), (None, "y"), ("b", None), ("b", ""), (None, None)]
    caps = spark.createDataFrame(rows, "url string, html string").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    out = tables.archive_rows(caps)
    assert sorted(map(repr, ((r.url, r.html) for r in out.collect()))) == sorted(map(repr, set(rows)))
    assert tables.archive_rows(caps.limit(0)).count() == 0


def test_hash_sees_the_whole_field(spark):
    rows = spark.createDataFrame([("a" * 500 + "x",), ("a" * 500 + "y",)], "text string")
    assert rows.select(scalars.critical_hash(text=F.col("text")).alias("h")).distinct().count() == 2


def test_classifier_reads_the_whole_page(spark):
    html = "<html>" + " " * 9000 + "<title>Villa for sale</title>"
    row = spark.createDataFrame([(html,)], "html string").select(
        gates.classify_content(F.col("html"), F.lit("https://a.org/")).alias("c")).first()
    assert row.c.content_type == "real_estate"


def test_request_keeps_pages_without_body(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, "x"), (3, "x"), (4, None)], "page_id long, html string").selectExpr(
        "page_id", "'u' AS url", "'p' AS platform", "'c' AS content_type", "html", "CAST(NULL AS STRING) AS title",
        "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS author")
    rows = {r.page_id: (r.pages, r.prompt is None) for r in enrich.request_table(pages, "s").collect()}
    assert rows == {1: (2, True), 2: (2, False)}


def test_chunk_answers_fold_to_one_row_per_page(spark):
    answers = spark.createDataFrame(
        [("k", 1, "late", 7, ["b"]), ("k", 0, " ", None, ["a"]), ("k", 2, "later", 8, ["b", "c"]), ("k", 1, "late", 7, ["b"])],
        "cache_key string, chunk_no int, title string, likes long, tags array<string>")
    lacking = spark.createDataFrame([(1, "k"), (2, "k")], "page_id long, cache_key string")
    pages = spark.createDataFrame([(1, None, None, None), (2, "own", None, None), (3, None, 5, None)],
                                  "page_id long, title string, likes long, tags array<string>")
    fields = {"title": "string", "likes": "bigint", "tags": "array<string>"}
    out = {r.page_id: (r.title, r.likes, r.tags) for r in enrich.merge_chunks(pages, lacking, answers, fields).collect()}
    assert out == {1: ("late", 7, ["a", "b", "c"]), 2: ("own", 7, ["a", "b", "c"]), 3: (None, 5, None)}


def test_repeated_answers_do_not_multiply_pages(spark):
    pages = spark.createDataFrame([(1, None)], "page_id long, title string")
    answers = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "page_id long, title string")
    assert [r.title for r in normalize.merge_answers(pages, answers, "page_id", {"title": "string"}).collect()] == ["a"]


def test_unreadable_lines_are_returned(spark):
    path = work_folder(spark, "lines")
    spark.createDataFrame([('{"domain":"a","n":1}',), ("{oops",)], "value string").write.text(path)
    rows = {(r.domain, r.rejected) for r in tables.read_memory_json(spark, path, "domain string, n long").collect()}
    assert rows == {("a", None), (None, "{oops")}


def test_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Session(), "x")


def test_rows_are_dealt_by_their_number(spark, tmp_path):
    """Short rows of a row group that no reader splits, and one of many small groups."""
    rows, wanted = 9 * TASK_ROWS, 9
    spark.range(rows).coalesce(1).write.parquet(str(tmp_path / "one"))
    out = spread(spark.read.parquet(str(tmp_path / "one")), "id")
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == wanted and sum(sizes) == rows and max(sizes) < 2 * TASK_ROWS
    spark.range(400).repartition(8).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many, "id").count() == 400
    assert spread(many.where("id < 0"), "id").count() == 0
