"""Deletion by index and deep pages."""

import json

import pytest
from pyspark.sql import functions as F

from webgrain.sources import tables
from webgrain.sources.indexed import IndexedTable, PageIndex, forget_domain

SCHEMA = "id long, url string, note string"


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def filled(spark, path):
    table = IndexedTable(spark, str(path), SCHEMA)
    for n in range(4):
        # One host in a third of the rows, another in one batch only.
        rows = spark.range(n * 300, n * 300 + 300).selectExpr(
            "id", f"CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 'https://www.hot.org/' || id WHEN id % 7 = 0 AND {n} = 2 THEN 'http://rare.net/x' "
            "ELSE concat('https://h', id % 5, '.org/', id) END AS url", "concat('n', id) AS note")
        table.append(rows.repartition(3), f"batch-{n}")
        table.append(rows, f"batch-{n}")
    return table


def test_only_files_that_hold_the_domain_are_rewritten(spark, tmp_path):
    table = filled(spark, tmp_path / "t")
    assert table.read().count() == 1_200
    before, rare = set(table.files()), [r.id for r in table.read().where("url LIKE '%rare.net%'").collect()]
    old = table.read()
    hit = set(table.files_of("rare.net"))
    assert len(before) == 12 and 0 < len(hit) <= 3
    for _ in range(2):
        table.delete_domain("rare.net", "request-1", str(tmp_path / "audit"), now())
    after = set(table.files())
    assert before - after == hit and table.files_of("rare.net") == []
    assert table.read().count() == 1_200 - len(rare) and old.count() == 1_200
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "audit")).collect()]
    assert sorted(x["id"] for x in lines) == sorted(rare) and {x["event_type"] for x in lines} == {"deleted"}
    table.delete_domain("nowhere.org", "request-2", str(tmp_path / "audit"), now())
    assert set(table.files()) == after
    table.delete_domain("hot.org", "request-3", str(tmp_path / "audit"), now())
    assert table.read().where("url LIKE '%hot.org%'").count() == 0 and table.read().where("url IS NULL").count() == 24


def test_a_deletion_that_fails_half_way(spark, tmp_path, monkeypatch):
    table = filled(spark, tmp_path / "t")
    gone = table.read().where("url LIKE '%h1.org%'").count()
    import webgrain.sources.files as files
    real = files.Store.create
    for fail_at in (1, 2):  # the manifest, then its marker
        calls = []
        with monkeypatch.context() as broken:
            def create(self, path, text):
                calls.append(path)
                if len(calls) == fail_at:
                    raise OSError("lost")
                return real(self, path, text)
            broken.setattr(files.Store, "create", create)
            with pytest.raises(OSError):
                table.delete_domain("h1.org", "r", str(tmp_path / "audit"), now())
        assert table.read().count() in (1_200, 1_200 - gone)
    table.delete_domain("h1.org", "r", str(tmp_path / "audit"), now())
    assert table.read().count() == 1_200 - gone and spark.read.text(str(tmp_path / "audit")).count() == gone


def test_all_tables_forget(spark, tmp_path):
    held = {n: filled(spark, tmp_path / n) for n in ("results", "archive")}
    forget_domain(held, "h2.org", "r", str(tmp_path / "audit"), now())
    assert all(t.read().where("url LIKE '%h2.org%'").count() == 0 for t in held.values())
    assert spark.read.text(str(tmp_path / "audit/results")).count() == spark.read.text(str(tmp_path / "audit/archive")).count() > 0
    empty = IndexedTable(spark, str(tmp_path / "none"), SCHEMA)
    empty.delete_domain("h2.org", "r", str(tmp_path / "audit/none"), now())
    assert empty.read().count() == 0


def test_deep_pages_equal_the_listing(spark, tmp_path):
    # A third of the rows have one time.
    stored = spark.range(3_000).selectExpr(
        "concat('r', id) AS id", "CASE WHEN id % 3 = 0 THEN timestamp'2024-01-01' ELSE timestamp'2024-01-01' + make_dt_interval(0, CAST(id % 97 AS INT)) END AS created_at",
        "CASE WHEN id % 4 = 0 THEN 'x' ELSE 'web' END AS platform", "CASE WHEN id % 5 > 0 THEN '{}' END AS output_json")
    index = PageIndex(spark, str(tmp_path), [F.desc("created_at"), F.col("id")])
    index.build(stored, ["created_at", "id"], ranges=20)
    for offset, limit, platform in ((0, 10, None), (1_990, 30, None), (2_995, 30, None), (5_000, 5, None), (300, 25, "x"), (740, 25, "x"), (0, 5, "none")):
        got = [r.id for r in index.results(stored, "id", offset, limit, platform).collect()]
        assert got == [r.id for r in tables.list_results(stored, platform=platform, offset=offset, limit=limit).collect()]
        assert len(index.ranges_of(offset, limit, platform)[0]) <= 3
