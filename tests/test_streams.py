"""Streams against batch: out of order, late, repeated and failed epochs, a hot key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webgrain.operators import memory, ordered, pacing
from webgrain.streaming.compaction import RollupStore, fold_stream
from webgrain.streaming.ordered_stream import DistinctStream, OrderedStream, run

START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, seq long, v long"


def log(seed, n, hot=0.35):
    """(k, ts, seq, v): one key holds a third; several rows share a time; NULL keys."""
    rng = random.Random(seed)
    return [(None if rng.random() < 0.05 else "hot" if rng.random() < hot else f"k{rng.randrange(30)}",
             START + timedelta(minutes=rng.randrange(n // 2)), i, rng.randrange(1000)) for i in range(n)]


def arrivals(rows, seed, minutes):
    """The rows in an order of arrival that is up to ``minutes`` off."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, minutes)))


def brute(rows, n):
    held, out = {}, {}
    for k, ts, seq, v in sorted(rows, key=lambda r: (r[1], r[2])):
        out[seq] = held.get(k, [])[-n:]
        held.setdefault(k, []).append(v)
    return out


def stream(spark, path, n=2, hot_rows=100):
    return OrderedStream(spark, str(path), SCHEMA, "k", ["ts", "seq"], F.col("v"), n, delay=timedelta(minutes=40), hot_rows=hot_rows)


def test_out_of_order_equals_batch(spark, tmp_path):
    rows = log(1, 900)
    coming = arrivals(rows, 2, 30)
    kept = stream(spark, tmp_path)
    for epoch in range(4):
        batch = spark.createDataFrame(coming[epoch * 225:(epoch + 1) * 225], SCHEMA).repartition(3)
        kept.add(batch, epoch)
        kept.add(batch, epoch)  # an epoch that is given again changes nothing
        got = {r.seq: r.earlier for r in kept.released().collect()}
        want = brute(rows, 2)
        assert len(got) < 900 and all(want[s] == e for s, e in got.items())
    kept.finish()
    kept.finish()
    out = kept.released().collect()
    assert len(out) == 900 and {r.seq: r.earlier for r in out} == brute(rows, 2) and kept.late().count() == 0
    with pytest.raises(ValueError):
        kept.add(spark.createDataFrame(rows[:1], SCHEMA), 99)


def test_late_rows_are_kept_apart(spark, tmp_path):
    kept = stream(spark, tmp_path)
    at = lambda m: START + timedelta(minutes=m)
    kept.add(spark.createDataFrame([("a", at(0), 0, 1), ("a", at(100), 1, 2), ("a", None, 2, 3)], SCHEMA), 0)
    kept.add(spark.createDataFrame([("a", at(10), 3, 4), ("a", at(70), 4, 5)], SCHEMA), 1)
    kept.finish()
    assert [r.seq for r in kept.late().collect()] == [3]
    # A row without a time stands first, as NULLs do in the batch.
    assert {r.seq: r.earlier for r in kept.released().collect()} == {2: [], 0: [3], 4: [3, 1], 1: [1, 5]}


def test_an_epoch_that_fails_anywhere_runs_again(spark, tmp_path, monkeypatch):
    rows = log(3, 300)
    coming, want = arrivals(rows, 4, 30), brute(rows, 2)
    batches = [spark.createDataFrame(coming[k * 100:(k + 1) * 100], SCHEMA) for k in range(3)]
    import webgrain.sources.files as files
    real = files.Store.create
    for fail_at in range(1, 4):  # the state's manifest, its marker, the epoch's own record
        kept, calls = stream(spark, tmp_path / str(fail_at)), []
        for epoch, batch in enumerate(batches):
            with monkeypatch.context() as broken:
                def create(self, path, text, seen=calls):
                    seen.append(path)
                    if len(seen) == fail_at:
                        raise OSError("lost")
                    return real(self, path, text)
                calls.clear()
                broken.setattr(files.Store, "create", create)
                with pytest.raises(OSError):
                    kept.add(batch, epoch)
            kept.add(batch, epoch)
        kept.finish()
        out = kept.released().collect()
        assert len(out) == 300 and {r.seq: r.earlier for r in out} == want


def test_a_hot_key_is_cut(spark, tmp_path, monkeypatch):
    cut = []
    real = ordered._cut
    monkeypatch.setattr(ordered, "_cut", lambda df, keys, order, hot: cut.append(real(df, keys, order, hot)) or cut[-1])
    rows = log(5, 600, hot=0.66)
    kept = stream(spark, tmp_path, hot_rows=50)
    kept.add(spark.createDataFrame(rows, SCHEMA).repartition(3), 0)
    kept.finish()
    assert {r.seq: r.earlier for r in kept.released().collect()} == brute(rows, 2)
    slices = [hot.groupBy("k", "__slice").count().collect() for _, hot in cut if hot is not None and "v" in hot.columns]
    assert slices and max(len(s) for s in slices) > 6 and all(r["count"] < 100 for s in slices for r in s)


def test_pacing_of_a_real_stream(spark, tmp_path):
    rows = spark.createDataFrame(arrivals(log(6, 500), 7, 20), SCHEMA).selectExpr(
        "k AS host", "ts", "seq", "v % 3 <> 0 AS ok", "CAST(v * 3 AS DOUBLE) AS latency_ms",
        "CASE WHEN seq % 7 = 0 THEN 429 END AS status", "CAST(NULL AS STRING) AS error")
    data = [tuple(r) for r in rows.collect()]
    for n in range(3):
        part = spark.createDataFrame(data[n * 170:(n + 1) * 170], rows.schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from webgrain.streaming.ordered_stream import pacing_factors
    got = {r.seq: r.factor for r in pacing_factors(source, str(tmp_path / "work"), delay=timedelta(days=1), hot_rows=60).collect()}
    want = {r.seq: r.factor for r in pacing.with_pacing(rows, hot_rows=60).collect()}
    assert len(got) == 500 and got == pytest.approx(want)


def outcomes(spark, n):
    return spark.range(n).selectExpr(
        "concat('d', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END) AS domain", "id % 4 <> 1 AS ok", "timestamp_seconds(id * 60) AS ts", "id AS seq",
        "CASE WHEN id % 5 = 1 THEN 'E' END AS error_code", "id % 101 / 100 AS confidence")


def test_folded_epochs_equal_the_batch(spark, tmp_path):
    rows = outcomes(spark, 2_000).cache()
    store, most = RollupStore(spark, str(tmp_path), fanout=3), 0
    for epoch in range(20):
        for _ in range(1 + (epoch % 4 == 0)):
            store.add(rows.where(f"seq % 20 = {epoch}"), epoch)
        store.add(rows.where(f"seq % 20 = {epoch // 2}"), epoch // 2)
        most = max(most, len(store.widest()))
    # 20 = 202 in base 3: two sets of nine and two of one.
    assert store.widest() == [(0, 8), (9, 17), (18, 18), (19, 19)] and most <= 6 and len(store.sets()) <= 8
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(store.rollup()) == key(memory.domain_rollup(rows))


def test_a_set_that_was_not_finished_does_not_count(spark, tmp_path):
    rows = outcomes(spark, 300).cache()
    store = RollupStore(spark, str(tmp_path), fanout=2)
    assert store.rollup().count() == 0
    store.add(rows.where("seq < 100"), 0)
    memory.domain_partials(rows.where("seq < 200")).write.parquet(store._name(1, 1))
    store._store.delete(f"{store._name(1, 1)}/_SUCCESS")
    store.add(rows.where("seq >= 100"), 1)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert store.widest() == [(0, 1)] and key(store.rollup()) == key(memory.domain_rollup(rows))


def test_fold_stream(spark, tmp_path):
    rows = outcomes(spark, 400)
    for n in range(5):
        rows.where(f"seq % 5 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = fold_stream(source, str(tmp_path / "sets"), str(tmp_path / "checkpoint"), fanout=2)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert len(store.widest()) == 2 and key(store.rollup()) == key(memory.domain_rollup(rows))


def test_distinct_captures_in_two_tiers(spark, tmp_path):
    rng = random.Random(8)
    pages = [(f"u{rng.randrange(6)}", "hot" if rng.random() < 0.4 else rng.choice([None, "", *"abcdef"])) for _ in range(200)]
    schema = "url string, html string"
    for n in range(4):
        spark.createDataFrame(pages[n * 50:(n + 1) * 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = DistinctStream(spark, str(tmp_path / "work"), buckets=4)
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.url, r.html) for r in kept.run(source).collect()) == order(set(pages))
    # The first tier has forgotten everything: copies are known to the archive, a late first copy is not.
    from webgrain.sources.tables import archive_key
    late = spark.createDataFrame([*pages[:40], ("new", "late"), ("new", "late")], schema).withColumn("archive_key", archive_key(F.col("url"), F.col("html")))
    for _ in range(2):
        kept.add(late, 50)
    assert order((r.url, r.html) for r in kept.captures().collect()) == order({*pages, ("new", "late")})
    # An epoch that wrote its rows but did not merge its keys.
    import webgrain.sources.files as files
    real = files.Store.create
    more = spark.createDataFrame([("x", "1"), ("x", "2"), ("new", "late")], schema).withColumn("archive_key", archive_key(F.col("url"), F.col("html")))
    with pytest.MonkeyPatch.context() as broken:
        def lost(self, path, text):
            raise OSError("lost")
        broken.setattr(files.Store, "create", lost)
        with pytest.raises(OSError):
            kept.add(more, 51)
    assert files.Store.create is real
    kept.add(more, 51)
    assert order((r.url, r.html) for r in kept.captures().collect()) == order({*pages, ("new", "late"), ("x", "1"), ("x", "2")})


def test_an_epoch_arrives_in_the_parts_of_its_table(spark, tmp_path):
    """No task writes or reads a whole epoch."""
    from webgrain.plans.record_queries import _arrive
    rows, folder = spark.range(600).repartition(3), str(tmp_path / "in")
    assert [_arrive(rows.where(f"id % 3 = {n}"), folder) for n in range(3)] == [3, 3, 3]
    stored = spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()
    assert len(stored) == 9 and sum(r[1] for r in stored) == 600 and max(r[1] for r in stored) < 200


def test_rate_is_the_source_s(spark, tmp_path):
    """One file an epoch, as the reader was told."""
    for n in range(3):
        spark.createDataFrame(log(n, 20), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sizes = []
    run(source, lambda batch, epoch: sizes.append(batch.count()), str(tmp_path / "checkpoint"))
    assert [s for s in sizes if s] == [20, 20, 20]
