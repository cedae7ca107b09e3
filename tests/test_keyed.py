"""The keyed table: batches in any order, repeated, and failed half-way."""

import random

import pytest

from webgrain.sources.keyed import KeyedTable

SCHEMA = "k string, part long, id long, ts long, value string"


def table(spark, path, **options):
    return KeyedTable(spark, str(path), SCHEMA, ["k", "part"], ["ts"], keep=("id",), **options)


def expected(batches):
    out = {}
    for batch in batches:
        for k, part, id_, ts, value in sorted(batch, key=lambda r: r[3]):
            old = out.get((k, part))
            if old is None:
                out[k, part] = (k, part, id_, ts, value)
            elif ts > old[3]:
                out[k, part] = (k, part, old[2], ts, value)
    return sorted(out.values(), key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def batches(seed):
    rng, clock = random.Random(seed), iter(random.Random(seed).sample(range(10_000), 1_500))
    # A third of all rows have one key; NULL keys and late rows are among them.
    keys = [("hot", 1)] * 40 + [(None, None)] * 4 + [(f"k{i}", i % 3) for i in range(80)]
    return [[(*rng.choice(keys), rng.randrange(10**6), next(clock), f"v{n}") for _ in range(200)] for n in range(3)]


def test_batches_repeated_and_failed(spark, tmp_path, monkeypatch):
    one, two, three = batches(1)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = table(spark, tmp_path, buckets=8)
    assert kept.read().count() == 0 and kept.version() == 0
    assert kept.merge(frame(one), "one") == 1
    assert rows_of(kept.read()) == expected([one])
    assert kept.merge(frame(two), "two") == 2 and kept.merge(frame(two), "two") == 2 and kept.merge(frame(one), "one") == 2
    seen = kept.read()  # a reader of version 2
    with monkeypatch.context() as broken:
        def lost(self, path, text):
            raise OSError("the driver is gone")
        broken.setattr("webgrain.sources.files.Store.create", lost)
        with pytest.raises(OSError):
            kept.merge(frame(three), "three")
    assert rows_of(kept.read()) == expected([one, two]) and not kept.applied("three")
    with monkeypatch.context() as broken:
        real = type(kept._store).create
        broken.setattr("webgrain.sources.files.Store.create", lambda self, path, text: lost(self, path, text) if "/batches/" in path else real(self, path, text))
        with pytest.raises(OSError):
            kept.merge(frame(three), "three")
    # The manifest is there, the marker was lost: the batch counts as merged.
    assert table(spark, tmp_path, buckets=8).merge(frame(three), "three") == 3
    assert rows_of(kept.read()) == expected([one, two, three]) and rows_of(seen) == expected([one, two])
    kept.vacuum(kept=1)
    assert rows_of(kept.read()) == expected([one, two, three])
    assert len(kept._store.names(f"{tmp_path}/manifests")) == 1
    with pytest.raises(ValueError):
        table(spark, tmp_path, buckets=9).read()


def test_only_touched_buckets_are_written(spark, tmp_path):
    kept = table(spark, tmp_path, buckets=32)
    rows = [(f"k{i}", 0, i, i, "a") for i in range(400)]
    kept.merge(spark.createDataFrame(rows, SCHEMA), "all")
    before = kept._latest()["buckets"]
    assert len(before) == 32
    kept.merge(spark.createDataFrame([("k7", 0, 99, 1000, "b"), ("k7", 0, 98, 999, "c")], SCHEMA), "few")
    after = kept._latest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    found = kept.read_for(spark.createDataFrame([("k7", 0)], "k string, part long"))
    assert 0 < found.count() < 40 and [tuple(r) for r in found.where("k = 'k7'").collect()] == [("k7", 0, 7, 1000, "b")]
    assert kept.merge(spark.createDataFrame([], SCHEMA), "none") == 3 and kept.read().count() == 400


def test_two_writers(spark, tmp_path):
    first, second = table(spark, tmp_path), table(spark, tmp_path)
    stale = second._latest()
    first.merge(spark.createDataFrame([("a", 1, 1, 1, "x")], SCHEMA), "one")
    second._latest = lambda: stale
    with pytest.raises(Exception, match="FileAlreadyExists"):
        second.merge(spark.createDataFrame([("b", 1, 1, 1, "y")], SCHEMA), "two")
    assert rows_of(first.read()) == [("a", 1, 1, 1, "x")]


def test_keys_alone(spark, tmp_path):
    kept = KeyedTable(spark, str(tmp_path), "k long", ["k"], ["k"], buckets=4)
    for n, rows in enumerate(([1, 2, None], [2, 3, None])):
        kept.merge(spark.createDataFrame([(r,) for r in rows], "k long"), str(n))
    assert sorted((r.k for r in kept.read().collect()), key=repr) == [1, 2, 3, None]
