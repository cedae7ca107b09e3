"""Ordered state, roll-ups and drift, in batch and on streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W, functions as F

from webgrain.operators import drift, enrich, entities, memory, normalize, ordered, pacing
from webgrain.sources import tables
from webgrain.streaming import state

START = datetime(2024, 1, 1)


def skewed_log(spark, n=3000):
    """A log in which one key holds more than a third of all rows."""
    return spark.range(n).selectExpr(
        "id AS seq", "CASE WHEN id % 5 < 2 THEN 'hot' ELSE concat('k', id % 37) END AS host",
        "timestamp'2024-01-01' + make_dt_interval(0, 0, CAST(id / 3 AS INT), 0) AS ts",
        "pmod(hash(id), 1000) * 1.0D AS v",
    )


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("hot_rows", [150, 10**6])
def test_two_level_state_equals_plain_windows(spark, hot_rows):
    log = skewed_log(spark)
    w = W.partitionBy("host").orderBy("ts", "seq")
    got = ordered.with_history(log, ["host"], ["ts", "seq"], F.struct("seq"), 10, "h", hot_rows)
    want = log.withColumn("h", F.collect_list(F.struct("seq")).over(w.rowsBetween(-9, 0)))
    assert same(got, want)
    odd = F.when(F.col("seq") % 11 == 0, F.col("seq"))
    got = ordered.with_last(log, ["host"], ["ts", "seq"], odd, "p", hot_rows)
    want = log.withColumn("p", F.last(odd, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    assert same(got, want)
    got = ordered.with_running(log, ["host"], ["ts", "seq"], {"n": F.lit(1), "s": F.col("seq")}, hot_rows)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = log.withColumn("n", F.coalesce(F.count("seq").over(before), F.lit(0))).withColumn(
        "s", F.coalesce(F.sum("seq").over(before), F.lit(0)))
    assert same(got, want)


def test_hot_keys_are_cut_by_rows_at_every_level(spark, monkeypatch):
    """One key (NULL) in half of the rows, all of them at one time: no slice, and no level of carried state, is long."""
    log = spark.range(4000).selectExpr(
        "id AS seq", "CASE WHEN id % 2 = 1 THEN concat('k', id % 37) END AS host", "timestamp'2024-01-01' AS ts", "id * 1.0D AS v")
    cuts, plain = [], ordered._cut

    def watched(df, keys, order, hot_rows):
        rows, hot = plain(df, keys, order, hot_rows)
        cuts.append(rows.groupBy(*keys, "__slice").count().agg(F.max("count")).first()[0])
        return rows, hot

    monkeypatch.setattr(ordered, "_cut", watched)
    w = W.partitionBy("host").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    got = ordered.with_running(log, ["host"], ["ts", "seq"], {"n": F.lit(1)}, 60)
    assert same(got, log.withColumn("n", F.count("seq").over(w)))
    assert len(cuts) >= 3 and max(cuts) <= 120
    got = ordered.with_last(log, ["host"], ["ts", "seq"], F.col("seq"), "p", 200)
    assert same(got, log.withColumn("p", F.last("seq").over(w)))


def test_latest_and_baselines(spark):
    rows = spark.createDataFrame([("a", 1, 10, "x"), ("a", 2, 12, "y"), ("b", 3, 11, "z")], "url string, id int, updated_at int, fp string")
    assert {(r.url, r.fp) for r in ordered.latest(rows, ["url"], ["updated_at", "id"]).collect()} == {("a", "y"), ("b", "z")}
    assert {(r.url, r.baseline_id, r.fp) for r in tables.current_baselines(rows).collect()} == {("a", 1, "y"), ("b", 3, "z")}


def test_selector_health(spark):
    events = [("x", "d", "title", "h1", i == 0, 1.0, START, i) for i in range(2)]
    events += [("x", "d", "text", "p", False, 0.0, START, i) for i in range(5)]
    rows = spark.createDataFrame(events, "platform string, domain string, field string, selector string, matched boolean, confidence double, ts timestamp, seq long")
    health = memory.selector_health(rows)
    assert {(r.field, r.match_rate, r.total) for r in health.collect()} == {("title", 0.5, 2), ("text", 0.0, 5)}
    assert [r.field for r in health.filter(memory.is_degraded()).collect()] == ["text"]
    assert health.filter(memory.is_degraded(min_attempts=6)).isEmpty()
    assert memory.health_summary(health.limit(0)).first().asDict() == {
        "total_selectors": 0, "average_match_rate": 0.0, "degraded_count": 0}
    best = memory.best_selectors(memory.selector_stats(rows)).collect()
    assert {(r.field, r.best_selector) for r in best} == {("title", "h1"), ("text", "p")}


def test_strategy_rules(spark):
    cases = [("tiktok", None, None, None), ("tiktok", True, True, None), ("x", True, True, None), ("other", None, None, None),
             ("x", None, None, "browser"), ("x", None, None, "ftp")]
    rows = spark.createDataFrame(cases, "platform string, h boolean, b boolean, o string")
    got = [r.s for r in rows.select(normalize.choose_strategy(F.col("platform"), F.col("h"), F.col("b"), F.col("o")).alias("s")).collect()]
    assert [g.primary for g in got] == ["browser", "http", "browser", "http", "browser", "ftp"]
    assert [g.rejected for g in got] == [False] * 5 + [True]


def test_attempts(spark):
    rows = spark.createDataFrame(
        [(1, 0, "http", False), (1, 0, "http", False), (1, 1, "browser", True), (2, 0, "http", True), (2, 1, "browser", True), (3, 0, "http", False)],
        "request int, rank int, strategy string, ok boolean")
    got = {r.request: (r.success, r.strategy, r.strategies_attempted, r.fallback_triggered) for r in normalize.resolve_attempts(rows).collect()}
    assert got == {1: (True, "browser", ["http", "browser"], True), 2: (True, "http", ["http"], False), 3: (False, None, ["http"], False)}


def test_confidences(spark):
    conf = normalize.field_confidences(
        {"title": (F.lit("t"), "string"), "text": (F.lit(" "), "string"), "author": (F.lit(None).cast("string"), "string")})
    row = spark.range(1).select(conf.alias("c"), *[
        normalize.overall_confidence(conf, F.lit(f)).alias(n) for n, f in (("plain", False), ("cut", True))]).first()
    assert row.c == {"title": 1.0, "text": 0.0, "author": 0.0} and (row.plain, row.cut) == (0.3333, 0.2667)


def capture_rows(spark):
    snap = lambda ok: {"title": ("h1", ok, 1.0)}
    versions = [
        ("a", 0, "f1", snap(True), "h", 1000), ("a", 1, "f1", snap(True), "h", 1000), ("a", 2, "f2", snap(True), "h", 1000),
        ("a", 3, "f2", snap(False), "h", 1000), ("a", 4, "f2", snap(False), None, 3000), ("a", 5, "f3", snap(True), "g", 3000),
        ("a", 6, "f3", snap(True), "x", 100), ("b", 0, "f", {}, None, 0), ("b", 1, "f", {}, None, 500),
    ]
    rows = [(u, START + timedelta(days=d), i, f, s, h, z) for i, (u, d, f, s, h, z) in enumerate(versions)]
    return spark.createDataFrame(rows, "url string, ts timestamp, seq long, fp string, snapshot map<string,struct<selector:string,matched:boolean,confidence:double>>, hash string, size int")


def test_drift(spark):
    got = {r.seq: (r.alert_type, r.severity) for r in drift.drift_alerts(capture_rows(spark), hot_rows=3).collect()}
    assert got == {
        2: ("structural_change", "warning"), 3: ("selector_degradation", "warning"), 4: ("size_anomaly", "warning"),
        5: ("structural_change", "warning"), 6: ("field_loss,size_anomaly", "critical"),
    }


def feed(spark, rows, folder, parts, order):
    """Write rows as files that arrive one after the other and return the stream."""
    n = rows.count()
    indexed = rows.withColumn("__n", F.row_number().over(W.orderBy(order)) - 1)
    for i in range(parts):
        lo, hi = n * i // parts, n * (i + 1) // parts
        indexed.filter((F.col("__n") >= lo) & (F.col("__n") < hi)).drop("__n").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_drift_stream_equals_batch(spark, tmp_path):
    rows = capture_rows(spark)
    out = state.drain(state.drift_alert_stream(feed(spark, rows, str(tmp_path / "c"), 3, "seq")), "drift")
    assert same(out, drift.drift_alerts(rows))


def outcome_rows(spark):
    return skewed_log(spark, 400).selectExpr(
        "host", "host AS domain", "ts", "seq", "pmod(hash(seq), 3) <> 0 AS ok", "v * 3 AS latency_ms",
        "CASE WHEN seq % 7 = 0 THEN 429 END AS status", "CASE WHEN seq % 9 = 0 THEN 'AntiBotDetectedError' END AS error",
        "CASE WHEN seq % 9 = 0 THEN 'SCR_011' END AS error_code", "v / 1000 AS confidence")


def test_pacing_stream_equals_batch(spark, tmp_path):
    rows = outcome_rows(spark)
    out = state.drain(state.pacing_stream(feed(spark, rows, str(tmp_path / "o"), 3, "seq")), "pacing")
    pick = lambda d: d.select("seq", F.round("factor", 9).alias("f"))
    assert same(pick(out), pick(pacing.with_pacing(rows, hot_rows=50)))


def test_rollup_stream_equals_batch(spark, tmp_path):
    rows = outcome_rows(spark)
    stream = feed(spark, rows, str(tmp_path / "o"), 3, "seq")
    state.fold_rollups(stream, str(tmp_path / "p"), str(tmp_path / "c"))
    assert same(state.read_rollups(spark, str(tmp_path / "p")), memory.domain_rollup(rows))


def test_pacing_factor(spark):
    schema = "ok boolean, latency_ms double, status int, error string"
    one = lambda *o: spark.createDataFrame([([*o],)], f"h array<struct<{schema.replace(' ', ':')}>>".replace(",:", ",")).select(
        pacing.pacing_factor(F.col("h")).alias("f")).first().f
    assert one((True, 10.0, 200, None)) == 1.0
    assert one((False, 10.0, 429, None)) == 4.5
    assert one((False, 9000.0, 429, "AntiBotDetectedError")) == 5.0
    assert one((True, 2000.0, 200, None)) == 2.0


def test_cache_and_budget(spark):
    ask = spark.createDataFrame([("k", 1, START + timedelta(seconds=s)) for s in (0, 60, 3660, 3661)], "cache_key string, seq long, ts timestamp")
    stored = spark.createDataFrame([("k", START + timedelta(seconds=60), "old"), ("j", START, "x")], "cache_key string, ts timestamp, body string")
    got = enrich.with_cached(ask, stored, ttl_seconds=3600, hot_rows=2).orderBy("ts").collect()
    assert [r.cached_body for r in got] == [None, "old", "old", None]
    costs = spark.createDataFrame([("j", i, 4.0) for i in range(4)], "job string, seq long, cost double")
    allowed = lambda cap: [r.allowed for r in enrich.within_budget(costs, cap).orderBy("seq").collect()]
    assert allowed(8.0) == [True, True, False, False] and allowed(0) == [True] * 4


def test_entities(spark):
    bodies = ['{"entities":[{"name":"A","confidence":0.5}]}', '[{"entities":[{"name":"B"}]}]', '[{"name":"C"},{"name":"D"}]',
              '{"entities":"no"}', "nothing"]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    got = entities.entity_table(rows, "id").orderBy("id", "pos").collect()
    assert [(r.id, r["name"]) for r in got] == [(0, "A"), (1, "B"), (2, "C"), (2, "D")]
    pairs = spark.createDataFrame([(1, "Ann Lee", "@al", "Bob", "AL"), (2, "Ann-Lee", None, "ann lee!", None), (3, None, None, "x", None)],
                                  "pair_id int, name_a string, handle_a string, name_b string, handle_b string")
    got = entities.resolve_pairs(pairs).orderBy("pair_id").collect()
    assert [(r.match, r.confidence) for r in got] == [(True, 1.0), (True, 1.0), (False, 0.0)]


def test_distinct_captures(spark, tmp_path):
    rows = spark.createDataFrame([("u", "a", START), ("u", "a", START), ("u", "b", START)], "url string, html string, timestamp timestamp")
    out = state.drain(state.distinct_captures(feed(spark, rows, str(tmp_path / "d"), 2, "html")), "distinct")
    assert out.count() == 2


def test_request_table_covers_whole_pages(spark):
    html = "<p>" + "word " * 30000
    rows = spark.createDataFrame(
        [(i, "u", "generic", "article", html if i < 2 else "<b>", None, "t", "a") for i in range(3)],
        "page_id long, url string, platform string, content_type string, html string, title string, text string, author string")
    got = enrich.request_table(rows, "schema").orderBy("page_id", "chunk_no").collect()
    assert {(r.page_id, r.pages) for r in got} == {(0, 2), (2, 1)}
    assert len([r for r in got if r.page_id == 0]) == 4


@pytest.mark.parametrize("capacity", [1, 3])
def test_arrivals_with_bursts_equal_a_loop(spark, capacity):
    """One host in half of the requests, in bursts and pauses; intervals vary."""
    rows = spark.range(900).selectExpr(
        "id AS seq", "CASE WHEN id % 2 = 0 THEN 'www.x.com' ELSE concat('k', id % 11, '.org') END AS host",
        "CAST(floor(id / 60) * 37 + pmod(hash(id), 9) AS DOUBLE) AS arrival_s", "CASE pmod(hash(id, 1), 4) WHEN 0 THEN NULL ELSE pmod(hash(id, 1), 4) * 0.7D END AS factor")
    got = {r.seq: r.start_s for r in pacing.arrival_schedule(rows, order=["arrival_s", "seq"], capacity=capacity, hot_rows=40).collect()}
    want, queues = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.arrival_s, r.seq)):
        wait = max((r.factor or 1.0) / (0.5 if "x" in r.host else 1 / 3), 1.0 if r.host.endswith("x.com") else 0.5)
        before = queues.setdefault(r.host, [])
        start = r.arrival_s if len(before) < capacity else max(r.arrival_s, before[-capacity][0] + before[-capacity][1])
        before.append((start, wait))
        want[r.seq] = start
    assert got == pytest.approx(want)
    assert sum(abs(want[r.seq] - r.arrival_s) > 1e-9 for r in rows.collect()) > 100


def test_running_max_over_slices(spark):
    log = skewed_log(spark, 1500)
    w = W.partitionBy("host").orderBy("ts", "seq")
    odd = F.when(F.col("seq") % 5 == 0, F.col("v"))
    got = ordered.with_running_max(log, ["host"], ["ts", "seq"], odd, "m", 40)
    assert same(got, log.withColumn("m", F.max(odd).over(w.rowsBetween(W.unboundedPreceding, 0))))
