"""Registered queries over fetch logs, drift and ordered state (F7, F8, G, H, I)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from webgrain.functions import scalars
from webgrain.operators import drift, enrich, entities, extract, memory, normalize, ordered, pacing, rules
from webgrain.operators.dom import parse_page
from webgrain.operators.packs import BUILT_IN, SAMPLES, TIKTOK
from webgrain.operators.selectors import Page
from webgrain.plans.registry import Tables, View, query
from webgrain.plans.views import OUTCOMES, SELECTORS
from webgrain.session import materialized

# --- F7, F8 --------------------------------------------------------------------------
_ATTEMPTS = View(
    "events",
    request="CAST(floor(event_id / 2) AS BIGINT)",
    rank="CAST(event_id % 2 AS BIGINT)",
    strategy="CASE WHEN user_id % 2 = event_id % 2 THEN 'http' ELSE 'browser' END",
    ok="event_type <> 'error'",
)


@query("F7_fallback_resolution", f"""
WITH w AS (SELECT *, min(CASE WHEN ok THEN rank END) OVER (PARTITION BY request) AS winner FROM {_ATTEMPTS.sql})
SELECT request, max(winner) IS NOT NULL AS success, max(CASE WHEN rank = winner THEN strategy END) AS strategy,
  string_agg(strategy, '>' ORDER BY rank) FILTER (winner IS NULL OR rank <= winner) AS tried,
  count(*) FILTER (winner IS NULL OR rank <= winner) > 1 AS fallback_triggered
FROM w GROUP BY request""")
def fallback_resolution(t: Tables) -> DataFrame:
    out = normalize.resolve_attempts(t.view(_ATTEMPTS))
    return out.withColumn("tried", F.array_join("strategies_attempted", ">")).drop("strategies_attempted")


_SITES = View(
    "pages",
    page_id="page_id",
    url="concat('https://www.h', page_id % 160, '.example.com/p')",
    platform="CASE page_id % 5 WHEN 0 THEN 'tiktok' WHEN 1 THEN 'x' WHEN 2 THEN 'linkedin' WHEN 3 THEN 'generic' ELSE 'other' END",
    override="CASE WHEN page_id % 9 = 0 THEN 'http' WHEN page_id % 9 = 1 THEN 'ftp' END",
)
_STRATEGY_MEMORY_SQL = f"""(SELECT domain, bool_or(strategy = 'http' AND ok AND latency_ms < 150) AS http_ok,
  bool_or(strategy = 'browser' AND ok AND latency_ms < 150) AS browser_ok FROM {OUTCOMES.sql} GROUP BY domain)"""


@query("F8_strategy_choice", f"""
WITH s AS (SELECT page_id, platform, override, platform IN ('tiktok', 'linkedin') AS b, coalesce(http_ok, false) AS h,
  coalesce(browser_ok, false) AS br FROM {_SITES.sql} p LEFT JOIN {_STRATEGY_MEMORY_SQL} m
  ON 'h' || page_id % 160 || '.example.com' = m.domain),
c AS (SELECT *, CASE WHEN override IS NOT NULL THEN override WHEN b AND h THEN 'http' WHEN NOT b AND br THEN 'browser'
  WHEN b THEN 'browser' ELSE 'http' END AS p FROM s)
SELECT page_id, p AS "primary", CASE WHEN p = 'http' THEN 'browser' ELSE 'http' END AS fallback,
  CASE WHEN override IS NOT NULL THEN 'User override: ' || override
   WHEN NOT b AND br THEN 'Domain memory indicates browser strategy succeeds'
   WHEN b AND h THEN 'Domain memory indicates HTTP strategy succeeds'
   WHEN b THEN platform || ' requires JavaScript rendering'
   WHEN platform IN ('x', 'generic') THEN platform || ' prefers HTTP with browser fallback'
   ELSE 'Generic/static pages default to HTTP' END AS reason,
  coalesce(override NOT IN ('http', 'browser'), false) AS rejected FROM c""")
def strategy_choice(t: Tables) -> DataFrame:
    fast = t.view(OUTCOMES).withColumn("ok", F.col("ok") & (F.col("latency_ms") < 150))
    known = memory.domain_strategies(memory.strategy_memory(fast))
    out = normalize.with_strategy(t.view(_SITES), known, override=F.col("override"))
    return out.select("page_id", "selection.*")


@query("I1_domain_memory_join", f"""
SELECT page_id, m.domain IS NOT NULL AS known, coalesce(http_ok, false) AS http_ok FROM {_SITES.sql}
LEFT JOIN {_STRATEGY_MEMORY_SQL} m ON 'h' || page_id % 160 || '.example.com' = m.domain""")
def domain_memory_join(t: Tables) -> DataFrame:
    from webgrain.functions.urls import domain_of

    fast = t.view(OUTCOMES).withColumn("ok", F.col("ok") & (F.col("latency_ms") < 150))
    known = memory.domain_strategies(memory.strategy_memory(fast))
    rows = t.view(_SITES).withColumn("domain", domain_of(F.col("url")))
    return rows.join(known, "domain", "left").select(
        "page_id", F.col("http_ok").isNotNull().alias("known"), F.coalesce("http_ok", F.lit(False)).alias("http_ok")
    )


# --- G ------------------------------------------------------------------------------------
@query("E9_fetch_ok", f"""
SELECT seq, error IS NULL AND coalesce(status < 400, true) AS ok FROM {OUTCOMES.sql}""")
def fetch_ok(t: Tables) -> DataFrame:
    from webgrain.functions.gates import fetch_ok as ok

    return t.view(OUTCOMES).select("seq", ok(F.col("status"), F.col("error")).alias("ok"))


@query("G1_domain_rollup", f"""
SELECT domain, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures,
  round(count(*) FILTER (ok) / count(*), 3) AS success_rate, max(ts) FILTER (ok) AS last_success,
  max(ts) FILTER (NOT ok) AS last_failure, arg_max(error_code, ts) FILTER (NOT ok AND error_code IS NOT NULL) AS last_error_code,
  -- exact half-up rounding, in whole numbers (confidences have two digits)
  ((sum(CAST(round(confidence * 100) AS BIGINT)) FILTER (ok) * 200 + count(*) FILTER (ok)) // (2 * count(*) FILTER (ok)))::DOUBLE / 10000 AS average_confidence FROM {OUTCOMES.sql} GROUP BY domain""")
def domain_rollup(t: Tables) -> DataFrame:
    return memory.domain_rollup(t.view(OUTCOMES))


@query("G2_strategy_memory", f"""
SELECT domain, strategy, bool_or(ok) AS success, max(ts) FILTER (ok) AS last_success, max(ts) FILTER (NOT ok) AS last_failure
FROM {OUTCOMES.sql} GROUP BY domain, strategy""")
def strategy_memory(t: Tables) -> DataFrame:
    return memory.strategy_memory(t.view(OUTCOMES))


_STATS_SQL = f"""(SELECT domain, field, selector, count(*) AS attempts, count(*) FILTER (matched) AS successes,
  round(count(*) FILTER (matched) / count(*), 3) AS match_rate, max(ts) AS last_seen,
  round(arg_max(confidence, ts), 3) AS confidence, min(seq) AS first_seq FROM {SELECTORS.sql} GROUP BY domain, field, selector)"""


@query("G3_selector_stats", f"SELECT * FROM {_STATS_SQL}")
def selector_stats(t: Tables) -> DataFrame:
    return memory.selector_stats(t.view(SELECTORS))


@query("G3_best_selector", f"""
SELECT domain, field, selector AS best_selector FROM (SELECT *, row_number() OVER (PARTITION BY domain, field
  ORDER BY match_rate DESC, attempts DESC, first_seq) AS n FROM {_STATS_SQL}) WHERE n = 1""")
def best_selector(t: Tables) -> DataFrame:
    return memory.best_selectors(memory.selector_stats(t.view(SELECTORS)))


_HEALTH_SQL = f"""(SELECT platform, field, selector, count(*) FILTER (matched) AS successes,
  count(*) FILTER (NOT matched) AS failures, count(*) AS total, round(count(*) FILTER (matched) / count(*), 3) AS match_rate,
  max(ts) AS last_seen FROM {SELECTORS.sql} GROUP BY platform, field, selector)"""


@query("G4_selector_health", f"SELECT * FROM {_HEALTH_SQL}")
def selector_health(t: Tables) -> DataFrame:
    return memory.selector_health(t.view(SELECTORS))


@query("G5_degraded_selectors", f"SELECT * FROM {_HEALTH_SQL} WHERE total >= 5 AND match_rate < 0.5")
def degraded_selectors(t: Tables) -> DataFrame:
    return memory.selector_health(t.view(SELECTORS)).filter(memory.is_degraded(min_attempts=0))


@query("G6_health_summary", f"""
SELECT count(*) AS total_selectors, round(coalesce(avg(match_rate), 0), 3) AS average_match_rate,
  count(*) FILTER (total >= 5 AND match_rate < 0.5) AS degraded_count FROM {_HEALTH_SQL}""")
def health_summary(t: Tables) -> DataFrame:
    return memory.health_summary(memory.selector_health(t.view(SELECTORS)))


@query("G7_batch_summary", f"""
SELECT strategy, count(*) AS count, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed
FROM {OUTCOMES.sql} GROUP BY strategy""")
def batch_summary(t: Tables) -> DataFrame:
    return memory.batch_summary(t.view(OUTCOMES).withColumnRenamed("ok", "success"), ["strategy"])


@query("G8_pack_score", """
SELECT count(*) AS pages, 4 AS selectors, 3 AS matched, 'missing_field' AS missing, 0.75::DOUBLE AS score FROM pages""")
def pack_score(t: Tables) -> DataFrame:
    tried = rules.PageRules(
        {"title": ["main h1", "article h1"], "body": ["body"], "link": ["nav a"]},
        lambda page, chains: {}, lambda page, values: {},
    )
    rows = t.spread("pages", "page_id").select(parse_page(F.col("html")).alias("parsed"))
    return rules.score_rules(rows, tried, ["title", "body", "missing_field"])


_LONG = View(
    "events",
    seq="event_id",
    field="CASE event_type WHEN 'click' THEN 'tags' WHEN 'view' THEN 'views' WHEN 'error' THEN 'title' "
          "WHEN 'signup' THEN 'author' ELSE 'title_confidence' END",
    kind="CASE event_type WHEN 'click' THEN 'list' WHEN 'view' THEN 'number' WHEN 'error' THEN 'string' ELSE 'other' END",
    value="CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'T' END "
          "ELSE 'x' END",
)


@query("G9_field_expectations", f"""
WITH l AS (SELECT * FROM {_LONG.sql} WHERE field <> 'title_confidence'),
e AS (SELECT field, arg_max(CASE WHEN kind = 'list' THEN 'list' WHEN kind = 'number' THEN 'number'
  WHEN kind = 'string' AND trim(value) <> '' THEN 'string' WHEN value IS NULL THEN 'optional' ELSE 'present' END, seq) AS expected
  FROM l GROUP BY field)
SELECT e.field, expected, count(*) FILTER (expected = 'string' AND trim(value) = '') AS failures
FROM e JOIN l USING (field) GROUP BY e.field, expected""")
def field_expectations(t: Tables) -> DataFrame:
    values = t.view(_LONG)
    expected = rules.field_expectations(values)
    failures = rules.expectation_failures(values, expected).groupBy("field").agg(F.count(F.lit(1)).alias("failures"))
    return expected.join(failures, "field", "left").fillna(0, ["failures"])


_USAGE = View(
    "events",
    job="event_type",
    prompt_tokens="CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id * 10 END",
    completion_tokens="event_id % 100",
)


@query("G10_usage_totals", f"""
SELECT job, count(*) AS calls, sum(coalesce(prompt_tokens, 0))::BIGINT AS prompt_tokens,
  sum(completion_tokens)::BIGINT AS completion_tokens,
  sum(coalesce(prompt_tokens, 0) + completion_tokens)::BIGINT AS total_tokens,
  round(sum(coalesce(prompt_tokens, 0)) * 0.00001::DOUBLE + sum(completion_tokens) * 0.00003::DOUBLE, 6) AS cost_usd
FROM {_USAGE.sql} GROUP BY job""")
def usage_totals(t: Tables) -> DataFrame:
    return memory.usage_totals(t.view(_USAGE), ["job"])


# --- H ------------------------------------------------------------------------------------------
# Three captures per page: as given, one mutated by rule, and the mutated one again.
_MUTATED = """CASE page_id % 5 WHEN 0 THEN html
  WHEN 1 THEN replace(html, '<body>', '<body><section></section>')
  WHEN 2 THEN replace(html, '<title>', '<title>New ')
  WHEN 3 THEN concat(html, '<!--', repeat('x', CAST(length(html) AS INT)), '-->')
  ELSE replace(replace(html, '<title>', '<title>Old '), '<body>', '<body><div></div>') END"""


def captures(t: Tables) -> DataFrame:
    """Baselines of three captures per page."""
    versions = F.explode(F.expr(
        f"array(named_struct('v', 0, 'html', html), named_struct('v', 1, 'html', {_MUTATED}), "
        f"named_struct('v', 2, 'html', {_MUTATED}))"
    )).alias("c")
    rows = t.spread("pages", "page_id").select("page_id", "url", versions).select("page_id", "url", "c.v", F.col("c.html").alias("html"))
    parsed = rows.withColumn("parsed", parse_page(F.col("html"), keep_tags=["title", "body", "article", "h1"], skeleton=True))
    page = Page("parsed")
    f = extract.basic_fields(page)
    chains = {"heading": page.chain(["body section", "article h1"])}
    return parsed.select(
        "url", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(v, 0, 0, 0)").alias("ts"),
        (F.col("page_id") * 3 + F.col("v")).alias("seq"),
        drift.fingerprint(F.col("parsed.skeleton")).alias("fp"),
        extract.selector_snapshot(chains).alias("snapshot"),
        scalars.critical_hash(title=f["title"], text=f["text"]).alias("hash"),
        F.octet_length("html").alias("size"), F.lit("web").alias("platform"), F.lit("article").alias("content_type"),
    )


def baselines(t: Tables) -> DataFrame:
    """The captures as a stored baseline history: pages are parsed once, then only small rows move."""
    return materialized(captures(t), "baselines")


_BYTES = "octet_length(encode({0}))"
_ALERTS_SQL = f"""
WITH d AS (SELECT url, page_id, {_BYTES.format("html")} AS a, {_BYTES.format(_MUTATED)} AS b FROM pages)
SELECT url, page_id * 3 + 1 AS seq, CASE page_id % 5 WHEN 1 THEN 'structural_change' WHEN 2 THEN 'field_loss'
    WHEN 3 THEN 'size_anomaly' ELSE 'structural_change,field_loss' END AS alert_type,
  CASE WHEN page_id % 5 IN (2, 4) THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN page_id % 5 = 3 THEN round((b - a) / a, 3) END AS delta_ratio, page_id * 3 AS baseline_id,
  CASE WHEN page_id % 5 = 3 THEN a END AS baseline_size, CASE WHEN page_id % 5 = 3 THEN b END AS current_size,
  CASE WHEN page_id % 5 IN (1, 4) THEN true END AS fingerprints, CASE WHEN page_id % 5 IN (2, 4) THEN 'title,author,text' END AS lost,
  'web' AS platform, 'article' AS content_type
FROM d WHERE page_id % 5 <> 0"""


def alert_columns(alerts: DataFrame) -> DataFrame:
    """Alerts in columns that SQL can say: fingerprints only as differing."""
    return alerts.select(
        "url", "seq", "alert_type", "severity", "delta_ratio", "baseline_id", F.col("baseline_size").cast("bigint"),
        F.col("current_size").cast("bigint"), (F.col("old_fingerprint") != F.col("new_fingerprint")).alias("fingerprints"),
        F.array_join("lost_fields", ",").alias("lost"), "platform", "content_type")


@query("H1_drift_alerts", _ALERTS_SQL)
def drift_alerts(t: Tables) -> DataFrame:
    return alert_columns(drift.drift_alerts(baselines(t)))


@query("H2_selector_degradation", """
SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'title' WHEN page_id % 3 = 2 THEN 'text,title' END AS degraded FROM pages""")
def selector_degradation(t: Tables) -> DataFrame:
    cell = lambda ok: f"named_struct('selector', 's', 'matched', {ok}, 'confidence', 1.0D)"
    before = F.expr(f"map('title', {cell('true')}, 'text', {cell('true')}, '_page', {cell('true')})")
    now = F.expr(f"""CASE page_id % 3 WHEN 0 THEN map('title', {cell('true')}, 'text', {cell('true')})
      WHEN 1 THEN map('title', {cell('false')}, 'text', {cell('true')}) ELSE map('other', {cell('true')}) END""")
    rows = t.pages.select("page_id", drift.degraded_fields(before, now).alias("d"))
    names = F.array_join(F.array_sort(F.transform("d", lambda x: x.field)), ",")
    return rows.select("page_id", F.nullif(names, F.lit("")).alias("degraded"))


@query("H3_content_changed", """
SELECT page_id, page_id % 2 = 0 AND trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) <> '' AS changed FROM pages""")
def content_changed(t: Tables) -> DataFrame:
    before = scalars.critical_hash(title=F.expr("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
    now = scalars.critical_hash(title=F.expr(
        "concat(CASE WHEN page_id % 2 = 0 THEN '~' ELSE '' END, regexp_extract(html, '(?s)<title>(.*?)</title>', 1))"))
    return t.pages.select("page_id", drift.content_changed(before, now).alias("changed"))


@query("H4_pacing_factor", f"""
WITH w AS (SELECT *, count(*) FILTER (NOT ok) OVER r AS bad, count(*) OVER r AS n, sum(latency_ms) OVER r AS lat
  FROM {OUTCOMES.sql} WINDOW r AS (PARTITION BY host ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT seq, round(least(5.0, greatest(0.5, (CASE WHEN bad / n > 0.2 THEN 1 + bad / n * 2 ELSE 1 END)
  * (CASE WHEN status IN (429, 403, 503) THEN 1.5 ELSE 1 END)
  * (CASE WHEN error IN ('AntiBotDetectedError', 'RateLimitExceededError') THEN 2 ELSE 1 END)
  * (CASE WHEN lat / n > 1000 THEN least(3.0, lat / n / 1000) ELSE 1 END)))::DOUBLE, 6) AS factor FROM w""")
def pacing_factor(t: Tables) -> DataFrame:
    rows = t.view(OUTCOMES)
    return pacing.with_pacing(rows).select("seq", F.round("factor", 6).alias("factor"))


@query("H5_base_rate", """
SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 0.2 WHEN page_id % 6 = 1 THEN 0.5 WHEN page_id % 6 = 2 THEN 2.0
  WHEN page_id % 6 = 3 THEN 0.9 WHEN contains(regexp_extract(url, '://([^/]*)', 1), 'x') THEN 0.5
  ELSE 1.0 / 3 END::DOUBLE AS rate FROM pages""")
def base_rate(t: Tables) -> DataFrame:
    from webgrain.functions.urls import domain_of

    host = F.expr("""CASE page_id % 6 WHEN 0 THEN 'de.linkedin.com' WHEN 1 THEN 'm.tiktok.com' WHEN 2 THEN 'fast.org'
      WHEN 3 THEN 'youtube.com' END""")
    host = F.coalesce(host, domain_of(F.col("url"), keep_port=False))
    return t.pages.select("page_id", pacing.base_rate(host, {"fast.org": 2.0, "youtube": 0.9}).alias("rate"))


@query("H6_polite_schedule", """
SELECT o_orderkey, o_custkey % 30 AS host_no,
  (row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) - 1) * (2.0 / (1.0::DOUBLE / 3.0)) AS not_before_s FROM orders""")
def polite_schedule(t: Tables) -> DataFrame:
    queue = t.orders.selectExpr(
        "o_orderkey", "o_custkey % 30 AS host_no", "concat('h', o_custkey % 30, '.org') AS host", "2.0D AS factor"
    )
    out = pacing.polite_schedule(queue, order=["o_orderkey"])
    return out.select("o_orderkey", "host_no", "not_before_s")


# Requests with arrival times, in hours of the log, so that queues build up.
_ARRIVALS = View(
    "events", seq="event_id", host="CASE WHEN user_id % 3 = 0 THEN 'x.com' ELSE concat('h', user_id % 20, '.org') END",
    arrival_s="CAST((extract(DAY FROM ts) - 1) * 20 + event_id % 7 AS DOUBLE)",
    factor="CASE WHEN event_type = 'error' THEN 2.0 ELSE 1.0 END")


@query("H6_arrival_schedule", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrival_s, seq) - 1 AS place,
    factor / CASE WHEN contains(host, 'x') THEN 0.5 ELSE 1.0 / 3 END AS own FROM {_ARRIVALS.sql}),
w AS (SELECT *, greatest(own, CASE WHEN host = 'x.com' THEN 1.0 ELSE 0.5 END)::DOUBLE AS wait FROM r),
one AS (SELECT *, sum(wait) OVER (PARTITION BY host ORDER BY place) - wait AS d1,
  sum(wait) OVER (PARTITION BY host, place % 3 ORDER BY place) - wait AS d3 FROM w)
SELECT seq, round(d1 + max(arrival_s - d1) OVER (PARTITION BY host ORDER BY place), 3) AS start_1,
  round(d3 + max(arrival_s - d3) OVER (PARTITION BY host, place % 3 ORDER BY place), 3) AS start_3 FROM one""")
def arrival_schedule(t: Tables) -> DataFrame:
    rows = materialized(t.view(_ARRIVALS), "requests")
    out = pacing.arrival_schedule(rows, order=["arrival_s", "seq"], capacity=3).withColumnRenamed("start_s", "start_3")
    out = pacing.arrival_schedule(materialized(out, "bursts"), order=["arrival_s", "seq"])
    return out.select("seq", F.round("start_s", 3).alias("start_1"), F.round("start_3", 3).alias("start_3"))


@query("H7_budget_gate", """
SELECT event_id, coalesce(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before,
  coalesce(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 50000 AS allowed FROM events""")
def budget_gate(t: Tables) -> DataFrame:
    costs = t.events.selectExpr("event_id", "event_type AS job", "event_id AS seq", "user_id AS cost")
    out = enrich.within_budget(costs, 50000)
    return out.select("event_id", "spent_before", "allowed")


_REQUESTS = View("events", cache_key="concat('k', user_id)", seq="event_id", ts="ts", event_type="event_type")


@query("H8_cached_reuse", f"""
WITH q AS (SELECT * FROM {_REQUESTS.sql} WHERE event_type <> 'click'), r AS (SELECT * FROM {_REQUESTS.sql} WHERE event_type = 'click')
SELECT q.seq, CASE WHEN epoch_us(q.ts) - epoch_us(r.ts) <= 86400000000 THEN 'b' || r.seq END AS cached_body,
  coalesce(epoch_us(q.ts) - epoch_us(r.ts) <= 86400000000, false) AS reused
FROM q ASOF LEFT JOIN r ON q.cache_key = r.cache_key AND q.ts >= r.ts""")
def cached_reuse(t: Tables) -> DataFrame:
    rows = t.view(_REQUESTS)
    stored = rows.filter("event_type = 'click'").selectExpr("cache_key", "ts", "concat('b', seq) AS body")
    asked = rows.filter("event_type <> 'click'")
    return enrich.with_cached(asked, stored, ttl_seconds=86400).select("seq", "cached_body", "reused")


@query("H9_top_per_key", f"""
SELECT host, seq, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, seq DESC) AS n FROM {OUTCOMES.sql})
WHERE n = 1""")
def top_per_key(t: Tables) -> DataFrame:
    rows = t.view(OUTCOMES).select("host", "seq", "ts", "latency_ms")
    return ordered.latest(rows, ["host"], ["ts", "seq"]).select("host", "seq", "latency_ms")


# --- I ----------------------------------------------------------------------------------------------
@query("I9_entity_pairs", """
WITH p AS (SELECT c_custkey AS pair_id, 'customer ' || right(c_name, 9) AS a,
  CASE WHEN c_custkey % 4 = 1 THEN 'supplier ' || right(c_name, 9)
       ELSE 'customer ' || right(c_name, 8) || 'x' END AS b, c_custkey % 4 = 3 AS same FROM customer),
s AS (SELECT *, CASE WHEN same THEN 1.0 ELSE round(1.0 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 4) END AS sc FROM p)
SELECT pair_id, CASE WHEN pair_id % 10 = 0 THEN false ELSE sc >= 0.85 END AS match,
  CASE WHEN pair_id % 10 = 0 THEN 0.25 ELSE sc END::DOUBLE AS confidence,
  CASE WHEN pair_id % 10 = 0 THEN 'checked' WHEN same THEN 'same handle' WHEN sc >= 0.85 THEN 'similar names' ELSE '' END AS reasoning
FROM s""")
def entity_pairs(t: Tables) -> DataFrame:
    pairs = t.customer.selectExpr(
        "c_custkey AS pair_id", "c_name AS name_a", "concat('@u', c_custkey) AS handle_a",
        "CASE WHEN c_custkey % 4 = 1 THEN replace(c_name, 'Customer', 'SUPPLIER') ELSE concat('customer ', right(c_name, 8), 'x') END AS name_b",
        "CASE WHEN c_custkey % 4 = 3 THEN concat('U', c_custkey) END AS handle_b",
    )
    hit = "CASE WHEN c_custkey % 10 = 0 THEN"
    verdicts = t.customer.selectExpr(
        "c_custkey AS pair_id", f"{hit} false END AS match", f"{hit} 0.25D END AS confidence", f"{hit} 'checked' END AS reasoning")
    out = entities.resolve_pairs(pairs, verdicts)
    return out.select("pair_id", "match", "confidence", "reasoning")


# Names of many kinds: page titles, the same with one character less, product names that repeat, numbered suppliers.
_TITLE = "regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^ -~]', '')"
_NAMED = [
    View("pages", entity_id="page_id * 4", name=_TITLE, handle="CASE WHEN page_id % 7 = 3 THEN concat('@Site', page_id % 50) END"),
    View("pages", entity_id="page_id * 4 + 1", handle="CAST(NULL AS STRING)",
         name=f"concat(substr({_TITLE}, 1, CAST(page_id % 9 AS INT)), substr({_TITLE}, CAST(page_id % 9 AS INT) + 2))"),
    View("part", entity_id="p_partkey * 4 + 2", name="p_name", handle="CAST(NULL AS STRING)"),
    View("supplier", entity_id="s_suppkey * 4 + 3", name="s_name", handle="CASE WHEN s_suppkey = 1 THEN 'site5' END"),
]
# DuckDB replaces the first match only, unless told otherwise.
_NAMED_SQL = " UNION ALL ".join(f"SELECT entity_id, name, handle FROM {v.sql}" for v in _NAMED).replace("'[^ -~]', ''", "'[^ -~]', '', 'g'")


@query("I9_similar_names", f"""
WITH RECURSIVE e AS (
  SELECT entity_id, nullif(trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '') AS name,
    nullif(lower(regexp_replace(handle, '^@+', '')), '') AS handle FROM ({_NAMED_SQL})),
d AS (SELECT DISTINCT name FROM e WHERE name IS NOT NULL),
links AS (SELECT a.name AS a, b.name AS b FROM d a JOIN d b ON a.name <> b.name
  AND 100 * levenshtein(a.name, b.name) <= 15 * greatest(length(a.name), length(b.name))),
edges AS (SELECT 'n:' || a AS a, 'n:' || b AS b FROM links
  UNION SELECT 'n:' || name, 'h:' || handle FROM e WHERE name IS NOT NULL AND handle IS NOT NULL
  UNION SELECT 'h:' || handle, 'n:' || name FROM e WHERE name IS NOT NULL AND handle IS NOT NULL),
nodes AS (SELECT entity_id, name, coalesce('n:' || name, 'h:' || handle) AS node FROM e),
reach(a, b) AS (SELECT DISTINCT node, node FROM nodes WHERE node IS NOT NULL UNION SELECT r.a, l.b FROM reach r JOIN edges l ON r.b = l.a),
least AS (SELECT a, min(n.entity_id) AS least FROM reach JOIN nodes n ON n.node = reach.b GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT entity_id, coalesce(least, entity_id) AS representative, coalesce(n, 0)::BIGINT AS n_links
FROM nodes LEFT JOIN least ON node = least.a LEFT JOIN counts ON name = counts.a""")
def similar_names(t: Tables) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [t.view(v) for v in _NAMED])
    return entities.resolve_entities(rows).select("entity_id", "representative", "n_links")


@query("I10_entity_table", """
SELECT s_suppkey, u.* FROM supplier, LATERAL (VALUES (0, s_name, 'organization', '@s' || s_suppkey, 0.5::DOUBLE),
  (1, 'Nation ' || s_nationkey, 'location', NULL, NULL)) u(pos, name, type, handle, confidence) WHERE s_suppkey % 4 <> 3""")
def entity_table(t: Tables) -> DataFrame:
    body = F.expr("""CASE s_suppkey % 4 WHEN 3 THEN '{"other": 1}' ELSE concat(
      CASE s_suppkey % 4 WHEN 0 THEN '{"entities":[' WHEN 1 THEN '[{"entities":[' ELSE '```json\n[' END,
      '{"name":"', s_name, '","type":"organization","handle":"@s', s_suppkey, '","confidence":0.5},{"name":"Nation ',
      s_nationkey, '","type":"location"}', CASE s_suppkey % 4 WHEN 0 THEN ']}' WHEN 1 THEN ']}]' ELSE ']\n```' END) END""")
    rows = entities.entity_table(t.supplier.select("s_suppkey", body.alias("body")), "s_suppkey")
    return rows.drop("url")




@query("I3_previous_baseline", f"""
SELECT seq, lag(seq) OVER (PARTITION BY host ORDER BY ts, seq) AS previous FROM {OUTCOMES.sql}""")
def previous_baseline(t: Tables) -> DataFrame:
    rows = t.view(OUTCOMES)
    out = ordered.with_last(rows, ["host"], ["ts", "seq"], F.col("seq"), "previous")
    return out.select("seq", "previous")


@query("I5_cache_hits_by_type", f"""
WITH q AS (SELECT * FROM {_REQUESTS.sql}), r AS (SELECT * FROM {_REQUESTS.sql} WHERE event_type = 'view')
SELECT q.event_type, count(*) AS requests, count(*) FILTER (epoch_us(q.ts) - epoch_us(r.ts) <= 3600000000) AS reused
FROM q ASOF LEFT JOIN r ON q.cache_key = r.cache_key AND q.ts >= r.ts GROUP BY q.event_type""")
def cache_hits(t: Tables) -> DataFrame:
    rows = t.view(_REQUESTS)
    stored = rows.filter("event_type = 'view'").selectExpr("cache_key", "ts", "concat('b', seq) AS body")
    hits = enrich.with_cached(rows, stored).select("seq", "reused")
    return rows.join(hits, "seq").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("reused"), 1)).alias("reused"))
