"""Registered queries over gates, redaction, robots rules and retention (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webgrain.functions import compliance
from webgrain.operators import retention
from webgrain.operators.dom import parse_page
from webgrain.operators.selectors import Page
from webgrain.plans.registry import Tables, View, query
from webgrain.session import work_folder

_ROBOTS = """CASE page_id % 5 WHEN 0 THEN '<meta name="robots" content="NOINDEX, nofollow">' WHEN 1 THEN '<meta name="robots" content="index">'
  WHEN 2 THEN '<meta name="robots" content="none">' ELSE '' END"""


@query("N1_noindex", "SELECT page_id, page_id % 5 IN (0, 2) AS skipped FROM pages")
def noindex(t: Tables) -> DataFrame:
    html = F.expr(f"replace(html, '<head>', concat('<head>', {_ROBOTS}))")
    html = F.when(F.col("html").contains("<head>"), html).otherwise(F.concat(F.expr(_ROBOTS), F.col("html")))
    rows = t.spread("pages", "page_id").withColumn("parsed", parse_page(html, keep_tags=["meta"]))
    robots = Page("parsed").first_attr("meta[name='robots']", "content")
    return rows.select("page_id", compliance.noindex(robots).alias("skipped"))


@query("N2_paywall", """
SELECT page_id, h IS NOT NULL AND (contains(lower(h), 'subscription') OR contains(lower(h), 'paywall')
  OR contains(lower(h), 'subscribe to read')) AS paywalled FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN html || '<p>Subscribe To Read</p>'
  WHEN 1 THEN html || '<i class="article__paywall">' WHEN 2 THEN NULL ELSE html END AS h FROM pages)""")
def paywall(t: Tables) -> DataFrame:
    html = F.expr("""CASE page_id % 6 WHEN 0 THEN concat(html, '<p>Subscribe To Read</p>')
      WHEN 1 THEN concat(html, '<i class="article__paywall">') WHEN 2 THEN NULL ELSE html END""")
    return t.pages.select("page_id", compliance.paywalled(html).alias("paywalled"))


def _redact_sql(text: str) -> str:
    for pattern, label in compliance.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{label}', 'g')"
    return text


@query("N2_paywall_markup", "SELECT page_id, page_id % 6 IN (0, 1, 4) AS paywalled FROM pages")
def paywall_markup(t: Tables) -> DataFrame:
    """The words in prose do not count, those in an attribute, an element or the metadata do."""
    html = F.expr("""CASE page_id % 6 WHEN 0 THEN concat(html, '<p> Subscribe To Read the rest</p>') WHEN 1 THEN concat(html, '<i class="article__paywall">')
      WHEN 2 THEN concat(html, '<p>A subscription, a paywall: you subscribe to read.</p>') WHEN 3 THEN NULL
      WHEN 4 THEN concat(html, '<script>{"isAccessibleForFree":false}</script>') ELSE html END""")
    return t.pages.select("page_id", compliance.paywall_markup(html).alias("paywalled"))


@query("N4_checked_numbers", """
SELECT c_custkey, 'c' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN ' card [CARD] end' WHEN 1 THEN ' card 4111 1111 1111 1112 end' WHEN 2 THEN ' iban [ACCOUNT] end'
  WHEN 3 THEN ' iban DE88 3704 0044 0532 0130 00 end' ELSE ' tel [PHONE] end' END AS clean FROM customer""")
def checked_numbers(t: Tables) -> DataFrame:
    text = F.expr("""concat('c', c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' card 4111 1111 1111 1111 end' WHEN 1 THEN ' card 4111 1111 1111 1112 end'
      WHEN 2 THEN ' iban DE89 3704 0044 0532 0130 00 end' WHEN 3 THEN ' iban DE88 3704 0044 0532 0130 00 end'
      ELSE concat(' tel +49 30 ', 100000 + c_custkey % 800000, ' end') END)""")
    return t.customer.select("c_custkey", compliance.redacted_numbers(text).alias("clean"))


@query("N4_redaction", f"""
SELECT doc_id, sha256({_redact_sql("text")}) AS digest,
  (length({_redact_sql("text")}) - length(replace(replace(replace({_redact_sql("text")}, '[EMAIL]', ''), '[ID]', ''), '[PHONE]', '')) > 0) AS touched
FROM documents""")
def redaction(t: Tables) -> DataFrame:
    clean = compliance.redacted(F.col("text"))
    return t.documents.select(
        "doc_id", F.sha2(clean, 256).alias("digest"), (compliance.redaction_count(F.col("text")) > 0).alias("touched"))


_STORED = View("events", id="event_id", url="concat('https://www.h', user_id % 9, '.org/', event_id)", created_at="ts")
_DOMAIN = "'h' || (user_id % 9) || '.org'"


@query("N5_domain_export", f"SELECT event_id AS id FROM events WHERE {_DOMAIN} = 'h3.org'")
def domain_export(t: Tables) -> DataFrame:
    return retention.of_domain(t.view(_STORED), "h3.org").select("id")


@query("N5_deletion_and_retention", """
SELECT event_id AS id FROM events WHERE user_id % 9 <> 3 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY""")
def deletion_and_retention(t: Tables) -> DataFrame:
    stored = t.view(_STORED)
    now = F.lit(stored.agg(F.max("created_at")).first()[0])
    kept = retention.without_domain(stored, "h3.org")
    path = work_folder(t.spark, "retained")
    retention.rewrite(retention.retained(kept, 10, now).select("id", "url"), path)
    return t.spark.read.parquet(path).select("id")


@query("N3_robots_rules", """
SELECT page_id, NOT (page_id % 4 = 1 OR (page_id % 4 = 2 AND page_id % 8 = 2)) AS allowed FROM pages""")
def robots_rules(t: Tables) -> DataFrame:
    pages = t.pages.selectExpr("page_id", """concat('https://www.s', page_id % 50, '.org/', CASE page_id % 4 WHEN 0 THEN 'open/a'
      WHEN 1 THEN 'private/x' WHEN 2 THEN IF(page_id % 8 = 2, 'private/deep/x', 'private/deep/ok/y') ELSE '' END) AS url""")
    rules = t.pages.selectExpr("explode(array(concat('s', page_id % 50, '.org'))) AS host").distinct().selectExpr(
        "host", "inline(array(named_struct('prefix', '/', 'allow', true), named_struct('prefix', '/private', 'allow', false), "
        "named_struct('prefix', '/private/deep/ok', 'allow', true)))")
    return retention.allowed_by_robots(pages, rules, key="page_id").select("page_id", "allowed")


@query("N3_robots_agents", """
SELECT page_id, NOT (page_id % 4 = 0 AND page_id % 6 < 2) AND NOT (page_id % 4 = 1 AND page_id % 6 = 3) AS allowed FROM pages""")
def robots_agents(t: Tables) -> DataFrame:
    """Four hosts: one with a group for the agent, one with a wildcard for all, one for others only, one without rules."""
    path = "CASE page_id % 6 WHEN 0 THEN '/private/a' WHEN 1 THEN '/private/b?x=1' WHEN 2 THEN '/private/open' WHEN 3 THEN '/docs/a.pdf' WHEN 4 THEN '/docs/a.pdf?v=2' ELSE '/' END"
    urls = t.pages.selectExpr("page_id", f"concat('https://www.h', page_id % 4, '.org', {path}) AS url")
    rules = t.region.selectExpr("""inline(CASE r_regionkey
      WHEN 0 THEN array(named_struct('host', 'h0.org', 'agent', 'GrainBot', 'pattern', '/private/', 'allow', false),
        named_struct('host', 'h0.org', 'agent', 'grainbot', 'pattern', '/private/o*n$', 'allow', true),
        named_struct('host', 'h0.org', 'agent', '*', 'pattern', '/', 'allow', false))
      WHEN 1 THEN array(named_struct('host', 'h1.org', 'agent', '*', 'pattern', '/*.pdf$', 'allow', false))
      WHEN 2 THEN array(named_struct('host', 'h2.org', 'agent', 'other', 'pattern', '/', 'allow', false)) END)""")
    return retention.robots_verdicts(urls, rules, "grainbot", key="page_id").select("page_id", "allowed")


@query("N6_least_delay", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS seconds FROM pages""")
def least_delay(t: Tables) -> DataFrame:
    from webgrain.operators.pacing import least_delay as least

    host = F.expr("CASE page_id % 4 WHEN 0 THEN 'de.linkedin.com' WHEN 1 THEN 'x.com' WHEN 2 THEN 'youtube.com' ELSE 'maxx.com' END")
    return t.pages.select("page_id", least(host).alias("seconds"))
