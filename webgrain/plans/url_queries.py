"""Registered queries over URLs (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webgrain.functions import urls
from webgrain.operators import links
from webgrain.operators.packs import BUILT_IN, SAMPLES
from webgrain.plans.registry import Tables, query
from webgrain.plans.views import PLATFORM_URLS, RAW_URLS

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("B1_normalize_url", f"""
SELECT page_id, CASE
    WHEN contains(url, '#') THEN url
    WHEN contains(url, 'utm_source') THEN replace(url, '?utm_source=feed', '') || '?b=1&b=2'
    WHEN contains(url, '?') THEN url || '&b=1&b=2'
    ELSE url || '?k=&q=a+b~c' END AS normalized
FROM {RAW_URLS.sql}""")
def normalize_url(t: Tables) -> DataFrame:
    return t.view(RAW_URLS).select("page_id", urls.normalize_url(F.col("raw")).alias("normalized"))


@query("B2_url_validity", """
SELECT o_orderkey, CASE o_orderkey % 5
    WHEN 0 THEN 'URL is empty' WHEN 1 THEN 'Unsupported URL scheme: ftp'
    WHEN 2 THEN 'Unsupported URL scheme: missing' WHEN 3 THEN 'URL is missing a host' END AS reject_reason
FROM orders""")
def url_validity(t: Tables) -> DataFrame:
    url = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN concat('ftp://h/', o_orderkey)
        WHEN 2 THEN concat('example.com/', o_orderkey) WHEN 3 THEN 'https://'
        ELSE concat('https://example.com/', o_orderkey) END""")
    return t.orders.select("o_orderkey", urls.reject_reason(url).alias("reject_reason"))


_PLATFORM = """CASE WHEN kind <= 2 THEN 'instagram' WHEN kind <= 4 THEN 'x' WHEN kind <= 6 THEN 'tiktok'
    WHEN kind <= 9 THEN 'linkedin' WHEN kind <= 11 THEN 'facebook' WHEN kind <= 14 THEN 'youtube' ELSE 'generic' END"""
_TYPE = """CASE kind WHEN 0 THEN 'post' WHEN 1 THEN 'reel' WHEN 2 THEN 'profile' WHEN 3 THEN 'post'
    WHEN 4 THEN 'profile' WHEN 5 THEN 'video' WHEN 6 THEN 'profile' WHEN 7 THEN 'post' WHEN 8 THEN 'profile'
    WHEN 9 THEN 'profile' WHEN 10 THEN 'post' WHEN 11 THEN 'profile' WHEN 12 THEN 'video' WHEN 13 THEN 'video'
    WHEN 14 THEN 'short' ELSE 'article' END"""


@query("B3_platform_match", f"SELECT page_id, {_PLATFORM} AS platform FROM {PLATFORM_URLS.sql}")
def platform_match(t: Tables) -> DataFrame:
    return t.view(PLATFORM_URLS).select("page_id", urls.platform_of(F.col("url")).alias("platform"))


@query("B4_content_type", f"SELECT page_id, {_TYPE} AS content_type FROM {PLATFORM_URLS.sql}")
def content_type(t: Tables) -> DataFrame:
    rows = t.view(PLATFORM_URLS).withColumn("platform", urls.platform_of(F.col("url")))
    return rows.select("page_id", urls.content_type_of(F.col("platform"), F.col("url")).alias("content_type"))


@query("B5_classify", f"""
SELECT {_PLATFORM} AS platform, {_TYPE} AS content_type, count(*) AS pages
FROM {PLATFORM_URLS.sql} GROUP BY 1, 2""")
def classify(t: Tables) -> DataFrame:
    rows = t.view(PLATFORM_URLS).select(urls.normalize_url(F.col("url")).alias("url"))
    rows = rows.withColumn("platform", urls.platform_of(F.col("url")))
    rows = rows.withColumn("content_type", urls.content_type_of(F.col("platform"), F.col("url")))
    return rows.groupBy("platform", "content_type").agg(F.count(F.lit(1)).alias("pages"))


@query("B6_domain_key", f"""
SELECT page_id, regexp_replace(h, '^www\\.', '') || ':8080' AS with_port, regexp_replace(h, '^www\\.', '') AS host
FROM (SELECT page_id, {_HOST} AS h FROM pages)""")
def domain_key(t: Tables) -> DataFrame:
    ported = F.regexp_replace("url", "^([a-z]+://[^/?#]*)", "$1:8080")
    return t.pages.select(
        "page_id", urls.domain_of(ported).alias("with_port"),
        urls.domain_of(ported, keep_port=False).alias("host"),
    )


@query("B7_pack_routing", f"""
SELECT page_id, CASE WHEN kind <= 2 THEN 'instagram' WHEN kind <= 4 THEN 'x_twitter' WHEN kind <= 6 THEN 'tiktok'
    WHEN kind <= 9 THEN 'linkedin' WHEN kind <= 11 THEN 'facebook' WHEN kind <= 14 THEN 'youtube' END AS pack
FROM {PLATFORM_URLS.sql}""")
def pack_routing(t: Tables) -> DataFrame:
    return t.view(PLATFORM_URLS).select(
        "page_id", links.route_to_pack(F.col("url"), [*BUILT_IN, *SAMPLES]).alias("pack")
    )


@query("B7_many_packs", f"""
SELECT page_id, CASE WHEN kind <= 2 THEN 'instagram' WHEN kind <= 4 THEN 'x_twitter' WHEN kind <= 6 THEN 'tiktok'
    WHEN kind <= 9 THEN 'linkedin' WHEN kind <= 11 THEN 'facebook' WHEN kind <= 14 THEN 'youtube' ELSE 'pack' || (page_id % 2000) END AS pack
FROM {PLATFORM_URLS.sql}""")
def many_packs(t: Tables) -> DataFrame:
    """The built-in packs, and one for each page's own section, as a table."""
    known = links.pack_patterns(t.spark, [*BUILT_IN, *SAMPLES])
    more = t.pages.selectExpr("1000 + page_id % 2000 AS priority", "concat('pack', page_id % 2000) AS pack",
                              "concat('https?://(?:www\\\\.)?section', page_id % 2000, '\\\\.example\\\\.org/[a-z]+') AS pattern").distinct()
    rows = t.view(PLATFORM_URLS).withColumn("url", F.expr(
        "CASE WHEN kind > 14 THEN concat('https://WWW.section', page_id % 2000, '.example.org/about/', page_id) ELSE url END"))
    return links.route_by_suffix(rows, known.unionByName(more)).select("page_id", "pack")


_LINKS = """SELECT o_orderkey AS seq, o_custkey % 20 AS query,
    CASE o_orderkey % 4 WHEN 0 THEN concat('https://www.youtube.com/', o_custkey)
      WHEN 1 THEN concat('ftp://f/', o_custkey)
      ELSE concat('https://s.example.com/', o_custkey) END AS url,
    concat('t', o_orderkey) AS title, '' AS snippet"""


@query("B8_link_cleanup", f"""
WITH l AS ({_LINKS} FROM orders),
f AS (SELECT query, url, min(seq) AS seq, arg_min(title, seq) AS title FROM l
      WHERE url LIKE 'https://s.%' GROUP BY query, url)
SELECT query, url, title, rank FROM (
  SELECT query, url, title, row_number() OVER (PARTITION BY query ORDER BY seq) - 1 AS rank FROM f)
WHERE rank < 10""")
def link_cleanup(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr(*[e.strip() for e in _split(_LINKS)])
    out = links.ranked_links(rows, top=10)
    return out.select("query", "url", "title", "rank")


def _split(select: str) -> list[str]:
    """Top-level items of a SELECT list."""
    items, depth, start = [], 0, len("SELECT ")
    for i, ch in enumerate(select):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(select[start:i])
            start = i + 1
    return [*items, select[start:]]


@query("B9_resolve_url", f"""
SELECT page_id, s || '://' || h || '/img/' || page_id || '.png' AS rooted,
  s || '://' || h || regexp_extract(p, '^(.*/)', 1) || 'x.html?a=1' AS relative,
  s || '://' || h || '/' || 'up.html' AS parent, s || '://cdn.example.com/a' AS network, NULL::VARCHAR AS blank
FROM (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, {_HOST} AS h, {_PATH} AS p FROM pages)""")
def resolve_url(t: Tables) -> DataFrame:
    r = lambda v: urls.resolve_url(F.col("url"), v)
    return t.pages.select(
        "page_id",
        r(F.concat(F.lit("/img/"), F.col("page_id"), F.lit(".png"))).alias("rooted"),
        r(F.lit(" x.html?a=1")).alias("relative"),
        r(F.lit("../../../../up.html")).alias("parent"),
        r(F.lit("//cdn.example.com/a")).alias("network"),
        r(F.lit("  ")).alias("blank"),
    )


@query("B10_query_param", """
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
  nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS source FROM pages""")
def query_param(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", urls.query_param(F.col("url"), "page").alias("page"),
        urls.query_param(F.col("url"), "utm_source").alias("source"),
    )


@query("B11_ids_from_urls", f"""
SELECT page_id, CASE WHEN kind = 3 THEN page_id::VARCHAR END AS tweet_id,
  CASE WHEN kind = 3 THEN 'u' || page_id END AS x_user,
  CASE WHEN kind = 2 THEN 'user' || page_id END AS instagram_user,
  CASE kind WHEN 12 THEN 'v' || page_id WHEN 13 THEN 'y' || page_id WHEN 14 THEN 's' || page_id END AS video_id,
  CASE kind WHEN 10 THEN page_id::VARCHAR WHEN 11 THEN 'g' || page_id END AS facebook_id
FROM {PLATFORM_URLS.sql}""")
def ids_from_urls(t: Tables) -> DataFrame:
    u, kind = F.col("url"), F.col("kind")
    return t.view(PLATFORM_URLS).select(
        "page_id", urls.tweet_id(u).alias("tweet_id"), urls.x_user(u).alias("x_user"),
        urls.instagram_user(u).alias("instagram_user"),
        F.when(kind.isin(12, 13, 14), urls.youtube_video_id(u)).alias("video_id"),
        F.when(kind.isin(10, 11), urls.facebook_post_id(u)).alias("facebook_id"),
    )


@query("B12_interstitial", """
SELECT page_id, page_id % 3 = 0 OR contains(lower(url), 'cloudflare') AS interstitial FROM pages""")
def interstitial(t: Tables) -> DataFrame:
    final = F.expr("CASE WHEN page_id % 3 = 0 THEN concat(url, '/Challenge') ELSE url END")
    return t.pages.select("page_id", urls.interstitial(final).alias("interstitial"))


@query("B13_adapter_page_type", f"""
SELECT page_id, CASE kind WHEN 0 THEN 'post' WHEN 1 THEN 'reel' WHEN 2 THEN 'profile' WHEN 3 THEN 'post'
  WHEN 4 THEN 'profile' WHEN 5 THEN 'video' WHEN 6 THEN 'profile' WHEN 7 THEN 'post' WHEN 8 THEN 'profile'
  WHEN 9 THEN 'company' WHEN 10 THEN 'post' WHEN 11 THEN 'profile' WHEN 12 THEN 'video' WHEN 13 THEN 'profile'
  WHEN 14 THEN 'short' END AS page_type
FROM {PLATFORM_URLS.sql}""")
def adapter_page_type(t: Tables) -> DataFrame:
    u, no = F.col("url"), F.lit(False)
    platform = urls.platform_of(u)
    kinds = (
        F.when(platform == "instagram", urls.instagram_page_type(u))
        .when(platform == "x", urls.x_page_type(u))
        .when(platform == "tiktok", urls.tiktok_page_type(u, no, no))
        .when(platform == "linkedin", urls.linkedin_page_type(u))
        .when(platform == "facebook", urls.facebook_page_type(u))
        .when(platform == "youtube", urls.youtube_page_type(u))
    )
    return t.view(PLATFORM_URLS).select("page_id", kinds.alias("page_type"))


@query("I8_uncovered_candidates", f"SELECT page_id, url FROM {PLATFORM_URLS.sql} WHERE kind = 15")
def uncovered(t: Tables) -> DataFrame:
    return links.uncovered(t.view(PLATFORM_URLS), BUILT_IN).select("page_id", "url")


@query("I6_blocked_links", f"""
SELECT page_id, kind < 15 AS blocked
FROM {PLATFORM_URLS.sql}""")
def blocked_links(t: Tables) -> DataFrame:
    return t.view(PLATFORM_URLS).select("page_id", (~links.usable_link(F.col("url"))).alias("blocked"))
