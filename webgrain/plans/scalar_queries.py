"""Registered queries over scalars and gates (D, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webgrain.functions import gates, scalars
from webgrain.operators.dom import parse_page
from webgrain.operators.selectors import Page
from webgrain.plans.page_queries import BODY_SQL, TITLE_SQL, pieces_sql
from webgrain.plans.registry import Tables, query


@query("D1_parse_engagement", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey * 1000 WHEN 1 THEN o_custkey * 1000000
  WHEN 2 THEN o_custkey * 1000000000 WHEN 3 THEN o_custkey WHEN 4 THEN NULL ELSE o_orderkey * 1000 + 500 END AS n
FROM orders""")
def parse_engagement(t: Tables) -> DataFrame:
    text = F.expr("""CASE o_orderkey % 6 WHEN 0 THEN concat(' ', o_custkey, 'K') WHEN 1 THEN concat(o_custkey, 'm ')
      WHEN 2 THEN concat(o_custkey, 'B') WHEN 3 THEN format_number(o_custkey, 0) WHEN 4 THEN concat(o_custkey, 'x')
      ELSE concat(o_orderkey, '.5k') END""")
    return t.orders.select("o_orderkey", scalars.parse_engagement(text).alias("n"))


@query("D2_clean_count_text", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || 'K' WHEN o_orderkey % 3 = 1 THEN o_custkey::VARCHAR END AS piece
FROM orders""")
def clean_count_text(t: Tables) -> DataFrame:
    text = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN concat('about ', o_custkey, 'K people')
      WHEN 1 THEN concat('(', o_custkey, ')') ELSE 'nobody yet' END""")
    return t.orders.select("o_orderkey", scalars.clean_count_text(text).alias("piece"))


@query("D3_count_words", """
SELECT o_orderkey, o_custkey AS instagram, o_custkey * 1000 AS x, o_custkey AS tiktok, o_custkey AS linkedin FROM orders""")
def count_words(t: Tables) -> DataFrame:
    def text(sql: str, family: str):
        return scalars.parse_count(F.expr(sql), family).alias(family)

    return t.orders.select(
        "o_orderkey", text("concat(o_custkey, ' Followers')", "instagram"),
        text("concat(o_custkey, 'K reposts')", "x"), text("concat('views ', o_custkey, '+')", "tiktok"),
        text("concat(o_custkey, '+ connections')", "linkedin"),
    )


@query("D4_parse_duration", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN l_partkey
  WHEN 1 THEN l_partkey * 60 + 7 WHEN 2 THEN 3600 + l_partkey * 60 + 9 END AS seconds FROM lineitem""")
def parse_duration(t: Tables) -> DataFrame:
    text = F.expr("""CASE l_linenumber % 4 WHEN 0 THEN concat(' ', l_partkey) WHEN 1 THEN concat(l_partkey, ':07')
      WHEN 2 THEN concat('1:', l_partkey, ':09') ELSE concat('1:2:3:', l_partkey) END""")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", scalars.parse_duration(text).alias("seconds"))


@query("D5_parse_timestamp", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 10 HOUR
  WHEN 2 THEN o_orderdate + INTERVAL 8 HOUR WHEN 3 THEN o_orderdate END AS at FROM orders""")
def parse_timestamp(t: Tables) -> DataFrame:
    text = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')
      WHEN 1 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00:00Z')
      WHEN 2 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00:00+02:00')
      WHEN 3 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE date_format(o_orderdate, 'dd/MM/yyyy') END""")
    return t.orders.select("o_orderkey", scalars.parse_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("D6_hashtags_mentions", """
SELECT doc_id, array_to_string(regexp_extract_all(text, '#[\\p{L}\\p{M}\\p{N}_]+'), ' ') AS tags,
  array_to_string(regexp_extract_all(text, '@[\\p{L}\\p{M}\\p{N}_]+'), ' ') AS mentions FROM documents""")
def hashtags(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.array_join(scalars.hashtags(F.col("text")), " ").alias("tags"),
        F.array_join(scalars.mentions(F.col("text")), " ").alias("mentions"),
    )


@query("D7_handles", """
SELECT c_custkey, 'c' || c_custkey AS handle, lower(replace(c_name, '#', '-#-')) AS slug FROM customer""")
def handles(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", scalars.clean_handle(F.expr("concat('@@c', c_custkey, '  posted')")).alias("handle"),
        scalars.name_slug(F.regexp_replace("c_name", "#", "  # \t")).alias("slug"),
    )


@query("D8_title_from_text", "SELECT doc_id, nullif(split_part(text, chr(10), 1), '') AS title FROM documents")
def title_from_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalars.first_line(F.col("text")).alias("title"))


@query("D9_presence", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS text_presence,
  CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS list_presence FROM orders""")
def presence(t: Tables) -> DataFrame:
    text = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN '  ' END")
    items = F.expr("IF(o_orderkey % 2 = 0, array('a'), array())")
    return t.orders.select(
        "o_orderkey", scalars.presence(text).alias("text_presence"),
        scalars.presence(items, "array").alias("list_presence"),
    )


@query("D11_cache_key", """
SELECT page_id, sha256(sha256(html) || ':' || sha256('title: string')) AS cache_key FROM pages""")
def cache_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", scalars.cache_key(F.col("html"), F.lit("title: string")).alias("cache_key"))


@query("D12_token_estimate", "SELECT doc_id, greatest(length(text) // 4, 1) AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalars.token_estimate(F.col("text")).alias("tokens"))


@query("D13_tolerant_json", """
SELECT event_id, CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
  event_id % 4 < 2 AS usable, event_id % 4 <> 2 AS is_json FROM events""")
def tolerant_json(t: Tables) -> DataFrame:
    body = F.expr("""CASE event_id % 4 WHEN 0 THEN concat(' ', props) WHEN 1 THEN concat('```json\n', props, '\n```')
      WHEN 2 THEN concat('Sure: ', props) ELSE concat('[', props, ']') END""")
    rows = t.events.select("event_id", scalars.tolerant_json(body).alias("v"),
                           scalars.tolerant_json(body, object_only=False).alias("any"))
    return rows.select(
        "event_id", scalars.json_text(F.col("v"), "$.k").alias("k"), F.col("v").isNotNull().alias("usable"),
        F.col("any").isNotNull().alias("is_json"),
    )


@query("D15_identifier", """
SELECT c_custkey, lower(replace(c_name, '#', '')) || '_x' AS identifier FROM customer""")
def identifier(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", scalars.identifier(F.concat(F.lit("-"), "c_name", F.lit(" X-!"))).alias("identifier"))


@query("D16_quoted_selectors", """
SELECT page_id, length(html) - length(replace(html, '<div class="ad">', '')) > 0 AS has_ad FROM pages""")
def quoted_selectors(t: Tables) -> DataFrame:
    selector = scalars.quote_selector("div[class=ad]")
    rows = t.spread("pages", "page_id").select("page_id", parse_page(F.col("html"), keep_tags=["div"]).alias("parsed"))
    return rows.select("page_id", (F.size(Page("parsed").select(selector)) > 0).alias("has_ad"))


@query("D17_whole_millis", """
SELECT event_id, round_even(value * 1000, 0)::INTEGER AS fetch, round_even(event_id + 0.5, 0)::INTEGER AS parse FROM events""")
def whole_millis(t: Tables) -> DataFrame:
    timings = F.expr("map('fetch', value * 1000, 'parse', CAST(event_id + 0.5D AS DOUBLE))")
    rows = t.events.select("event_id", scalars.whole_millis(timings).alias("m"))
    return rows.select("event_id", F.col("m")["fetch"].alias("fetch"), F.col("m")["parse"].alias("parse"))


# --- gates ---------------------------------------------------------------------------
def _phrase_sql(phrases: list[str], text: str) -> str:
    return " OR ".join("contains(" + text + ", '" + p.replace("'", "''") + "')" for p in phrases)


_WALLED = ("concat(html, CASE page_id % 4 WHEN 0 THEN '<p>Please LOG <i>in</i></p>' WHEN 1 THEN '<p>Friends only</p>' "
           "WHEN 2 THEN '<script>log in to</script>' ELSE '' END)")


def _visible_sql() -> str:
    markup = "regexp_replace(h, '<(script|style)>.*?</(script|style)>', '<x>', 'gs')"
    return f"lower({pieces_sql(markup)})"


@query("E1_is_public", f"""
WITH p AS (SELECT page_id, {_WALLED} AS h FROM pages), v AS (SELECT page_id, {_visible_sql()} AS t FROM p)
SELECT page_id, NOT ({_phrase_sql(gates.PRIVATE_PHRASES, 't')}) AS public,
  NOT ({_phrase_sql(gates.FACEBOOK_PRIVATE_PHRASES, 't')}) AS facebook_public,
  CASE WHEN {_phrase_sql(gates.PRIVATE_PHRASES, 't')} THEN 'SCR_021' END AS linkedin_code FROM v""")
def is_public(t: Tables) -> DataFrame:
    rows = t.spread("pages", "page_id").select("page_id", parse_page(F.expr(_WALLED), keep_tags=[]).alias("parsed"))
    rows = rows.select("page_id", Page("parsed").all_text().alias("text"))
    return rows.select(
        "page_id", gates.is_public(F.col("text")).alias("public"),
        gates.is_public(F.col("text"), "facebook").alias("facebook_public"),
        gates.wall_code(F.col("text"), "linkedin").alias("linkedin_code"),
    )


_STATUS = "CASE page_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 429 ELSE 200 END"
_BODY = ("CASE WHEN page_id % 7 = 0 THEN 'tiny' WHEN page_id % 7 = 1 THEN concat(html, 'Too Many Requests') "
         "WHEN page_id % 7 = 2 THEN concat(html, '<div class=\"g-ReCaptcha\">') ELSE html END")
_FINAL = "CASE WHEN page_id % 11 = 0 THEN concat(url, '/verify') ELSE url END"


def _first_sql(words: list[str], text: str) -> str:
    steps = " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in words)
    return f"CASE {steps} END"


_BLOCKING = _phrase_sql(gates.BLOCKING_PHRASES, "low")


@query("E2_challenge_reason", f"""
WITH p AS (SELECT page_id, {_STATUS} AS status, {_BODY} AS h, lower({_BODY}) AS low, {_FINAL} AS final FROM pages),
m AS (SELECT *, {_first_sql(gates.CHALLENGE_MARKERS, 'low')} AS marker FROM p)
SELECT page_id, CASE WHEN {_phrase_sql(["/captcha", "/challenge", "/verify", "/blocked", "cloudflare", "datadome", "perimeterx"], "lower(final)")}
    THEN 'Final URL looks like an interstitial: ' || final
  WHEN marker IS NOT NULL THEN 'Challenge marker found: ''' || marker || ''''
  WHEN length(trim(h)) < 200 THEN 'HTML body is unusually short'
  WHEN status IN (403, 429, 503) AND ({_BLOCKING}) THEN 'Blocking status code ' || status || ' with challenge language' END AS reason
FROM m""")
def challenge_reason(t: Tables) -> DataFrame:
    reason = gates.challenge_reason(F.expr(_BODY), F.expr(_FINAL), F.expr(_STATUS))
    return t.pages.select("page_id", reason.alias("reason"))


_INDICATORS = ", ".join(f"CASE WHEN contains(low, '{w}') THEN '{w}' END" for w in gates.BLOCK_INDICATORS)
_BLOCK_SQL = f"""
WITH p AS (SELECT page_id, {_STATUS} AS status, lower({_BODY}) AS low FROM pages),
i AS (SELECT page_id, status, list_filter([{_INDICATORS}], lambda x: x IS NOT NULL) AS hits FROM p),
b AS (SELECT page_id, status, array_to_string(hits, ',') AS indicators, coalesce(hits[1], 'status_code') AS reason,
  len(hits) > 0 OR status IN (403, 429, 503) AS blocked FROM i)"""


def _blocks(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.expr(_STATUS).alias("status"), gates.block_indicators(F.expr(_BODY)).alias("hits"))
    return rows.select(
        "page_id", "status", F.array_join("hits", ",").alias("indicators"),
        gates.block_reason(F.col("hits")).alias("reason"), gates.is_blocked(F.col("hits"), F.col("status")).alias("blocked"),
    )


@query("E3_block_page", _BLOCK_SQL + " SELECT page_id, indicators, reason, blocked FROM b")
def block_page(t: Tables) -> DataFrame:
    return _blocks(t).drop("status")


@query("E4_block_cause", _BLOCK_SQL + """, c AS (SELECT page_id, CASE
  WHEN status = 429 OR contains(reason, 'rate limit') OR contains(reason, 'too many') THEN 'rate_limited'
  WHEN contains(reason, 'captcha') OR contains(reason, 'verify') OR contains(reason, 'human') THEN 'captcha'
  WHEN contains(reason, 'cloudflare') OR contains(reason, 'ddos') OR contains(reason, 'perimeterx') THEN 'cdn_challenge'
  WHEN status = 403 OR contains(reason, 'blocked') OR contains(reason, 'denied') THEN 'forbidden' ELSE 'other' END AS cause
  FROM b WHERE blocked)
SELECT page_id, cause, CASE cause WHEN 'rate_limited' THEN 0.85 WHEN 'captcha' THEN 0.8 WHEN 'cdn_challenge' THEN 0.75
  WHEN 'forbidden' THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence FROM c""")
def block_cause(t: Tables) -> DataFrame:
    rows = _blocks(t).filter("blocked")
    return rows.select("page_id", gates.block_cause(F.col("reason"), F.col("status")).alias("c")).select("page_id", "c.*")


_CLASS_URL = ("CASE page_id % 6 WHEN 0 THEN concat('https://www.tiktok.com/video/', page_id) "
              "WHEN 1 THEN concat('https://shop.example.com/product/', page_id) WHEN 2 THEN concat('https://maxx.com/a', page_id) "
              "ELSE url END")
_CLASS_HTML = "CASE WHEN page_id % 4 = 0 THEN replace(html, '<head>', '<head><!-- schema.org JobPosting -->') ELSE html END"


def _hint_sql(hints: list, column: int, default: str) -> str:
    value = (lambda h: f"'{h[1]}'") if column == 1 else (lambda h: f"{h[2]}::DOUBLE")
    return "CASE " + " ".join(f"WHEN contains(u, '{h[0]}') THEN {value(h)}" for h in hints) + f" ELSE {default} END"


_CLASSIFY_SQL = f"""
WITH p AS (SELECT page_id, lower({_CLASS_URL}) AS u, {_CLASS_HTML} AS h, lower({_CLASS_HTML}) AS head FROM pages),
a AS (SELECT page_id, h, head, {_hint_sql(gates.PLATFORM_HINTS, 1, "'generic'")} AS platform,
  {_hint_sql(gates.PLATFORM_HINTS, 2, "0.0::DOUBLE")} AS pc, {_hint_sql(gates.CONTENT_HINTS, 1, "'article'")} AS k0,
  {_hint_sql(gates.CONTENT_HINTS, 2, "0.0::DOUBLE")} AS c0,
  contains(h, '"@type":') OR contains(head, 'schema.org') AS marked,
  CASE WHEN contains(head, 'product') THEN 'product' WHEN contains(head, 'jobposting') THEN 'job'
    WHEN contains(head, 'apartment') OR contains(head, 'residence') THEN 'real_estate' END AS sk,
  regexp_matches(head, '<title>[^<]*(apartment|villa|property|listing)') AS estate,
  regexp_matches(head, '<title>[^<]*quote') AS quote FROM p),
b AS (SELECT page_id, platform, pc, CASE WHEN estate THEN 'real_estate' WHEN quote THEN 'quote'
    WHEN marked THEN coalesce(sk, k0) ELSE k0 END AS content_type,
  greatest(CASE WHEN marked THEN greatest(c0, CASE WHEN sk IS NOT NULL THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END) ELSE c0 END,
    CASE WHEN estate OR quote THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END) AS cc FROM a),
h AS (SELECT page_id, platform, content_type, round((CASE WHEN pc > 0 AND cc > 0
  THEN least(0.95::DOUBLE, (pc + cc) / 2 + 0.1::DOUBLE) ELSE greatest(pc, cc) END)::VARCHAR::DECIMAL(20, 18), 2)::DOUBLE AS confidence FROM b)"""


@query("E5_content_classifier", _CLASSIFY_SQL + " SELECT * FROM h")
def content_classifier(t: Tables) -> DataFrame:
    c = gates.classify_content(F.expr(_CLASS_HTML), F.expr(_CLASS_URL))
    return t.pages.select("page_id", c.alias("c")).select("page_id", "c.*")


@query("E6_classifier_cascade", _CLASSIFY_SQL + """,
l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'article' ELSE 'page' END AS kind, 0.5 + 0.25 * toxic AS conf FROM labels)
SELECT page_id, CASE WHEN h.confidence < 0.8 AND conf >= h.confidence THEN 'labelled' ELSE h.platform END AS platform,
  CASE WHEN h.confidence < 0.8 AND conf >= h.confidence THEN kind ELSE h.content_type END AS content_type,
  CASE WHEN h.confidence < 0.8 AND conf >= h.confidence THEN conf::DOUBLE ELSE h.confidence END AS confidence
FROM h LEFT JOIN l ON page_id = doc_id""")
def classifier_cascade(t: Tables) -> DataFrame:
    external = t.labels.select(
        F.col("doc_id").alias("page_id"),
        F.struct(
            F.lit("labelled").alias("platform"),
            F.when(F.col("quality") == 1, "article").otherwise("page").alias("content_type"),
            (F.lit(0.5) + F.lit(0.25) * F.col("toxic")).alias("confidence"),
        ).alias("external"),
    )
    c = gates.classify_content(F.expr(_CLASS_HTML), F.expr(_CLASS_URL))
    rows = t.pages.select("page_id", c.alias("c")).join(external, "page_id", "left")
    return rows.select("page_id", gates.cascade(F.col("c"), F.col("external")).alias("c")).select("page_id", "c.*")


@query("E7_needs_enrichment", f"""
SELECT page_id, page_id % 3 <> 0 OR trim({TITLE_SQL}) = '' OR {BODY_SQL} = '' AS needed FROM pages""")
def needs_enrichment(t: Tables) -> DataFrame:
    from webgrain.operators import extract

    f = extract.basic_fields(Page("parsed"))
    author = F.expr("CASE page_id % 3 WHEN 0 THEN 'me' WHEN 1 THEN ' ' END")
    rows = t.spread("pages", "page_id").withColumn("parsed", parse_page(F.col("html"), keep_tags=extract.BASIC_TAGS))
    return rows.select("page_id", gates.needs_enrichment(f["text"], f["title"], author).alias("needed"))


@query("E8_external_label", """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN 'generic' ELSE 'generic' END AS platform,
  CASE turn % 3 WHEN 0 THEN 'page' WHEN 1 THEN role ELSE 'article' END AS content_type,
  CASE turn % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0.0 END::DOUBLE AS confidence FROM conversations""")
def external_label(t: Tables) -> DataFrame:
    body = F.expr("""CASE turn % 3 WHEN 0 THEN concat('{"platform":"', role, '","content_type":"page","confidence":0.5}')
      WHEN 1 THEN concat('[{"content_type":"', role, '","confidence":0.25}]') ELSE '"no idea"' END""")
    rows = t.conversations.select("conv_id", "turn", scalars.tolerant_json(body, object_only=False).alias("v"))
    return rows.select("conv_id", "turn", gates.external_label(F.col("v")).alias("l")).select("conv_id", "turn", "l.*")


