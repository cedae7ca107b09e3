"""Registered queries over HTML (C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webgrain.functions import scalars
from webgrain.operators import drift, extract
from webgrain.operators.dom import parse_page
from webgrain.operators.packs import BUILT_IN, FACEBOOK, HACKERNEWS, INSTAGRAM, LINKEDIN, QUOTES, TIKTOK, X, YOUTUBE
from webgrain.operators.rules import (
    Pack,
    PageRules,
    check_pack,
    extract_pack,
    extract_unified,
    pack_table,
    with_parsed,
)
from webgrain.operators.selectors import Page
from webgrain.plans.registry import Tables, query

# --- SQL fragments: page parts by regular expression ---------------------------
# The entities of the given pages; a title may end in a cut-off "&amp".
_PLAIN = "regexp_replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"
TITLE_SQL = _PLAIN.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's'))")


def pieces_sql(markup: str) -> str:
    """Text pieces of a markup string, trimmed, joined by a blank, entities decoded."""
    cut = f"regexp_replace({markup}, '<!--.*?-->|<[^>]*>', chr(1), 'gs')"
    return _PLAIN.format(
        f"array_to_string(list_filter(list_transform(string_split({cut}, chr(1)), "
        "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ')"
    )


BODY_SQL = pieces_sql("regexp_extract(html, '<body>(.*)$', 1, 's')")
ARTICLE_SQL = pieces_sql("regexp_extract(html, '<article>(.*)$', 1, 's')")


def parsed_pages(t: Tables, **options: object) -> DataFrame:
    """The given pages, parsed."""
    return t.spread("pages", "page_id").withColumn("parsed", parse_page(F.col("html"), **options))


def escaped(column: str) -> Column:
    """Text made safe for markup and attribute values."""
    out = F.col(column)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


@query("C1_parse_dom", """
SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<li>')) AS items,
  len(regexp_extract_all(html, '<p>')) - len(regexp_extract_all(html, '<script>[^<]*<p>')) AS paragraphs,
  len(regexp_extract_all(html, '<br>')) AS breaks, true AS readable FROM pages""")
def parse_dom(t: Tables) -> DataFrame:
    page = Page("parsed")
    count = lambda s: F.size(page.select(s)).cast("bigint")
    return parsed_pages(t, keep_tags=["a", "li", "p", "br"]).select(
        "page_id", count("a").alias("links"), count("li").alias("items"), count("p").alias("paragraphs"),
        count("br").alias("breaks"), F.col("parsed.parse_error").isNull().alias("readable"),
    )


@query("C2_basic_extract", f"""
SELECT page_id, {TITLE_SQL} AS title, {BODY_SQL} AS text, NULL::VARCHAR AS author, 0 AS images FROM pages""")
def basic_extract(t: Tables) -> DataFrame:
    f = extract.basic_fields(Page("parsed"))
    return parsed_pages(t, keep_tags=extract.BASIC_TAGS).select(
        "page_id", f["title"].alias("title"), f["text"].alias("text"), f["author"].alias("author"),
        F.size(f["media_urls"]).alias("images"),
    )


_DOC_TEXT = "regexp_replace(text, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')"


def document_pages(t: Tables) -> DataFrame:
    """Documents rendered as pages with Open Graph, JSON-LD, navigation and a main part."""
    html = F.concat(
        F.lit('<html><head><title>Doc</title><meta property="og:title" content=" Doc '), F.col("doc_id"),
        F.lit('"><meta property="og:site_name" content="'), escaped("source"),
        F.lit('"><meta property="og:description" content="'), escaped("text"),
        F.lit('"><meta property="og:image" content="https://i.example.com/'), F.col("doc_id"),
        F.lit('.png"></head><body><nav>menu</nav><main><header>top</header><p>'), escaped("text"),
        F.lit("</p><aside>side</aside></main><footer>foot</footer></body></html>"),
    )
    return t.spread("documents", "doc_id").select("doc_id", html.alias("html"))


@query("C3_open_graph", f"""
SELECT doc_id, 'Doc ' || doc_id AS title, {_DOC_TEXT} AS description,
  'https://i.example.com/' || doc_id || '.png' AS image, source AS site_name FROM documents""")
def open_graph(t: Tables) -> DataFrame:
    rows = document_pages(t).withColumn("parsed", parse_page(F.col("html"), keep_tags=["meta"]))
    f = extract.open_graph(Page("parsed"))
    return rows.select("doc_id", *[c.alias(n) for n, c in f.items()])


@query("C4_json_ld", """
SELECT o_orderkey, 'Order ' || o_orderkey AS title,
  CASE WHEN o_orderkey % 2 = 0 THEN 'C' || o_custkey ELSE 'List ' || o_custkey END AS author,
  strftime(o_orderdate, '%Y-%m-%d') AS published,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Shop' END AS site_name FROM orders""")
def json_ld(t: Tables) -> DataFrame:
    script = lambda body: f"<script type=\"application/ld+json\">{body}</script>"
    html = F.expr(f"""concat('{script("[1,2]")}{script("oops")}',
      '<script type="application/ld+json">{{"headline":"Order ', o_orderkey, '","datePublished":"2000-01-01","author":',
      if(o_orderkey % 2 = 0, concat('{{"name":"C', o_custkey, '"}}'), concat('[{{"name":"List ', o_custkey, '"}},{{"name":"z"}}]')),
      '}}</script><script type="application/ld+json">{{"headline":"later","datePublished":"',
      date_format(o_orderdate, 'yyyy-MM-dd'), '"',
      if(o_orderkey % 3 = 0, ',"publisher":{{"name":"Shop"}}', ',"publisher":"Shop"'), '}}</script>')""")
    rows = t.spread("orders", "o_orderkey").select("o_orderkey", parse_page(html, keep_tags=["script"]).alias("parsed"))
    rows = rows.select("o_orderkey", extract.json_ld(Page("parsed")).alias("ld"))
    return rows.select("o_orderkey", "ld.title.v", "ld.author.v", "ld.published.v", "ld.site_name.v").toDF(
        "o_orderkey", "title", "author", "published", "site_name"
    )


@query("C5_main_text", f"SELECT page_id, regexp_replace({ARTICLE_SQL}, '\\s+', ' ', 'g') AS text FROM "
       "(SELECT page_id, regexp_replace(html, '<footer>.*?(</footer>|$)', '', 's') AS html FROM pages)")
def main_text(t: Tables) -> DataFrame:
    return parsed_pages(t, keep_tags=extract.ARTICLE_TAGS).select(
        "page_id", extract.main_text(Page("parsed")).alias("text")
    )


@query("C6_selector_chain", f"""
SELECT page_id, {_PLAIN.format("trim(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'))")} AS heading,
  'article h1' AS selector_used, 2 AS pos FROM pages""")
def selector_chain(t: Tables) -> DataFrame:
    chain = Page("parsed").chain(["main h1", "article.post > h1", "article h1", "h1"])
    rows = parsed_pages(t).select("page_id", chain.alias("c"))
    return rows.select(
        "page_id", F.col("c.value").alias("heading"), F.col("c.selector").alias("selector_used"),
        F.col("c.pos").alias("pos"),
    )


@query("C7_attribute_chain", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'a' || o_orderkey
  ELSE 'b' || o_custkey END AS present,
  CASE WHEN o_orderkey % 3 = 1 THEN 'a' || o_orderkey ELSE 'b' || o_custkey END AS filled FROM orders""")
def attribute_chain(t: Tables) -> DataFrame:
    html = F.expr("""concat('<article', CASE o_orderkey % 3 WHEN 0 THEN ' data-id=""'
        WHEN 1 THEN concat(' data-id="a', o_orderkey, '"') ELSE '' END, '>x</article><div data-id="b', o_custkey, '">y</div>')""")
    rows = t.spread("orders", "o_orderkey").select("o_orderkey", parse_page(html).alias("parsed"))
    page, pairs = Page("parsed"), [("article", "data-id"), ("div[data-id]", "data-id")]
    return rows.select(
        "o_orderkey", page.attr_chain(pairs, non_empty=False)["value"].alias("present"),
        page.attr_chain(pairs, non_empty=True)["value"].alias("filled"),
    )


@query("C8_multi_value_select", f"""
SELECT page_id, array_to_string(regexp_extract_all(html, '<li><a href="([^"]*)"', 1), ' ') AS hrefs,
  {_PLAIN.format("array_to_string(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1), ' ')")} AS labels
FROM pages""")
def multi_value_select(t: Tables) -> DataFrame:
    page = Page("parsed")
    return parsed_pages(t, keep_tags=["nav", "li", "a"]).select(
        "page_id", F.array_join(page.values_of("nav li > a::attr(href)"), " ").alias("hrefs"),
        F.array_join(page.values_of("nav a::text"), " ").alias("labels"),
    )


@query("C9_text_lists", f"""
SELECT page_id, {_PLAIN.format("array_to_string(list_filter(list_transform(regexp_extract_all(html, '<div class=\"ad\">([^<]*)</div>', 1), lambda x: trim(x)), lambda x: x <> ''), '|')")} AS ads
FROM pages""")
def text_lists(t: Tables) -> DataFrame:
    return parsed_pages(t).select("page_id", F.array_join(Page("parsed").texts_of("div.ad, div.ads"), "|").alias("ads"))


@query("C17_fingerprint", """
SELECT page_id, true AS same_for_new_text, true AS same_for_new_values, false AS same_for_new_shape FROM pages""")
def fingerprint(t: Tables) -> DataFrame:
    fp = lambda c: drift.fingerprint(parse_page(c, keep_tags=[], skeleton=True)["skeleton"])
    html = F.col("html")
    rows = t.spread("pages", "page_id").select(
        "page_id", fp(html).alias("a"),
        fp(F.replace(html, F.lit("</title>"), F.lit(" more</title>"))).alias("b"),
        fp(F.replace(html, F.lit('class="ad"'), F.lit('class="other" id="x"'))).alias("c"),
        fp(F.replace(html, F.lit("<body>"), F.lit("<body><section></section>"))).alias("d"),
    )
    return rows.select(
        "page_id", (F.col("a") == F.col("b")).alias("same_for_new_text"),
        (F.col("a") == F.col("c")).alias("same_for_new_values"),
        (F.col("a") == F.col("d")).alias("same_for_new_shape"),
    )


@query("C17_skeleton", """
SELECT o_orderkey, sha256('[document][](div[class](' || repeat('p[](b[]())', o_custkey % 3) ||
  CASE WHEN o_orderkey % 2 = 0 THEN 'br[]()' ELSE '' END || CASE o_orderkey % 5 WHEN 0 THEN 'a[href]()' WHEN 1 THEN 'a[href,rel](img[alt,src]())' ELSE '' END || '))')
  AS fp FROM orders""")
def skeleton(t: Tables) -> DataFrame:
    """Pages of many shapes; the same shape has other texts, values and ids each time, which do not count."""
    # One paragraph after the other, so that none is left open.
    items = F.array_join(F.transform(F.expr("filter(sequence(0, 2), i -> i < o_custkey % 3)"),
                                     lambda i: F.concat(F.lit("<p>text <b>"), i, F.lit("</b></p>"))), "")
    page = F.concat(
        F.lit('<div class="c'), "o_custkey", F.lit('" id="'), "o_orderkey", F.lit('">'), "o_orderkey", items,
        F.when(F.col("o_orderkey") % 2 == 0, "<br>").otherwise(""),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('<a href="/'), "o_custkey", F.lit('">x</a>')))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit('<a href="/" rel=n><img src="'), "o_custkey", F.lit('.png" alt="y"></a>'))).otherwise(""),
        F.lit("</div>"))
    rows = t.spread("orders", "o_orderkey").select("o_orderkey", parse_page(page, keep_tags=[], skeleton=True)["skeleton"].alias("s"))
    return rows.select("o_orderkey", drift.fingerprint(F.col("s")).alias("fp"))


@query("C18_snapshot_of_varied_pages", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'body:body,date:time[datetime],heading:article h1' WHEN 1 THEN 'body:body'
  WHEN 2 THEN 'body:body,heading:main h1' ELSE 'body:body,heading:article h1' END AS matched FROM pages""")
def varied_snapshot(t: Tables) -> DataFrame:
    """The same chains where headings are elsewhere or missing, and where there is a date."""
    html = F.expr("""CASE page_id % 4 WHEN 0 THEN replace(html, '</article>', '<time datetime="2024-01-01">x</time></article>')
      WHEN 1 THEN replace(replace(html, '<h1>', '<h3>'), '</h1>', '</h3>') WHEN 2 THEN replace(html, '<article>', '<main><h1>M</h1></main><article>') ELSE html END""")
    page = Page("parsed")
    chains = {"heading": page.chain(["main h1", "article h1"]), "body": page.chain(["body"]), "date": page.chain(["time[datetime]"])}
    rows = t.spread("pages", "page_id").select("page_id", parse_page(html).alias("parsed")).select("page_id", extract.selector_snapshot(chains).alias("s"))
    pairs = F.transform(F.map_entries("s"), lambda e: F.concat(e.key, F.lit(":"), e.value.selector))
    return rows.select("page_id", F.array_join(F.array_sort(pairs), ",").alias("matched"))


@query("C18_selector_snapshot", """
SELECT page_id, 'body:body,heading:article h1' AS matched, 2 AS fields FROM pages""")
def snapshot(t: Tables) -> DataFrame:
    page = Page("parsed")
    chains = {
        "heading": page.chain(["main h1", "article h1"]), "body": page.chain(["body"]),
        "date": page.chain(["time[datetime]"]),
    }
    rows = parsed_pages(t).select("page_id", extract.selector_snapshot(chains).alias("s"))
    pairs = F.transform(F.map_entries("s"), lambda e: F.concat(e.key, F.lit(":"), e.value.selector))
    return rows.select(
        "page_id", F.array_join(F.array_sort(pairs), ",").alias("matched"), F.size("s").alias("fields")
    )


@query("C19_html_chunks", """
SELECT doc_id, length(text) AS chars, sha256(text) AS digest, true AS bounded,
  CASE WHEN length(text) <= 1000 THEN true END AS single FROM documents""")
def html_chunks(t: Tables) -> DataFrame:
    rows = t.spread("documents", "doc_id").select("doc_id", "text", extract.html_chunks(F.col("text"), 250).alias("c"))
    longest = F.aggregate("c", F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
    return rows.select(
        "doc_id", F.length(F.array_join("c", "")).cast("bigint").alias("chars"),
        F.sha2(F.array_join("c", ""), 256).alias("digest"), (longest <= 1000).alias("bounded"),
        F.when(F.length("text") <= 1000, F.size("c") == 1).alias("single"),
    )


@query("C20_page_size", "SELECT page_id, octet_length(encode(html)) AS bytes FROM pages")
def page_size(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.octet_length("html").cast("bigint").alias("bytes"))


@query("C21_link_attributes", """
SELECT page_id, regexp_extract(html, '<nav><ul><li><a href="([^"]*)"', 1) AS first_link FROM pages""")
def link_attributes(t: Tables) -> DataFrame:
    chain = Page("parsed").chain(["main a", "nav a"])
    return parsed_pages(t).select("page_id", chain["href"].alias("first_link"))


@query("C22_time_preference", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS stamp
FROM orders""")
def time_preference(t: Tables) -> DataFrame:
    html = F.expr("""CASE o_orderkey % 3
      WHEN 0 THEN concat('<time datetime=" ', date_format(o_orderdate, 'yyyy-MM-dd'), '">long ago</time>')
      WHEN 1 THEN concat('<span class="timestamp"> ', date_format(o_orderdate, 'yyyy-MM-dd'), '</span>')
      ELSE '<time>no attribute</time>' END""")
    rows = t.spread("orders", "o_orderkey").select("o_orderkey", parse_page(html).alias("parsed"))
    return rows.select("o_orderkey", Page("parsed").chain(["time", ".timestamp"])["stamp"].alias("stamp"))


@query("C23_next_page", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a:has-text("' || (p_size + 1) || '")'
   WHEN 1 THEN 'a[rel="next"]' ELSE 'button:has-text("Load more")' END AS selector,
  CASE p_partkey % 3 WHEN 0 THEN '/p/' || (p_size + 1) WHEN 1 THEN '/n' || p_partkey END AS href FROM part""")
def next_page(t: Tables) -> DataFrame:
    html = F.expr("""concat('<a href="/home">home</a>', CASE p_partkey % 3
      WHEN 0 THEN concat('<a href="/p/', p_size + 1, '"> ', p_size + 1, '</a>')
      WHEN 1 THEN concat('<a rel="next" href="/n', p_partkey, '">more</a>')
      ELSE '<button>LOAD more</button>' END)""")
    rows = t.spread("part", "p_partkey").select("p_partkey", "p_size", parse_page(html).alias("parsed"))
    rows = rows.select("p_partkey", extract.next_page(Page("parsed"), F.col("p_size")).alias("n"))
    return rows.select("p_partkey", "n.selector", "n.href")


# --- rule packs on pages rendered from tables --------------------------------------
def _rendered(df: DataFrame, key: str, url: str, html: str, platform: str = "x") -> DataFrame:
    rows = df.selectExpr(key, f"{url} AS url", f"{html} AS html", f"'{platform}' AS platform", "'http' AS strategy")
    return with_parsed(rows)


def _fields(rows: DataFrame, pack: Pack, kind: str, *names: str) -> DataFrame:
    return extract_pack(rows, pack, kind, fields=list(names))


_IG_POST = """concat('<meta property="og:image" content="https://i/', o_orderkey, '.jpg"><article class="_aatb x"><header>',
 '<a href="/u', o_custkey, '/">@u', o_custkey, ' verified</a></header><div class="_a9zs"><h1>Order #t', o_orderkey,
 ' by @m', o_custkey, '</h1></div><time datetime="', date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:30:00+02:00">x</time>',
 '<section><span>', format_number(o_custkey + 1000, 0), ' likes</span></section><a href="/p/1/comments/"><span>',
 o_custkey, ' comments</span></a><img src="https://i/', o_orderkey, '.jpg"><img src="https://j/1.jpg"><img src="/rel.jpg"></article>')"""


@query("C16_instagram_post", """
SELECT o_orderkey, 'u' || o_custkey AS author, 'Order #t' || o_orderkey || ' by @m' || o_custkey AS caption,
  '#t' || o_orderkey AS tags, '@m' || o_custkey AS mentions, o_custkey + 1000 AS likes,
  o_custkey AS comments, o_orderdate + INTERVAL 8 HOUR + INTERVAL 30 MINUTE AS posted_at,
  'https://i/' || o_orderkey || '.jpg https://j/1.jpg' AS media FROM orders""")
def instagram_post(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://www.instagram.com/p/', o_orderkey)", _IG_POST)
    return _fields(rows, INSTAGRAM, "post", "author_username", "caption", "tags", "mentions", "likes_count", "comments_count", "timestamp", "media_urls").select(
        "o_orderkey", F.col("fields.author_username").alias("author"), "fields.caption",
        F.array_join("fields.tags", " ").alias("tags"), F.array_join("fields.mentions", " ").alias("mentions"),
        F.col("fields.likes_count").alias("likes"), F.col("fields.comments_count").alias("comments"),
        F.col("fields.timestamp").cast("timestamp_ntz").alias("posted_at"),
        F.array_join("fields.media_urls", " ").alias("media"),
    )


@query("C12_profile_stats", """
SELECT c_custkey, c_custkey * 1000 AS followers, c_custkey % 7 AS following, c_nationkey::BIGINT AS posts FROM customer""")
def profile_stats(t: Tables) -> DataFrame:
    html = """concat('<header><h2>', c_name, '</h2><ul><li><span>', c_nationkey, '</span> posts</li><li><span>',
      c_custkey, 'K</span> followers</li><li><span>', c_custkey % 7, '</span> following</li></ul></header>')"""
    rows = _rendered(t.spread("customer", "c_custkey"), "c_custkey", "concat('https://instagram.com/c', c_custkey)", html)
    return _fields(rows, INSTAGRAM, "profile", "follower_count", "following_count", "posts_count").select(
        "c_custkey", F.col("fields.follower_count").alias("followers"),
        F.col("fields.following_count").alias("following"), F.col("fields.posts_count").alias("posts"),
    )


_TWEET = """concat('<a href="/u', o_custkey, '"><span class="tweet-author">u', o_custkey, '</span></a><div class="tweet-text">Hi #n',
 o_orderkey, '</div><time datetime="', date_format(o_orderdate, 'yyyy-MM-dd'), '">d</time><span class="like-count">',
 o_custkey, ' Likes</span><span class="share-count">', o_custkey, 'K reposts</span><span class="comment-count">none</span>')"""


@query("C16_x_post", """
SELECT o_orderkey, o_orderkey::VARCHAR AS tweet_id, 'https://x.com/u' || o_custkey || '/' AS author_url,
  o_custkey AS likes, o_custkey * 1000 AS shares, NULL::BIGINT AS comments, o_orderdate AS posted_at,
  '#n' || o_orderkey AS tags FROM orders""")
def x_post(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://x.com/u/status/', o_orderkey)", _TWEET)
    r = extract_unified(rows, [X]).select("o_orderkey", "record.*")
    return r.select(
        "o_orderkey", F.col("metadata")["tweet_id"].alias("tweet_id"), "author_url", "likes", "shares", "comments",
        F.col("timestamp").cast("timestamp_ntz").alias("posted_at"), F.array_join("tags", " ").alias("tags"),
    )


_TT_PROFILE = """concat('<main class="tt-profile-page"><h1 data-e2e="user-title">@c', c_custkey, '</h1><h2 class="tt-nickname">',
 c_name, '</h2><strong data-e2e="followers-count">', c_custkey, 'K</strong>',
 '<strong data-e2e="video-count">', c_nationkey, '</strong><div class="tt-video-item" data-video-id="v', c_custkey,
 '"><a href="/@c/video/', c_custkey, '"><img src="t.jpg"></a><span class="tt-video-views">', c_custkey, 'M</span></div>',
 '<div class="tt-video-card" data-id="w"><span class="view-count">450K views</span></div></main>')"""


@query("C10_nested_records", """
SELECT c_custkey, u.* FROM customer, LATERAL (VALUES
  (0, 'v' || c_custkey, '/@c/video/' || c_custkey, 't.jpg', c_custkey * 1000000),
  (1, 'w', NULL, NULL, NULL)) u(pos, video_id, link, thumbnail, views)""")
def nested_records(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("customer", "c_custkey"), "c_custkey", "concat('https://www.tiktok.com/@c', c_custkey)", _TT_PROFILE)
    items = _fields(rows, TIKTOK, "profile", "recent_videos").select("c_custkey", F.posexplode("fields.recent_videos").alias("pos", "v"))
    return items.select(
        "c_custkey", "pos", "v.video_id", F.col("v.url").alias("link"),
        F.col("v.thumbnail_url").alias("thumbnail"), "v.views",
    )


@query("C15_completeness", """
SELECT c_custkey, 'c' || c_custkey AS author, c_custkey * 1000 AS followers, c_nationkey::BIGINT AS videos, 1 AS warnings,
  'Used fallback selector .tt-nickname for display_name — primary selector may need updating.' AS warning,
  3 AS missing FROM customer""")
def completeness(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("customer", "c_custkey"), "c_custkey", "concat('https://www.tiktok.com/@c', c_custkey)", _TT_PROFILE)
    return _fields(rows, TIKTOK, "profile", "username", "follower_count", "video_count", "warnings", "partial_reasons").select(
        "c_custkey", F.col("fields.username").alias("author"), F.col("fields.follower_count").alias("followers"),
        F.col("fields.video_count").alias("videos"), F.size("fields.warnings").alias("warnings"),
        F.get("fields.warnings", F.lit(0)).alias("warning"), F.size("fields.partial_reasons").alias("missing"),
    )


_TT_VIDEO = """concat('<article data-video-id="', o_orderkey, '"><h1 data-e2e="browse-video-desc">Look #tag', o_custkey,
 '</h1><span class="author-name">@a', o_custkey, '</span><span class="tt-views">', o_custkey, 'K views</span>',
 '<strong data-e2e="like-count">', o_custkey, '+</strong><time class="timestamp">', date_format(o_orderdate, 'yyyy-MM-dd'),
 '</time><video class="post-media" src="https://v/', o_orderkey, '.mp4" poster="p.jpg" data-duration="',
 o_custkey % 60, ':05"></video></article>')"""


@query("C16_tiktok_video", """
SELECT o_orderkey, o_orderkey::VARCHAR AS video_id, 'https://www.tiktok.com/@a' || o_custkey AS author_url,
  o_custkey * 1000 AS views, o_custkey AS likes, (o_custkey % 60) * 60 + 5 AS duration,
  'https://v/' || o_orderkey || '.mp4' AS video_url, o_orderdate AS posted_at, '#tag' || o_custkey AS tags FROM orders""")
def tiktok_video(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://www.tiktok.com/@a/video/', o_orderkey)", _TT_VIDEO)
    return _fields(rows, TIKTOK, "video", "video_id", "author_url", "play_count", "like_count", "duration", "video_url", "timestamp", "hashtags").select(
        "o_orderkey", "fields.video_id", "fields.author_url", F.col("fields.play_count").alias("views"),
        F.col("fields.like_count").alias("likes"), "fields.duration", "fields.video_url",
        F.col("fields.timestamp").cast("timestamp_ntz").alias("posted_at"), F.array_join("fields.hashtags", " ").alias("tags"),
    )


_LI_POST = """concat('<article data-urn="urn:', o_orderkey, '"><span class="li-name">Ann  B', o_custkey,
 '</span><div class="li-content"><p>Text ', o_orderkey, '</p></div><time datetime="', date_format(o_orderdate, 'yyyy-MM-dd'),
 'T00:00:00Z">1d</time><span class="li-reactions">', o_custkey, ' reactions</span><span class="comment-count">',
 o_custkey, '+ comments</span></article>')"""


@query("C16_linkedin_post", """
SELECT o_orderkey, 'urn:' || o_orderkey AS id, 'https://www.linkedin.com/in/ann-b' || o_custkey || '/' AS author_url,
  'Text ' || o_orderkey AS text, o_custkey AS likes, o_custkey AS comments, NULL::BIGINT AS shares,
  o_orderdate AS posted_at FROM orders""")
def linkedin_post(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://www.linkedin.com/posts/', o_orderkey)", _LI_POST)
    return _fields(rows, LINKEDIN, "post", "id", "author_url", "text", "reaction_count", "comment_count", "repost_count", "timestamp").select(
        "o_orderkey", "fields.id", "fields.author_url", "fields.text", F.col("fields.reaction_count").alias("likes"),
        F.col("fields.comment_count").alias("comments"), F.col("fields.repost_count").alias("shares"),
        F.col("fields.timestamp").cast("timestamp_ntz").alias("posted_at"),
    )


@query("C16_linkedin_company", """
SELECT s_suppkey, s_name AS title, s_suppkey * 100 AS likes, 'A B' || s_nationkey AS tags,
  'https://s' || s_suppkey || '.example.com' AS website FROM supplier""")
def linkedin_company(t: Tables) -> DataFrame:
    html = """concat('<h1>', s_name, '</h1><span class="company-follower-count">', format_number(s_suppkey * 100, 0),
      ' followers</span><div class="company-website"><a href="https://s', s_suppkey, '.example.com">site</a></div>',
      '<ul class="company-specialties"><li>A</li><li> </li><li>B', s_nationkey, '</li></ul>')"""
    rows = _rendered(t.spread("supplier", "s_suppkey"), "s_suppkey", "concat('https://www.linkedin.com/company/', s_suppkey)", html)
    return _fields(rows, LINKEDIN, "company", "name", "follower_count", "specialties", "website").select(
        "s_suppkey", F.col("fields.name").alias("title"), F.col("fields.follower_count").alias("likes"),
        F.array_join("fields.specialties", " ").alias("tags"), "fields.website",
    )


_FB_POST = """concat('<article class="fb-story" data-story-id="', o_orderkey, '"><a class="fb-author-link" href="/g', o_custkey,
 '"><span class="fb-author author-name">G ', o_custkey, '</span></a><div class="fb-user-content post-caption"><p>Line ',
 o_orderkey, '\\nsecond</p></div><div class="fb-media"><img src="m/', o_orderkey, '.jpg"></div><span class="fb-reaction-like">',
 o_custkey, '</span><span class="fb-reaction-wow">', o_custkey, 'K</span><span class="fb-reaction-count like-count">about ',
 o_custkey, 'K reactions</span><span class="fb-share-count">', o_custkey, ' shares</span><time datetime="',
 date_format(o_orderdate, 'yyyy-MM-dd'), '">d</time></article>')"""


@query("C13_reactions", """
SELECT o_orderkey, u.* FROM orders, LATERAL (VALUES ('like', o_custkey), ('love', NULL), ('wow', o_custkey * 1000),
  ('haha', NULL), ('sad', NULL), ('angry', NULL)) u(reaction, n)""")
def reactions(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://www.facebook.com/g/posts/', o_orderkey)", _FB_POST)
    return _fields(rows, FACEBOOK, "post", "reactions_breakdown").select(
        "o_orderkey", F.explode("fields.reactions_breakdown").alias("reaction", "n")
    )


@query("C11_media_urls", """
SELECT o_orderkey, 'https://www.facebook.com/g/posts/m/' || o_orderkey || '.jpg' AS media,
  'https://www.facebook.com/g' || o_custkey AS author_url FROM orders""")
def media_urls(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://www.facebook.com/g/posts/', o_orderkey)", _FB_POST)
    return _fields(rows, FACEBOOK, "post", "media_urls", "author_url").select(
        "o_orderkey", F.array_join("fields.media_urls", " ").alias("media"), "fields.author_url"
    )


@query("C16_facebook_post", """
SELECT o_orderkey, 'Line ' || o_orderkey AS title, o_custkey * 1000 AS likes, o_custkey AS shares,
  NULL::BIGINT AS comments, 'G ' || o_custkey AS author, o_orderdate AS posted_at FROM orders""")
def facebook_post(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://www.facebook.com/g/posts/', o_orderkey)", _FB_POST, "facebook")
    r = extract_unified(rows, [FACEBOOK]).select("o_orderkey", "record.*")
    return r.select(
        "o_orderkey", "title", "likes", "shares", "comments", "author",
        F.col("timestamp").cast("timestamp_ntz").alias("posted_at"),
    )


_YT = """concat('<meta property="og:image" content="/thumb', o_orderkey, '.jpg"><article class="yt-video" data-video-id="d',
 o_orderkey, '"><h1 class="yt-video-title">V ', o_orderkey, '</h1><video src="https://v/', o_orderkey, '.mp4"></video>',
 '<span class="yt-view-count">', o_custkey, 'K views</span><span class="yt-comment-count">', o_custkey, ' comments</span>',
 '<a class="yt-channel-link" href="/@c', o_custkey, '"><b class="yt-channel-name">C ', o_custkey, '</b></a>',
 '<div class="yt-tags"><a class="tag">#a</a><a class="tag"></a></div><div class="yt-transcript">',
 '<p class="yt-transcript-segment" data-start="0">hello</p></div>',
 if(o_orderkey % 2 = 0, '<p class="yt-comments-disabled">Comments are turned off</p>', ''), '</article>')"""


@query("C14_comments_disabled", """
SELECT o_orderkey, o_orderkey % 2 = 0 AS disabled, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS comments FROM orders""")
def comments_disabled(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://www.youtube.com/watch?v=', o_orderkey)", _YT)
    return _fields(rows, YOUTUBE, "video", "comments_disabled", "comment_count").select(
        "o_orderkey", F.col("fields.comments_disabled").alias("disabled"), F.col("fields.comment_count").alias("comments")
    )


@query("C16_youtube_video", """
SELECT o_orderkey, 'd' || o_orderkey AS id, 'V ' || o_orderkey AS title, o_custkey * 1000 AS views,
  'https://www.youtube.com/@c' || o_custkey AS channel_url, '#a' AS tags, '0:hello' AS transcript,
  'https://www.youtube.com/thumb' || o_orderkey || '.jpg' AS thumbnail FROM orders""")
def youtube_video(t: Tables) -> DataFrame:
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://www.youtube.com/watch?v=', o_orderkey)", _YT)
    segments = F.transform("fields.transcript_segments", lambda s: F.concat(s.start, F.lit(":"), s.text))
    return _fields(rows, YOUTUBE, "video", "transcript_segments", "id", "title", "view_count", "channel_url", "tags", "thumbnail_url").select(
        "o_orderkey", "fields.id", "fields.title", F.col("fields.view_count").alias("views"), "fields.channel_url",
        F.array_join("fields.tags", " ").alias("tags"), F.array_join(segments, " ").alias("transcript"),
        F.col("fields.thumbnail_url").alias("thumbnail"),
    )


@query("C16_sample_packs", """
SELECT o_orderkey, 'T ' || o_orderkey AS title, o_custkey AS likes, 'q' || o_custkey || '|q2' AS quotes,
  '/tag/' || o_custkey AS tags FROM orders""")
def sample_packs(t: Tables) -> DataFrame:
    html = """concat('<div class="athing"><span class="titleline"><a>T ', o_orderkey, '</a></span></div><span class="score">',
      o_custkey, ' points</span><span class="text" itemprop="text">q', o_custkey,
      '</span><span class="text" itemprop="text">q2</span><p class="tags"><a class="tag" href="/tag/', o_custkey, '">x</a></p>')"""
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://news.ycombinator.com/item?id=', o_orderkey)", html)
    both = _fields(rows.withColumn("again", F.col("parsed")), HACKERNEWS, "post", "title", "score").withColumnRenamed("fields", "hn")
    both = _fields(both.withColumnRenamed("again", "parsed"), QUOTES, "post", "quote_text", "tags")
    return both.select(
        "o_orderkey", "hn.title", F.col("hn.score").alias("likes"),
        F.array_join("fields.quote_text", "|").alias("quotes"), F.array_join("fields.tags", " ").alias("tags"),
    )


@query("C16_instagram_reel", """
SELECT o_orderkey, 'u' || o_custkey AS author, o_custkey * 1000 AS views, o_custkey * 1000 AS first_span, 'Song' AS audio
FROM orders""")
def instagram_reel(t: Tables) -> DataFrame:
    html = """concat('<meta property="og:title" content=" Song "><header><a href="/u">u', o_custkey, '</a></header><section>',
      '<span class="_aacl">', o_custkey, 'K views</span><span class="_aacl">7 likes</span></section>')"""
    rows = _rendered(t.spread("orders", "o_orderkey"), "o_orderkey", "concat('https://instagram.com/reel/', o_orderkey)", html)
    return _fields(rows, INSTAGRAM, "reel", "author_username", "views_count", "likes_count", "audio_attribution").select(
        "o_orderkey", F.col("fields.author_username").alias("author"), F.col("fields.views_count").alias("views"),
        F.col("fields.likes_count").alias("first_span"), F.col("fields.audio_attribution").alias("audio"),
    )


@query("C16_x_profile", """
SELECT c_custkey, c_name AS display_name, '@c' || c_custkey AS username, c_mktsegment AS bio, 'https://c' || c_custkey || '.org' AS website,
  c_custkey || ' followers' AS follower_count, 'one|two' AS recent FROM customer""")
def x_profile(t: Tables) -> DataFrame:
    html = """concat('<h1>', c_name, '</h1><h2 class="profile-username">@c', c_custkey, '</h2><meta property="og:description" content="',
      c_mktsegment, '"><a href="/in">in</a><a href="https://c', c_custkey, '.org">w</a><b class="follower-count">', c_custkey,
      ' followers</b><div class="recent-tweets"><p class="tweet-text">one</p><p class="tweet-text"> </p><p class="tweet-text">two</p></div>',
      '<p class="tweet-text">outside</p>')"""
    rows = _rendered(t.spread("customer", "c_custkey"), "c_custkey", "concat('https://x.com/c', c_custkey)", html)
    return _fields(rows, X, "profile", "display_name", "username", "bio", "website", "follower_count", "recent_tweets").select(
        "c_custkey", "fields.display_name", "fields.username", "fields.bio", "fields.website", "fields.follower_count",
        F.array_join("fields.recent_tweets", "|").alias("recent"),
    )


@query("C16_linkedin_profile", """
SELECT c_custkey, c_name AS full_name, c_mktsegment AS headline, c_custkey AS connections, 1 AS warnings, 4 AS missing FROM customer""")
def linkedin_profile(t: Tables) -> DataFrame:
    html = """concat('<h1 class="top-card-layout__title">', c_name, '</h1><p class="top-card-layout__headline">', c_mktsegment,
      '</p><p class="profile-connections">', c_custkey, '+ connections</p>')"""
    rows = _rendered(t.spread("customer", "c_custkey"), "c_custkey", "concat('https://www.linkedin.com/in/c', c_custkey)", html)
    return _fields(rows, LINKEDIN, "profile", "name", "headline", "connections_count", "warnings", "partial_reasons").select(
        "c_custkey", F.col("fields.name").alias("full_name"), "fields.headline",
        F.col("fields.connections_count").alias("connections"), F.size("fields.warnings").alias("warnings"),
        F.size("fields.partial_reasons").alias("missing"),
    )


@query("C16_facebook_page", """
SELECT s_suppkey, s_name AS title, s_suppkey * 1000 AS likes, s_suppkey AS followers,
  'https://www.facebook.com/site' || s_suppkey AS website, 'p' || s_suppkey || ':hello' AS recent, s_suppkey % 2 = 0 AS is_public FROM supplier""")
def facebook_page(t: Tables) -> DataFrame:
    html = """concat('<div data-page-id="1"><h1>', s_name, '</h1></div><div class="fb-page-counts"><b data-field="likes">', s_suppkey,
      'K people like this</b><b data-field="followers">', s_suppkey, ' follow</b></div><div class="fb-page-about"><a href="/site', s_suppkey,
      '">s</a></div><div class="fb-recent-posts"><div class="fb-post-preview" data-post-id="p', s_suppkey,
      '"><p class="fb-post-preview-text">hello</p></div></div>', if(s_suppkey % 2 = 0, '', '<p>Friends only</p>'))"""
    rows = _rendered(t.spread("supplier", "s_suppkey"), "s_suppkey", "concat('https://www.facebook.com/s', s_suppkey)", html)
    posts = F.transform("fields.recent_posts", lambda p: F.concat(p.post_id, F.lit(":"), p.text))
    return _fields(rows, FACEBOOK, "profile", "recent_posts", "name", "likes_count", "followers_count", "website", "is_public").select(
        "s_suppkey", F.col("fields.name").alias("title"), F.col("fields.likes_count").alias("likes"),
        F.col("fields.followers_count").alias("followers"), "fields.website", F.array_join(posts, " ").alias("recent"), "fields.is_public",
    )


@query("C16_youtube_channel", """
SELECT s_suppkey, s_name AS title, s_suppkey * 1000 AS subscribers, 'UC' || s_suppkey AS channel_id, 'About ' || s_nationkey AS about,
  'v' || s_suppkey || ':One:' || s_suppkey * 1000000 AS recent FROM supplier""")
def youtube_channel(t: Tables) -> DataFrame:
    html = """concat('<h1 class="yt-channel-name">', s_name, '</h1><meta name="description" content="About ', s_nationkey,
      '"><b class="yt-subscriber-count">', s_suppkey, 'K subscribers</b><i class="yt-channel-id" data-channel-id="UC', s_suppkey,
      '"></i><div class="yt-recent-videos"><div class="yt-video-item" data-video-id="v', s_suppkey,
      '"><b class="yt-video-item-title">One</b><i class="yt-video-item-views">', s_suppkey, 'M views</i></div></div>')"""
    rows = _rendered(t.spread("supplier", "s_suppkey"), "s_suppkey", "concat('https://www.youtube.com/@s', s_suppkey)", html)
    videos = F.transform("fields.recent_videos", lambda v: F.concat_ws(":", v.video_id, v.title, v.view_count))
    return _fields(rows, YOUTUBE, "profile", "recent_videos", "name", "subscriber_count", "channel_id", "description").select(
        "s_suppkey", F.col("fields.name").alias("title"), F.col("fields.subscriber_count").alias("subscribers"),
        "fields.channel_id", F.col("fields.description").alias("about"), F.array_join(videos, " ").alias("recent"),
    )


@query("L1_custom_pack", """
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def custom_pack(t: Tables) -> DataFrame:
    pack = Pack(
        name="example_pages", platforms=["example"], url_patterns=["https?://.*\\.example\\.(com|org|net)/.*"],
        page_type=lambda page: F.lit("article"),
        pages={"article": PageRules(
            {"heading": ["article h1"]},
            lambda page, chains: {"lang": page.first_attr("html", "lang"), "heading": chains.heading.value},
            lambda page, values: {"title": values.heading, "lang": values.lang},
        )},
    )
    check_pack(pack)
    return extract_pack(with_parsed(t.spread("pages", "page_id")), pack, "article", fields=["lang"]).select("page_id", "fields.lang")


@query("D10_critical_hash", """
SELECT doc_id, sha256('Doc' || '|' || source || '|' || text) AS digest FROM documents""")
def critical_hash(t: Tables) -> DataFrame:
    digest = scalars.critical_hash(title=F.lit("Doc"), author=F.col("source"), text=F.col("text"))
    return t.documents.select("doc_id", digest.alias("digest"))
