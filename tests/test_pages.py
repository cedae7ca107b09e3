"""Parser, selectors, field rules and packs on small pages."""

import pytest
from pyspark.sql import functions as F

from webgrain.operators import drift, extract, rules
from webgrain.operators.dom import parse_page
from webgrain.operators.packs import BUILT_IN, FACEBOOK, INSTAGRAM, LINKEDIN, QUOTES, TIKTOK, X, YOUTUBE
from webgrain.operators.selectors import Page, tags_named


def parsed(spark, *pages, **options):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return rows.withColumn("parsed", parse_page(F.col("html"), **options)).orderBy("i")


def read(spark, html, column):
    return parsed(spark, html).select(column.alias("out")).first().out


def test_tree_rules(spark):
    html = ("<!DOCTYPE html><p>a<p>b &amp; c<br>d</br><!-- no --><script>if (a<b) x()</script>"
            "<style>p{}</style></ul><img src=x>e</p>f<i/>g")
    row = parsed(spark, html).first().parsed
    assert row.texts == ["a", "b & c", "d", "e", "f", "g"]
    tags = {n.id: n for n in row.dom}
    assert [n.tag for n in row.dom] == ["p", "p", "br", "script", "style", "img", "i"]
    assert tags[1].parent == 0 and tags[0].last == 6 and tags[1].last == 5
    assert tags[3].raw == "if (a<b) x()" and row.parse_error is None


def test_deep_nesting_stays_linear(spark):
    row = parsed(spark, "<b>x" * 5000).selectExpr("size(parsed.dom) AS n", "parsed.dom[0].last AS last").first()
    assert (row.n, row.last) == (5000, 4999)


@pytest.mark.parametrize("selector, ids", [
    ("li", ["1", "2", "3"]), ("ul li", ["1", "2", "3"]), ("nav > ul > li", ["1", "2"]), ("ul.big li", ["1", "2"]),
    ("li.a", ["1", "3"]), ("[data-x]", ["2"]), ("li[data-x='7']", ["2"]), ("[class*='a b']", ["1"]),
    ("[id^='3']", ["3"]), ("ul.big > li.a, [data-x]", ["1", "2"]), ("nav li, ol li, div .a", ["1", "2", "3"]),
    ('li:has-text("TWO")', ["2"]), ("ol li", []), ("main ul", []),
])
def test_selectors(spark, selector, ids):
    html = ("<nav><ul class='big top'><li class='a  b' id=1>one</li><li data-x=7 id=2>two</li></ul></nav>"
            "<div><ul><li class=a id=3>three</li></ul></div>")
    found = F.transform(Page("parsed").select(selector), lambda n: n.attrs["id"])
    assert read(spark, html, found) == ids


def test_chain(spark):
    html = "<h1> Ti<b>tle</b> </h1><meta property='og:title' content=' X '><time datetime='2025'>d</time>"
    page = Page("parsed")
    assert read(spark, html, page.chain(["h2", "h1"])).asDict() == {
        "value": "Title", "stamp": "Title", "href": None, "selector": "h1", "pos": 1}
    assert read(spark, html, page.chain(["h3"])) is None
    assert read(spark, html, page.chain(["meta[property='og:title']"])).value == ""
    assert read(spark, html, page.chain(["time"])).stamp == "2025"
    assert read(spark, html, page.meta("og:title")) == "X"
    assert tags_named(["nav li a", "meta[x]"]) == ["a", "li", "meta", "nav"] and tags_named([".x"]) is None


def test_generic_fields(spark):
    html = """<head><title>T</title><script type="application/ld+json">{"author":[{"name":"Alice"}],
      "publisher":{"name":"Pub"},"headline":"H"}</script><script type="application/ld+json">{bad</script></head>
      <body><nav>menu</nav><article>Hello  <b>you</b><aside>no</aside></article><footer>f</footer></body>"""
    fields = extract.generic_fields(Page("parsed"))
    got = parsed(spark, html, "<title>Only</title>").select(*[c.alias(n) for n, c in fields.items()]).collect()
    assert (got[0].title, got[0].author, got[0].site_name, got[0].text) == ("H", "Alice", "Pub", "Hello you")
    assert (got[1].title, got[1].text) == ("Only", "Only")


def test_fingerprint(spark):
    base = "<div id=a class=x><h1>t</h1></div>"
    pages = [base, "<div id=b class=y><h1>other</h1></div>", "<div class=x><p><h1>t</h1></p></div>", base + "<script>1</script>"]
    a, b, c, d = [r.fp for r in parsed(spark, *pages, skeleton=True)
                  .select(drift.fingerprint(F.col("parsed.skeleton")).alias("fp")).collect()]
    assert a == b == d and a != c


def test_chunks(spark):
    def by_hand(text, size):
        out, at = [], 0
        if len(text) <= size:
            return [text]
        while at < len(text):
            end = at + size
            piece = text[at:end]
            if end < len(text) and piece.rfind("<") > size * 0.8:
                piece = piece[: piece.rfind("<")]
                end = at + len(piece)
            out.append(piece)
            at = end
        return out

    texts = ["a<b>" * n + "é" * (n % 7) for n in (1, 3, 10, 33, 250)] + ["x" * 100, "<" * 100, "y" * 41]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, html string")
    got = rows.select("i", extract.html_chunks(F.col("html"), 10).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [by_hand(t, 40) for t in texts]
    assert extract.explode_chunks(rows, "html", 10).count() == sum(len(by_hand(t, 40)) for t in texts)


def fields(spark, pack, kind, url, html):
    rows = spark.createDataFrame([(url, html)], "url string, html string")
    return rules.extract_pack(rules.with_parsed(rows), pack, kind).first().fields


def test_pack_instagram_reel(spark):
    got = fields(spark, INSTAGRAM, "reel", "https://instagram.com/reel/1", """<header><a href="/me">me</a></header>
      <span class="_aacl">1.2M views</span><section><span class="_aacl">45.6K likes</span></section>
      <div class="_a9zs"><span>Go #fun</span></div><time datetime="2025-01-01">x</time>""")
    assert (got.views_count, got.likes_count, got.author_username, got.tags) == (1200000, 45600, "me", ["#fun"])


def test_pack_x_profile_keeps_count_text(spark):
    got = fields(spark, X, "profile", "https://x.com/me", """<h1>Me</h1><h2>@me</h2><span class="follower-count">12.3K followers</span>
      <a class="profile-website" href="https://w.org">w</a><div class="recent-tweets"><p class="tweet-text">one</p><p class="tweet-text"></p></div>""")
    assert (got.follower_count, got.website, got.author_username, got.recent_tweets) == (
        "12.3K followers", "https://w.org", "me", ["one"])


def test_pack_tiktok_views_stay_unread(spark):
    got = fields(spark, TIKTOK, "profile", "https://tiktok.com/@c", """<h1 data-e2e="user-title">@c</h1>
      <div class="tt-video-item" data-video-id="1"><span class="tt-video-views">450K views</span></div>""")
    assert got.recent_videos[0].views is None and got.username == "c" and len(got.partial_reasons) == 6


def test_pack_linkedin_profile(spark):
    got = fields(spark, LINKEDIN, "profile", "https://linkedin.com/in/a",
                 '<h1 class="top-card-layout__title">Ann</h1><p class="connections-count">500+ connections</p>')
    assert (got["name"], got.connections_count) == ("Ann", 500)
    assert any("connections_count" in w for w in got.warnings)


def test_pack_facebook_page(spark):
    got = fields(spark, FACEBOOK, "profile", "https://www.facebook.com/g", """<h1 class="fb-page-name">G</h1>
      <p class="fb-followers-count">12K followers</p><a class="fb-page-website" href="/site">s</a>
      <div class="fb-recent-posts"><div class="fb-post-preview" data-post-id="9"><p class="fb-post-preview-text">t</p></div></div>""")
    assert (got.followers_count, got.website, got.recent_posts[0].post_id) == (12000, "https://www.facebook.com/site", "9")
    assert got.is_public


def test_pack_youtube_bare_meta_title(spark):
    html = '<meta property="og:title" content="V"><p>Comments disabled</p><b class="yt-comment-count">5</b>'
    video = fields(spark, YOUTUBE, "video", "https://www.youtube.com/watch?v=a1", html)
    assert (video.title, video.id, video.comments_disabled, video.comment_count) == ("", "a1", True, None)
    channel = fields(spark, YOUTUBE, "profile", "https://www.youtube.com/@c", html)
    assert channel["name"] == "V"


def test_pack_lists(spark):
    got = fields(spark, QUOTES, "post", "https://quotes.toscrape.com/",
                 '<p class="text" itemprop="text">q</p><div class="tags"><a class="tag" href="/t">x</a><a class="tag">y</a></div>')
    assert (got.quote_text, got.tags) == (["q"], ["/t"])


def test_unified_mixed_table(spark):
    rows = spark.createDataFrame(
        [("https://x.com/a/status/1", "x", '<p class="tweet-text">hi</p>', "http"),
         ("https://e.com/", "generic", "<title>T</title>", "http"),
         ("https://www.facebook.com/g/reel/1", "facebook", '<p class="post-caption">c</p>', "browser")],
        "url string, platform string, html string, strategy string")
    out = rules.extract_unified(rules.with_parsed(rows), BUILT_IN).select("record.*").collect()
    got = {r.platform: (r.content_type, r.title, r.text) for r in out}
    assert got == {"x": ("post", None, "hi"), "generic": ("article", "T", "T"), "facebook": ("reel", "c", "c")}


def test_pack_checks():
    with pytest.raises(TypeError):
        rules.check_pack("x")
    with pytest.raises(ValueError):
        rules.check_pack(rules.Pack("n", [], ["x"], {}, lambda p: None))
    for pack in BUILT_IN:
        rules.check_pack(pack)


@pytest.mark.parametrize("name, unread", [
    ("C11_media_urls", "fb-share-count"), ("C14_comments_disabled", "yt-video-title"), ("C16_tiktok_video", "music-title"),
    ("C16_youtube_video", "yt-category"),
])
def test_only_fields_that_are_read_are_made(spark, tmp_path, name, unread):
    """Two costly values that were read made Spark build all of a page's values."""
    from webgrain.plans import QUERIES

    spark.createDataFrame(
        [(1, 2, "2020-01-01")], "o_orderkey long, o_custkey long, o_orderdate string"
    ).selectExpr("o_orderkey", "o_custkey", "cast(o_orderdate AS date) AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    made = QUERIES[name](spark, str(tmp_path))
    lines = made._jdf.queryExecution().optimizedPlan().toString()
    # What is drawn is the page's text before ArrowEvalPython, and what is read above it.
    assert unread not in lines.split("ArrowEvalPython")[0]
    assert made.count() == 1


def test_first_texts_pass_the_nodes_once(spark):
    """six reactions were six filters over all nodes of a page."""
    html = ('<div class="r-a-b">0</div><p class="x r-a">1<b>2</b></p><p class="r-a">3</p><script class="r-c">4</script>'
            '<i class="r-">5</i><i class="q-b">6</i><br class="r-d">')
    rows = spark.createDataFrame([(html,), ("",), (None,), ('<p class="r-b r-c">7</p>',)], "html string")
    page, names = Page("parsed"), ["r-a", "r-b", "r-c", "r-d", "r-"]
    pages = rules.with_parsed(rows)
    made = pages.select(page.first_texts(names).alias("new"), F.array(*[page.first_text(f".{n}") for n in names]).alias("old"))
    for row in made.collect():
        assert row.new == row.old
    assert pages.select(page.first_texts(names).alias("new"))._jdf.queryExecution().optimizedPlan().toString().count("filter(parsed") == 1


@pytest.mark.parametrize("name, sign, most", [("C13_reactions", "filter(parsed", 1), ("C14_comments_disabled", "[KMBkmb]?, 0", 2)])
def test_steps_of_counts_are_not_repeated(spark, tmp_path, name, sign, most):
    """A count's text was cut out again at each use, and each reaction looked for among all nodes."""
    from webgrain.plans import QUERIES

    spark.createDataFrame(
        [(1, 2, "2020-01-01"), (2, 3, "2020-01-02")], "o_orderkey long, o_custkey long, o_orderdate string"
    ).selectExpr("o_orderkey", "o_custkey", "cast(o_orderdate AS date) AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    made = QUERIES[name](spark, str(tmp_path))
    assert 1 <= made._jdf.queryExecution().optimizedPlan().toString().count(sign) <= most
    if name == "C13_reactions":
        assert {tuple(r) for r in made.collect() if r.n is not None} == {(1, "like", 2), (1, "wow", 2000), (2, "like", 3), (2, "wow", 3000)}
    else:
        assert {tuple(r) for r in made.collect()} == {(1, False, 2), (2, True, None)}


def test_parts_of_tags_are_remembered_in_bounds():
    from webgrain.operators import dom

    reader = dom._PageReader(None, False)
    for i in range(3 * dom._KNOWN_TAGS):
        reader.start()
        assert reader.read(f'<p a="{i}">x</p><p b="{"y" * dom._KNOWN_LENGTH}">') is None
        assert reader.keys == ["a", "b"] and reader.values[0] == str(i) and reader.lasts == [0, 1]
    assert len(reader.known) <= dom._KNOWN_TAGS
