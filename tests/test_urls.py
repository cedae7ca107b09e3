"""URL columns against tables of cases and Python's own URL functions."""

from urllib.parse import parse_qs, urlencode, urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from webgrain.functions import urls
from webgrain.operators import links
from webgrain.operators.packs import BUILT_IN, SAMPLES


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


ROUTES = [
    ("https://www.instagram.com/p/abc/", "instagram", "post"),
    ("https://instagram.com/reel/abc", "instagram", "reel"),
    ("https://instagram.com/someone", "instagram", "profile"),
    ("https://x.com/u/status/12", "x", "post"),
    ("https://twitter.com/user/", "x", "profile"),
    ("https://www.tiktok.com/@u/video/1", "tiktok", "video"),
    ("https://www.tiktok.com/t/Zab", "tiktok", "video"),
    ("https://tiktok.com/@u", "tiktok", "profile"),
    ("https://www.linkedin.com/pulse/a", "linkedin", "post"),
    ("https://www.linkedin.com/in/a", "linkedin", "profile"),
    ("https://www.facebook.com/a/videos/1", "facebook", "video"),
    ("https://www.facebook.com/a", "facebook", "profile"),
    ("https://www.youtube.com/watch?v=1", "youtube", "video"),
    ("https://youtu.be/1", "youtube", "video"),
    ("HTTPS://WWW.YOUTUBE.COM/shorts/1", "youtube", "short"),
    ("https://example.com/article/123", "generic", "article"),
]


def test_routes(spark):
    given_urls = [u for u, _, _ in ROUTES]
    assert column(spark, given_urls, lambda c: urls.platform_of(urls.normalize_url(c))) == [p for _, p, _ in ROUTES]
    kinds = column(spark, given_urls, lambda c: urls.content_type_of(urls.platform_of(c), c))
    assert kinds == [k for _, _, k in ROUTES]


def test_rejects(spark):
    bad = ["ftp://a/b", "example.com", "   ", "https://", None]
    assert column(spark, bad, urls.reject_reason) == [
        "Unsupported URL scheme: ftp", "Unsupported URL scheme: missing", "URL is empty",
        "URL is missing a host", "URL is empty",
    ]
    assert column(spark, bad, urls.normalize_url) == [None] * 5


def expected_normal(url):
    parsed = urlparse(url.strip())
    kept = {k: v for k, v in parse_qs(parsed.query, keep_blank_values=True).items()
            if k.lower() not in urls.TRACKING_PARAMS}
    return parsed._replace(query=urlencode(kept, doseq=True)).geturl()


KEYS = st.sampled_from(["a", "b", "utm_source", "UTM_id", "q~", "é", "fbclid"])
VALUES = st.text(alphabet="aZ09 ~*-._%/é?=", max_size=6)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(st.tuples(KEYS, VALUES), max_size=4), st.sampled_from(["", "#f", "#"])),
                min_size=20, max_size=40))
def test_normalize_like_urllib(spark, cases):
    raw = [f"HTTPS://Ex.com/p;x=1?{'&'.join(f'{k}={v}' for k, v in pairs)}{tail}" for pairs, tail in cases]
    assert column(spark, raw, urls.normalize_url) == [expected_normal(u) for u in raw]


def test_normalize_groups_keys(spark):
    assert column(spark, ["http://a/?b=1&a=2&b=3&z&&utm_term=x"], urls.normalize_url) == ["http://a/?b=1&b=3&a=2&z="]


@pytest.mark.parametrize("base", ["https://h.com/a/b/c.html?q=1#z", "https://h.com", "https://h.com/a/"])
def test_resolve_like_urljoin(spark, base):
    refs = ["x", "/x", "../x", "../../../../x", "?k=1", "#f", "//o.com/p", "http://u.com", "./", "..",
            "a/./b/../c", "/a//b/../c?d=1#e", "mailto:x", "x/", "../", " y "]
    assert column(spark, refs, lambda c: urls.resolve_url(F.lit(base), c)) == [urljoin(base, r.strip()) for r in refs]
    assert column(spark, ["", "  ", None], lambda c: urls.resolve_url(F.lit(base), c)) == [None] * 3


def test_domains_and_ids(spark):
    hosts = ["https://www.A.com:80/x", "http://b.org", "www.c.net"]
    assert column(spark, hosts, urls.domain_of) == ["a.com:80", "b.org", "c.net"]
    assert column(spark, hosts, lambda c: urls.domain_of(c, keep_port=False)) == ["a.com", "b.org", "c.net"]
    videos = ["https://www.youtube.com/embed/e1", "https://youtu.be/y1", "https://www.youtube.com/watch?a=1&v=w1"]
    assert column(spark, videos, urls.youtube_video_id) == ["e1", "y1", "w1"]
    assert column(spark, ["https://x.com/home", "https://x.com/me"], urls.x_user) == [None, "me"]


def test_pack_routing_and_links(spark):
    found = column(spark, ["https://news.ycombinator.com/item?id=1", "https://x.com/a", "https://e.com"],
                   lambda c: links.route_to_pack(c, [*BUILT_IN, *SAMPLES]))
    assert found == ["hackernews", "x_twitter", None]
    raw = ["https://a.com/1", "ftp://b", "https://www.youtube.com/x", "https://a.com/1 ", "https://c.com"]
    rows = spark.createDataFrame([("q", i, u, "t", "s") for i, u in enumerate(raw)],
                                 "query string, seq bigint, url string, title string, snippet string")
    out = links.ranked_links(rows, hot_rows=2).orderBy("rank").collect()
    assert [(r.url, r["rank"]) for r in out] == [("https://a.com/1", 0), ("https://c.com", 1)]
