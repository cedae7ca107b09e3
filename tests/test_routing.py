"""Routing by host suffix against trying every pattern; robots rules with wildcards against a matcher of its own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from webgrain.operators import links, retention
from webgrain.operators.packs import BUILT_IN, SAMPLES

PATTERNS = [
    (r"https?://(?:www\.)?facebook\.com/[^/]+", "facebook.com"), (r"https?://shop\.example\.org/x", "shop.example.org"),
    (r"https?://[^/]+\.blog\.net/", "blog.net"), (r"https?://(?:m|www)\.site\.com/", "site.com"), (r"https?://colou?r\.com/", "com"),
    (r"https?://(?:[a-z]+\.)?wiki\.de/a|b", ""), (r"https?://(?:a|b)\.de/(?:x|y)", "de"), (r"https?://.*any\.com/", ""), (r"https?://open\.com", ""),
    (r"//x\.com/", ""), (r"https?://(?:sub\.)+deep\.io/", "deep.io"), (r"https?://\w+gram\.com/", "com"), (r"https?://[^.]+\.z\.fr/", ""),
    (r"https?://localhost/", "localhost"), (r"https?://[a-z]{2,3}\.cc\.jp/", "cc.jp"), (r"https?://HOST\.Co/", "host.co"),
]


def test_literal_suffixes(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PATTERNS)], "i long, p string")
    got = {r.i: r.s for r in rows.select("i", links.literal_suffix(F.col("p")).alias("s")).collect()}
    assert [got[i] for i in range(len(PATTERNS))] == [s for _, s in PATTERNS]


def test_ten_thousand_packs_equal_all_patterns(spark):
    rng = random.Random(3)
    rules = [(i, f"p{i}", p) for i, (p, _) in enumerate(PATTERNS)]
    for i in range(10_000):
        host = rng.choice([rf"s{i % 3000}\.org", rf"(?:www\.)?s{i % 3000}\.org", rf"[a-z]+\.s{i % 50}\.net"])
        rules.append((rng.randrange(5_000), f"q{i}", rf"https?://{host}/{rng.choice(['a', 'b', '[a-z]+', ''])}"))
    urls = ["https://facebook.com/me", "HTTP://WWW.FACEBOOK.COM/You", "https://a.blog.net/", "https://blog.net/", "https://m.site.com/", "https://color.com/",
            "https://evil.org/x.any.com/", "https://open.com.evil.org/", "//x.com/", "https://instagram.com/", "ftp://s1.org/", "", None, "no url",
            "https://user@s5.org/a", "https://s5.org:80/a", "https://de.wiki.de/a", "b", "https://sub.sub.deep.io/", "https://localhost/x", "https://q.z.fr/", "https://a/b.z.fr/"]
    for _ in range(600):
        n = rng.randrange(3100)
        urls.append(f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'xx.', 'a.b.'])}s{n if rng.random() < .7 else n % 50}.{rng.choice(['org', 'net'])}/{rng.choice(['a', 'b', 'abc', ''])}")
    urls += ["https://www.s7.org/hot"] * 600
    table = spark.createDataFrame(list(enumerate(urls)), "i long, url string").repartition(3)
    out = links.route_by_suffix(table, spark.createDataFrame(rules, "priority long, pack string, pattern string"))
    assert out.columns == ["i", "url", "pack"]
    got = {r.i: r.pack for r in out.collect()}
    tried = [(p, n, re.compile(f"(?:{x})", re.IGNORECASE)) for p, n, x in sorted(rules)]
    answers = {u: next((n for _, n, x in tried if u is not None and x.match(u)), None) for u in set(urls)}
    assert got == {i: answers[u] for i, u in enumerate(urls)}
    assert sum(v is not None for v in answers.values()) > 100


def test_equal_to_the_case(spark):
    packs = [*BUILT_IN, *SAMPLES]
    urls = ["https://www.youtube.com/watch?v=abc", "https://youtu.be/abc", "https://x.com/a/status/1", "https://www.linkedin.com/in/me", "https://fb.com/a",
            "https://www.instagram.com/p/abc/", "https://www.tiktok.com/@a/video/1", "https://example.com/", "https://m.facebook.com/a/posts/1"]
    table = spark.createDataFrame([(u,) for u in urls], "url string")
    got = links.route_by_suffix(table, links.pack_patterns(spark, packs))
    want = table.select("url", links.route_to_pack(F.col("url"), packs).alias("pack"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert links.route_by_suffix(table.limit(0), links.pack_patterns(spark, packs)).count() == 0
    assert links.route_by_suffix(table, links.pack_patterns(spark, [])).where("pack IS NOT NULL").count() == 0


def matches(pattern, path):
    """By the letters: a matcher that knows nothing of regular expressions."""
    end = pattern.endswith("$")
    body = pattern[:-1] if end else pattern
    places = {0}
    for i, piece in enumerate(body.split("*")):
        if i == 0:
            places = {len(piece)} if path.startswith(piece) else set()
        else:
            places = {k + len(piece) for p in places for k in range(p, len(path) - len(piece) + 1) if path.startswith(piece, k)}
    return any(p == len(path) for p in places) or (body.endswith("*") and bool(places)) if end else bool(places)


def test_robots_with_agents_and_wildcards(spark):
    rng = random.Random(5)
    letters = ["a", "b", "/", "*", "?", ".", "$", "é", "("]
    rules = [("hot.org", "*", "/", False), ("hot.org", "MyBot", "/a", False), ("hot.org", "mybot", "/a/*.b$", True), ("h0.org", "other", "/", False),
             ("h1.org", "*", "", False), ("h2.org", "mybot", "/*", False), ("h2.org", "*", "/b", True)]
    for _ in range(400):
        pattern = "/" + "".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))
        if rng.random() < 0.15:
            pattern = "*" + pattern
        rules.append((rng.choice(["hot.org", *(f"h{i}.org" for i in range(12))]), rng.choice(["*", "mybot", "MyBot", "other"]), pattern, rng.random() < 0.5))
    urls = [None, "https://nowhere.org/a", "nonsense"]
    for _ in range(700):
        path = "".join(rng.choice(["a", "b", "/", "?", ".", "$", "é", "("]) for _ in range(rng.randint(0, 8)))
        host = "hot.org" if rng.random() < 0.5 else f"h{rng.randrange(13)}.org"
        urls.append(f"https://{host}{rng.choice(['/', ''])}{path}" if not path or path[0] in "/?" else f"https://{host}/{path}")
    table = spark.createDataFrame(list(enumerate(urls)), "id long, url string").repartition(3)
    out = retention.robots_verdicts(table, spark.createDataFrame(rules, "host string, agent string, pattern string, allow boolean"), "myBOT", key="id")
    assert out.columns == ["id", "url", "allowed"]
    got, want = {r.id: r.allowed for r in out.collect()}, {}
    for i, url in enumerate(urls):
        found = re.match(r"https://([^/?#]*)([^#]*)", url or "")
        host, path = found.groups() if found else ("", "")
        path = path if path.startswith("/") else "/" + path
        own = [r for r in rules if r[0] == host and r[1].lower() == "mybot"] or [r for r in rules if r[0] == host and r[1] == "*"]
        hits = [(len(p.encode()), allow) for _, _, p, allow in own if p and matches(p, path)]
        want[i] = max(hits)[1] if hits else True
    assert got == want and 100 < sum(want.values()) < 600
