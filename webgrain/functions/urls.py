"""URL columns: splitting, clean-up, routing, domain keys, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.functions.text import blank_to_null, contains_any, let, strip

# --- fixed values -----------------------------------------------------------
# Query parameters dropped by URL normalisation.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "fbclid", "gclid", "ttclid", "li_fat_id", "mc_cid", "mc_eid",
]

# Ordered platform patterns; the first platform with a hit wins.
PLATFORM_PATTERNS = {
    "instagram": [
        r"https?://(?:www\.)?instagram\.com/p/[^/]+",
        r"https?://(?:www\.)?instagram\.com/reel/[^/]+",
        r"https?://(?:www\.)?instagram\.com/[^/]+",
    ],
    "x": [
        r"https?://(?:www\.)?(?:twitter|x)\.com/[^/]+/status/\d+",
        r"https?://(?:www\.)?(?:twitter|x)\.com/[^/]+",
    ],
    "tiktok": [
        r"https?://(?:www\.)?tiktok\.com/@[^/]+/video/\d+",
        r"https?://(?:www\.)?tiktok\.com/t/\w+",
        r"https?://(?:www\.)?tiktok\.com/@[^/]+",
    ],
    "linkedin": [
        r"https?://(?:www\.)?linkedin\.com/posts/[^/]+",
        r"https?://(?:www\.)?linkedin\.com/pulse/[^/]+",
        r"https?://(?:www\.)?linkedin\.com/activity/[^/]+",
        r"https?://(?:www\.)?linkedin\.com/in/[^/]+",
        r"https?://(?:www\.)?linkedin\.com/company/[^/]+",
    ],
    "facebook": [
        r"https?://(?:www\.)?facebook\.com/[^/]+/posts/[^/]+",
        r"https?://(?:www\.)?facebook\.com/[^/]+/photos/[^/]+",
        r"https?://(?:www\.)?facebook\.com/[^/]+/videos/[^/]+",
        r"https?://(?:www\.)?facebook\.com/[^/]+/reel/[^/]+",
        r"https?://(?:www\.)?facebook\.com/[^/]+",
    ],
    "youtube": [
        r"https?://(?:www\.)?youtube\.com/watch\?.*v=[^&]+",
        r"https?://(?:www\.)?youtube\.com/shorts/[^/]+",
        r"https?://(?:www\.)?youtube\.com/embed/[^/]+",
        r"https?://(?:www\.)?youtube\.com/@[^/]+",
        r"https?://(?:www\.)?youtube\.com/channel/[^/]+",
        r"https?://(?:www\.)?youtu\.be/[^/]+",
    ],
}
GENERIC_PATTERN = r"https?://.+"

# (platform, piece of the lower-cased path, content type); the first hit wins.
CONTENT_TYPE_RULES = [
    ("instagram", "/p/", "post"), ("instagram", "/reel/", "reel"),
    ("x", "/status/", "post"),
    ("tiktok", "/video/", "video"), ("tiktok", "/t/", "video"),
    ("linkedin", "/posts/", "post"), ("linkedin", "/pulse/", "post"),
    ("linkedin", "/activity/", "post"), ("linkedin", "/in/", "profile"),
    ("linkedin", "/company/", "profile"),
    ("facebook", "/posts/", "post"), ("facebook", "/photos/", "post"),
    ("facebook", "/videos/", "video"), ("facebook", "/reel/", "reel"),
    ("youtube", "/watch", "video"), ("youtube", "/shorts/", "short"),
    ("youtube", "/embed/", "video"), ("youtube", "/@", "profile"),
    ("youtube", "/channel/", "profile"), ("youtube", "/youtu.be/", "video"),
]
DEFAULT_CONTENT_TYPES = {
    "instagram": "profile", "x": "profile", "tiktok": "profile", "linkedin": "post",
    "facebook": "profile", "youtube": "video", "generic": "article",
}
# Pieces of a final URL that give away an interstitial.
INTERSTITIAL_PARTS = [
    "/captcha", "/challenge", "/verify", "/blocked", "cloudflare", "datadome", "perimeterx",
]
# First path parts that are not user names.
X_RESERVED = ["home", "explore", "notifications", "messages", "i", "search"]
INSTAGRAM_RESERVED = ["p", "reel", "tv", "accounts"]
FACEBOOK_SECTIONS = ["posts", "photos", "videos", "reel"]
# --- end of fixed values ----------------------------------------------------

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def query_of(url: Column) -> Column:
    """The raw query without its question mark."""
    return F.regexp_replace(F.regexp_extract(url, _SPLIT, 4), r"^\?", "")


def fragment_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _SPLIT, 5), "^#", "")


def _clean(url: Column) -> Column:
    """Trim and drop tabs and line breaks, which no URL may contain."""
    return F.regexp_replace(strip(url), r"[\t\r\n]", "")


def reject_reason(url: Column) -> Column:
    """B2: why a URL cannot be processed, or NULL when it is fine."""
    u = _clean(url)
    scheme = scheme_of(u)
    return (
        F.when(u.isNull() | (u == ""), F.lit("URL is empty"))
        .when(
            ~scheme.isin("http", "https"),
            F.concat(
                F.lit("Unsupported URL scheme: "),
                F.when(scheme == "", F.lit("missing")).otherwise(scheme),
            ),
        )
        .when(netloc_of(u) == "", F.lit("URL is missing a host"))
    )


def _decode(value: Column) -> Column:
    """Percent-decode; stray percent signs stay as they are."""
    return F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(value: Column) -> Column:
    """Form-encode with ``~`` kept and ``*`` escaped."""
    return F.replace(
        F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def query_pairs(query: Column) -> Column:
    """``array<struct<k,v>>`` of the decoded parameters, in order; empty pairs vanish."""
    raw = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        raw,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v"),
        ),
    )


def query_param(url: Column, name: str) -> Column:
    """First non-blank value of a query parameter."""
    hits = F.filter(query_pairs(query_of(_clean(url))), lambda p: (p.k == name) & (p.v != ""))
    return F.get(hits, F.lit(0)).v


def normalize_url(url: Column) -> Column:
    """B1: drop tracking parameters and re-encode the query.

    Host case and fragment are kept, the scheme is lower-cased, repeated keys
    gather at their first position, a bare key gains ``=``.  NULL when rejected.
    """
    u = _clean(url)
    pairs = F.filter(query_pairs(query_of(u)), lambda p: ~F.lower(p.k).isin(TRACKING_PARAMS))

    def grouped(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: p.k))
        ordered = F.flatten(F.transform(keys, lambda k: F.filter(ps, lambda p: p.k == k)))
        return F.array_join(
            F.transform(ordered, lambda p: F.concat(_encode(p.k), F.lit("="), _encode(p.v))), "&"
        )

    # Most URLs carry no query at all: skip the array work for those.
    query = F.when(query_of(u) == "", F.lit("")).otherwise(let(pairs, grouped))
    fragment = fragment_of(u)
    rebuilt = F.concat(
        scheme_of(u), F.lit("://"), netloc_of(u), path_of(u),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )
    return F.when(reject_reason(url).isNull(), rebuilt)


def _pattern_hit(url: Column, patterns: list[str]) -> Column:
    """True when one of ``patterns`` matches at the start, ignoring case."""
    return url.rlike("(?i)^(?:" + "|".join(patterns) + ")")


def platform_of(url: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """Platform of a normalised URL; ``extra`` rule packs come before 'generic'."""
    ladder = None
    for name, patterns in {**PLATFORM_PATTERNS, **(extra or {})}.items():
        step = _pattern_hit(url, patterns)
        ladder = F.when(step, name) if ladder is None else ladder.when(step, name)
    return ladder.when(_pattern_hit(url, [GENERIC_PATTERN]), "generic")


def content_type_of(platform: Column, url: Column) -> Column:
    """Content type from the path, else the platform's default, else 'article'."""
    path = F.lower(path_of(url))
    ladder = None
    for name, piece, kind in CONTENT_TYPE_RULES:
        step = (platform == name) & path.contains(piece)
        ladder = F.when(step, kind) if ladder is None else ladder.when(step, kind)
    for name, kind in DEFAULT_CONTENT_TYPES.items():
        ladder = ladder.when(platform == name, kind)
    return F.when(platform.isNotNull(), ladder.otherwise("article"))


def domain_of(url: Column, *, keep_port: bool = True) -> Column:
    """Lower-cased host without a leading ``www.``; the port stays on request.

    Plain host names (no scheme) are accepted as they are.
    """
    host = F.lower(F.coalesce(F.nullif(netloc_of(url), F.lit("")), url))
    if not keep_port:
        host = F.regexp_extract(host, "^([^:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def resolve_url(base: Column, value: Column) -> Column:
    """Absolute form of ``value`` seen from ``base``; NULL when blank."""
    return let(F.nullif(strip(value), F.lit("")), lambda ref: _resolve(base, ref))


def _resolve(base: Column, ref: Column) -> Column:
    root = F.regexp_extract(base, "^([^:]+://[^/?#]*)", 1)

    def against_path(parts: Column) -> Column:
        # Relative paths lose empty inner segments; '.' and '..' are folded from the left.
        inner = F.when(ref.startswith("/"), parts).otherwise(
            F.filter(parts, lambda s, i: (i == 0) | (i == F.size(parts) - 1) | (s != ""))
        )
        folded = F.aggregate(
            inner,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(s))),
        )
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.regexp_replace(F.array_join(F.concat(folded, tail), "/"), "^/?", "/")

    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    base_dir = F.regexp_replace(path_of(base), "[^/]*$", "")
    whole = F.when(ref.startswith("/"), ref_path).otherwise(F.concat(base_dir, ref_path))
    path = F.when(whole.rlike(r"(^|/)\.\.?(/|$)|//"), let(F.split(whole, "/"), against_path)).otherwise(
        F.regexp_replace(whole, "^/?", "/")
    )
    without_fragment = F.regexp_replace(base, "#.*$", "")
    same_page = (
        F.when(ref.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), ref))
        .otherwise(F.concat(without_fragment, ref))
    )
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme_of(base), F.lit(":"), ref))
        .when(ref_path == "", same_page)
        .otherwise(F.concat(root, path, F.regexp_extract(ref, r"([?#].*)$", 1)))
    )


def interstitial(url: Column) -> Column:
    """Does a final URL look like a challenge page?"""
    return F.coalesce(contains_any(F.lower(url), INTERSTITIAL_PARTS), F.lit(False))


# --- B11: identifiers in URLs -------------------------------------------------
def _group(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def tweet_id(url: Column) -> Column:
    return _group(url, r"/(?:status|statuses|i/web/status)/(\d+)")


def x_user(url: Column) -> Column:
    user = _group(url, r"(?:twitter|x)\.com/([^/?#]+)/?")
    return F.when(~user.isin(X_RESERVED), user)


def instagram_user(url: Column) -> Column:
    user = _group(url, r"instagram\.com/([^/?#]+)/?")
    return F.when(~user.isin(INSTAGRAM_RESERVED), user)


def last_path_part(url: Column) -> Column:
    return F.regexp_extract(path_of(url), "([^/]*)$", 1)


def youtube_video_id(url: Column) -> Column:
    path = path_of(url)
    return (
        F.when(path.startswith("/embed/") | path.startswith("/shorts/"), last_path_part(url))
        .when(netloc_of(url).isin("youtu.be", "www.youtu.be"), F.btrim(path, F.lit("/")))
        .otherwise(query_param(url, "v"))
    )


def facebook_post_id(url: Column) -> Column:
    last = _group(path_of(url), "([^/]+)/*$")
    return F.when(~last.isin(FACEBOOK_SECTIONS), last)


# --- B13: the extractors' own page typing ---------------------------------------
def instagram_page_type(url: Column) -> Column:
    return F.when(url.contains("/p/"), "post").when(url.contains("/reel/"), "reel").otherwise("profile")


def x_page_type(url: Column) -> Column:
    return F.when(url.rlike(r"/(status|statuses|i/web/status)/[^/?#]+"), "post").otherwise("profile")


def facebook_page_type(url: Column) -> Column:
    path = F.lower(path_of(url))
    return (
        F.when(path.contains("/posts/") | path.contains("/photos/"), "post")
        .when(path.contains("/videos/"), "video")
        .when(path.contains("/reel/"), "reel")
        .otherwise("profile")
    )


def youtube_page_type(url: Column) -> Column:
    path = F.lower(path_of(url))
    return (
        F.when(path.contains("/shorts/"), "short")
        .when(path.contains("/watch") | path.contains("/embed/") | path.contains("/youtu.be/"), "video")
        .otherwise("profile")
    )


def linkedin_page_type(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("/in/"), "profile").when(low.contains("/company/"), "company").otherwise("post")


def tiktok_page_type(url: Column, has_profile_mark: Column, has_video_mark: Column) -> Column:
    """TikTok also looks at marker elements of the page."""
    tail = F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1)
    return (
        F.when(F.lower(url).contains("/video/"), "video")
        .when(has_profile_mark, "profile")
        .when(has_video_mark, "video")
        .otherwise(F.when(tail.startswith("@"), "profile").otherwise("video"))
    )
