"""Page predicates and labels used as quality filters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.functions.text import contains_any, first_of, found_of, strip
from webgrain.functions.urls import interstitial

# --- fixed values -----------------------------------------------------------
# Phrases of login walls and private pages.
PRIVATE_PHRASES = [
    "log in to", "login to", "sign in to", "signin to", "authentication required",
    "this content isn't available", "this page isn't available", "page not found",
    "sorry, this page isn't available", "please log in", "please sign in",
    "you must log in", "you must sign in", "members only", "private group",
    "this account is private", "this profile is private",
]
# The Facebook pack's own list.
FACEBOOK_PRIVATE_PHRASES = [
    "log in to", "login to", "sign in to", "signin to",
    "this content isn't available", "this page isn't available", "page not found",
    "sorry, this page isn't available", "please log in", "please sign in",
    "you must log in", "you must sign in", "members only", "private group",
    "this account is private", "this profile is private",
    "friends only", "only friends", "only available to friends",
    "this content isn't available right now",
]
# Error code per pack for pages behind a wall.
NOT_PUBLIC_CODES = {
    "generic": "SCR_020", "instagram": "SCR_020", "x": "SCR_020", "tiktok": "SCR_020",
    "linkedin": "SCR_021", "facebook": "SCR_061", "youtube": "SCR_061",
}
CHALLENGE_MARKERS = [
    "cf-challenge", "cf-turnstile", "g-recaptcha", "h-captcha", "data-captcha", "captcha",
    "challenge-form", "ddos-guard", "perimeterx", "datadome", "px-captcha", "blocked",
    "access denied", "please verify", "are you human", "security check",
]
BLOCKING_PHRASES = [
    "access denied", "forbidden", "too many requests", "rate limit", "unusual traffic",
]
BLOCK_INDICATORS = [
    "captcha", "cloudflare", "cf-browser-verification", "access denied", "blocked",
    "rate limit", "too many requests", "please verify", "are you human", "security check",
    "ddos-guard", "perimeterx", "datadome", "forbidden",
]
BLOCKING_STATUS = [403, 429, 503]
SHORT_PAGE = 200
# (piece of the URL, platform, confidence)
PLATFORM_HINTS = [
    ("instagram.com", "instagram", 0.95), ("twitter.com", "x", 0.95), ("x.com", "x", 0.95),
    ("tiktok.com", "tiktok", 0.95), ("linkedin.com", "linkedin", 0.95),
    ("facebook.com", "facebook", 0.95), ("youtube.com", "youtube", 0.95),
    ("youtu.be", "youtube", 0.95), ("olx", "olx", 0.9), ("bayut", "bayut", 0.9),
    ("hatla2ee", "hatla2ee", 0.9), ("contactcars", "contactcars", 0.9),
]
# (piece of the URL, content type, confidence)
CONTENT_HINTS = [
    ("/property", "real_estate", 0.8), ("/apartment", "real_estate", 0.8),
    ("/real-estate", "real_estate", 0.9), ("/listing", "real_estate", 0.7),
    ("/product", "product", 0.8), ("/item", "product", 0.7), ("/job", "job", 0.8),
    ("/jobs", "job", 0.8), ("/career", "job", 0.7), ("/article", "article", 0.7),
    ("/news", "article", 0.7), ("/blog", "article", 0.7), ("/post", "post", 0.6),
    ("/video", "video", 0.7), ("/watch", "video", 0.7), ("/profile", "profile", 0.7),
    ("/user", "profile", 0.6), ("/quote", "quote", 0.8),
]
CONFIDENT = 0.8
# --- end of fixed values ----------------------------------------------------


def is_public(visible_text: Column, platform: str | None = None) -> Column:
    """No phrase of a login wall or private page occurs in the visible text.

    Ordinary prose with "log in to" counts as a wall as well.
    """
    phrases = FACEBOOK_PRIVATE_PHRASES if platform == "facebook" else PRIVATE_PHRASES
    return ~contains_any(F.lower(visible_text), phrases)


def wall_code(visible_text: Column, platform: str) -> Column:
    """The pack's error code when the page is not public, else NULL."""
    return F.when(~is_public(visible_text, platform), NOT_PUBLIC_CODES.get(platform, "SCR_020"))


def challenge_reason(html: Column, final_url: Column, status: Column, *, skip: bool = False) -> Column:
    """First reason to take a page for a bot challenge, else NULL."""
    if skip:
        return F.lit(None).cast("string")
    low = F.lower(html)
    marker = first_of(low, CHALLENGE_MARKERS)
    return (
        F.when(interstitial(final_url),
               F.concat(F.lit("Final URL looks like an interstitial: "), final_url))
        .when(marker.isNotNull(), F.concat(F.lit("Challenge marker found: '"), marker, F.lit("'")))
        .when(F.length(strip(html)) < SHORT_PAGE, F.lit("HTML body is unusually short"))
        .when(
            status.isin(BLOCKING_STATUS) & contains_any(low, BLOCKING_PHRASES),
            F.concat(F.lit("Blocking status code "), status.cast("string"),
                     F.lit(" with challenge language")),
        )
    )


def block_indicators(html: Column) -> Column:
    """Indicators found, in list order, plus the implied CDN name."""
    hits = found_of(F.lower(html), BLOCK_INDICATORS)
    implied = F.array_contains(hits, "cf-browser-verification") & ~F.array_contains(hits, "cloudflare")
    return F.when(implied, F.concat(hits, F.array(F.lit("cloudflare")))).otherwise(hits)


def block_reason(indicators: Column) -> Column:
    """First indicator, else 'status_code' (also for pages that are fine)."""
    return F.coalesce(F.get(indicators, F.lit(0)), F.lit("status_code"))


def is_blocked(indicators: Column, status: Column) -> Column:
    return (F.size(indicators) > 0) | F.coalesce(status.isin(BLOCKING_STATUS), F.lit(False))


def block_cause(reason: Column, status: Column) -> Column:
    """struct(cause, confidence) of a blocked page; a label for filtering only."""
    rate_limited = (status == 429) | contains_any(reason, ["rate limit", "too many"])
    captcha = contains_any(reason, ["captcha", "verify", "human"])
    cdn = contains_any(reason, ["cloudflare", "ddos", "perimeterx"])
    forbidden = (status == 403) | contains_any(reason, ["blocked", "denied"])

    def label(cause: str, confidence: float) -> Column:
        return F.struct(F.lit(cause).alias("cause"), F.lit(confidence).alias("confidence"))

    return (
        F.when(rate_limited, label("rate_limited", 0.85))
        .when(captcha, label("captcha", 0.8))
        .when(cdn, label("cdn_challenge", 0.75))
        .when(forbidden, label("forbidden", 0.7))
        .otherwise(label("other", 0.6))
    )


def _hint(url: Column, hints: list[tuple[str, str, float]], label: str, score: float) -> tuple[Column, Column]:
    name, conf = F.lit(label), F.lit(score)
    for piece, value, confidence in reversed(hints):
        name = F.when(url.contains(piece), value).otherwise(name)
        conf = F.when(url.contains(piece), confidence).otherwise(conf)
    return name, conf


def classify_content(html: Column, url: Column) -> Column:
    """E5: struct(platform, content_type, confidence) from URL, markup and title cues in the whole page."""
    low_url = F.lower(url)
    head = F.lower(html)
    platform, platform_conf = _hint(low_url, PLATFORM_HINTS, "generic", 0.0)
    kind, kind_conf = _hint(low_url, CONTENT_HINTS, "article", 0.0)
    marked = html.contains('"@type":') | head.contains("schema.org")
    schema_kind = (
        F.when(head.contains("product"), "product")
        .when(head.contains("jobposting"), "job")
        .when(contains_any(head, ["apartment", "residence"]), "real_estate")
    )
    kind = F.when(marked, F.coalesce(schema_kind, kind)).otherwise(kind)
    kind_conf = F.when(
        marked, F.greatest(kind_conf, F.when(schema_kind.isNotNull(), 0.8).otherwise(0.6))
    ).otherwise(kind_conf)
    estate = head.rlike("<title>[^<]*(apartment|villa|property|listing)")
    quote = head.rlike("<title>[^<]*quote")
    kind = F.when(estate, "real_estate").when(quote, "quote").otherwise(kind)
    kind_conf = F.when(estate | quote, F.greatest(kind_conf, F.lit(0.7))).otherwise(kind_conf)
    both = (platform_conf > 0) & (kind_conf > 0)
    score = F.when(both, F.least(F.lit(0.95), (platform_conf + kind_conf) / 2 + 0.1)).otherwise(
        F.greatest(platform_conf, kind_conf)
    )
    return F.struct(
        platform.alias("platform"), kind.alias("content_type"), F.round(score, 2).alias("confidence")
    )


def cascade(heuristic: Column, external: Column) -> Column:
    """Keep a confident heuristic label, else the external one if at least as sure."""
    return F.when(
        (heuristic.confidence < CONFIDENT) & (external.confidence >= heuristic.confidence), external
    ).otherwise(heuristic)


def external_label(answer: Column) -> Column:
    """Label from a model answer (variant): unwrap one-item lists, default the rest."""
    inner = F.coalesce(F.try_variant_get(answer, "$[0]", "variant"), answer)
    ok = F.schema_of_variant(inner).startswith("OBJECT")
    get = lambda path, kind, default: F.coalesce(
        F.when(ok, F.try_variant_get(inner, path, kind)), F.lit(default)
    )
    return F.struct(
        get("$.platform", "string", "generic").alias("platform"),
        get("$.content_type", "string", "article").alias("content_type"),
        get("$.confidence", "double", 0.0).alias("confidence"),
    )


def needs_enrichment(text: Column, title: Column, author: Column, *, enabled: bool = True) -> Column:
    """A critical field is missing or blank (and the feature is on)."""
    if not enabled:
        return F.lit(False)
    missing = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    return missing(text) | missing(title) | missing(author)


def fetch_ok(status: Column, error: Column) -> Column:
    """No error, and no status or one below 400."""
    return error.isNull() & F.coalesce(status < 400, F.lit(True))
