"""Scalar columns: counts, durations, timestamps, hashes, tolerant JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from webgrain.functions.text import strip

# --- fixed values -----------------------------------------------------------
# Words that surround a count, per page family (regex alternatives).
COUNT_WORDS = {
    "instagram": "likes?|comments?|views?|followers?|following|posts?",
    "x": "likes?|reposts?|retweets?|replies?|views?|followers?|following|posts?",
    "tiktok": "views?|likes?|comments?|shares?",
    "linkedin": "likes?|comments?|reposts?|reactions?|followers?|connections?",
    "hackernews": "points?|score",
}
# Families whose words are removed anywhere, together with ' ' and '+' at the ends.
LOOSE_COUNT_FAMILIES = ["tiktok", "linkedin"]
# Error classes -> (code, suggested fix).
ERROR_CODES = {
    "UnsupportedURLError": ("SCR_001", "Check the URL format or install a matching plugin"),
    "RetryableError": ("SCR_011", "Increase timeout or retry later"),
}
OTHER_ERROR = ("SCR_099", "Check diagnostics and retry")
# Critical fields of the content hash, and how much of each is looked at.
CRITICAL_FIELDS = ["title", "author", "text"]
# --- end of fixed values ----------------------------------------------------


_COUNT = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*([kmb]?)$"


def parse_engagement(text: Column) -> Column:
    """``1.2K`` -> 1200, ``3M``, ``1,234``; NULL when it is not a number.

    Overflowing inputs give NULL.
    """
    plain = F.replace(F.lower(strip(text)), F.lit(","), F.lit(""))
    number = F.regexp_extract(plain, _COUNT, 1)  # '' is no double
    # '' -> 1, 'k' -> 1e3, 'm' -> 1e6, 'b' -> 1e9
    factor = F.pow(F.lit(1000.0), F.instr(F.lit("-kmb"), F.regexp_extract(plain, _COUNT, 2)) - 1)
    return (number.try_cast("double") * factor).try_cast("bigint")


def clean_count_text(text: Column) -> Column:
    """The first count-like piece of a noisy text."""
    return F.nullif(strip(F.regexp_extract(text, r"[\d\.,]+\s*[KMBkmb]?", 0)), F.lit(""))


def parse_count(text: Column, family: str) -> Column:
    """D3: strip the family's count words, then D1."""
    words = COUNT_WORDS[family]
    if family in LOOSE_COUNT_FAMILIES:
        bare = F.regexp_replace(text, rf"(?i)\s*({words})\s*", "")
        bare = F.regexp_replace(bare, r"^[ +]+|[ +]+$", "")
    else:
        bare = F.regexp_replace(text, rf"(?i)\b({words})\b", "")
    return parse_engagement(bare)


def parse_duration(value: Column) -> Column:
    """Seconds from ``45``, ``mm:ss`` or ``hh:mm:ss``; NULL otherwise."""
    clean = strip(value)
    n = F.split(clean, ":")
    part = lambda i: strip(F.get(n, F.lit(i))).try_cast("bigint")
    ok = clean.rlike(r"^\s*[+-]?\d+\s*(:\s*[+-]?\d+\s*){1,2}$")
    return (
        F.when(clean.rlike(r"^\d+$"), clean.try_cast("bigint"))
        .when(ok & (F.size(n) == 2), part(0) * 60 + part(1))
        .when(ok & (F.size(n) == 3), part(0) * 3600 + part(1) * 60 + part(2))
    )


_ISO = (
    r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp (UTC when no offset is given), else NULL.

    Basic forms (``20250115T103000Z``) are spelled out before the cast.
    """
    full = F.regexp_replace(strip(text), r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    full = F.regexp_replace(full, r"(?<=[T ])(\d{2})(\d{2})(\d{2})?", "$1:$2:$3")
    full = F.regexp_replace(full, r"([+-]\d{2})(\d{2})$", "$1:$2")
    full = F.regexp_replace(full, r"(?<=[T ]\d{2})(?=$|Z|[+-])", ":00")
    full = F.regexp_replace(full, r"(?<=[T ]\d{2}:\d{2}):?(?=$|Z|[+-])", ":00")
    return F.when(text.rlike(_ISO.replace("^", r"(?U)^\s*", 1)[:-1] + r"\s*$"), full.try_cast("timestamp"))


def hashtags(text: Column) -> Column:
    """``#word`` tokens (Unicode letters count)."""
    return F.regexp_extract_all(text, F.lit(r"(?U)#\w+"), F.lit(0))


def mentions(text: Column) -> Column:
    """``@word`` tokens."""
    return F.regexp_extract_all(text, F.lit(r"(?U)@\w+"), F.lit(0))


def clean_handle(text: Column) -> Column:
    """First word without leading at-signs."""
    return F.regexp_extract(F.regexp_replace(text, "^@+", ""), r"(?U)^\s*(\S*)", 1)


def name_slug(name: Column) -> Column:
    """Lower-cased name with dashes for white space."""
    return F.lower(F.regexp_replace(name, r"(?U)\s+", "-"))


def first_line(text: Column) -> Column:
    """Title from the first line of a text."""
    return F.nullif(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(""))


def presence(value: Column, kind: str = "string") -> Column:
    """0.0 for NULL, blank strings and empty lists or maps, else 1.0."""
    if kind == "string":
        there = strip(value) != ""
    elif kind in ("array", "map"):
        there = F.size(value) > 0
    else:
        there = value.isNotNull()
    return F.when(there, F.lit(1.0)).otherwise(F.lit(0.0))


def critical_hash(**fields: Column) -> Column:
    """Hash of title, author and text as a whole; NULL when all are empty."""
    parts = [F.coalesce(fields.get(f, F.lit(None).cast("string")), F.lit("")) for f in CRITICAL_FIELDS]
    joined = F.concat_ws("|", *parts)
    return F.when(F.btrim(joined, F.lit("|")) != "", F.sha2(joined, 256))


def cache_key(html: Column, schema_text: Column) -> Column:
    """Key of a model response for one content and one field description.

    Full digests at every step, so that different contents never share a key; a
    NULL content has a key of its own, different from that of an empty one.
    """
    digest = lambda c: F.coalesce(F.sha2(c, 256), F.lit("-"))
    return F.sha2(F.concat(digest(html), F.lit(":"), digest(schema_text)), 256)


def token_estimate(text: Column) -> Column:
    """About one token per four characters, at least one."""
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("bigint")


def tolerant_json(text: Column, *, object_only: bool = True) -> Column:
    """Parse JSON, if need be after removing a code fence.

    NULL (never an error) when it is not JSON, or not an object on request.
    """
    # No JSON text starts or ends with a fence, so one parse covers both cases.
    bare = strip(F.regexp_replace(strip(text), "^```(json)?|```$", ""))
    value = F.try_parse_json(bare)
    return F.when(bare.startswith("{"), value) if object_only else value


def error_record(error_type: Column, message: Column, url: Column, strategies: Column,
                 selectors: Column) -> Column:
    """Structured error of a failed page; the HTTP status is never known here."""
    code, fix = F.lit(OTHER_ERROR[0]), F.when(error_type.isNotNull(), F.lit(OTHER_ERROR[1]))
    for name, (c, f) in ERROR_CODES.items():
        code = F.when(error_type == name, c).otherwise(code)
        fix = F.when(error_type == name, f).otherwise(fix)
    return F.struct(
        code.alias("code"),
        F.when(error_type.isNull(), "Unknown error").otherwise(message).alias("message"),
        url.alias("url"),
        F.get(strategies, F.size(strategies) - 1).alias("strategy"),
        F.lit(None).cast("int").alias("http_status"),
        selectors.alias("selectors_tried"),
        fix.alias("suggested_fix"),
    )


def identifier(text: Column) -> Column:
    """Safe identifier: lower case, dashes and blanks to ``_``, other marks dropped."""
    low = F.translate(F.lower(strip(text)), "- ", "__")
    return F.btrim(F.regexp_replace(low, r"[^\p{L}\p{N}_]", ""), F.lit("_"))


def quote_selector(selector: str) -> str:
    """Quote bare attribute values of a selector (applied when rules are loaded)."""
    return re.sub(r"\[([\w-]+)=([^\"'\]]+)\]", r'[\1="\2"]', selector)


def whole_millis(timings: Column) -> Column:
    """Stage timings rounded half-even to whole milliseconds."""
    return F.transform_values(timings, lambda _k, v: F.bround(v).cast("int"))


def json_text(value: Column, path: str) -> Column:
    """Text at a path of a variant, NULL when absent."""
    return F.try_variant_get(value, path, "string")


