"""Unified records: normalising, confidences, merging, strategy choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webgrain.functions import scalars, urls
from webgrain.functions.text import let, strip
from webgrain.schemas import UNIFIED
from webgrain.session import materialized

# --- fixed values -----------------------------------------------------------
BROWSER_FIRST = ["instagram", "tiktok", "linkedin", "facebook"]
HTTP_WITH_BROWSER = ["x", "youtube", "generic"]
STRATEGIES = ["http", "browser"]
FALLBACK_FACTOR = 0.8
# --- end of fixed values ----------------------------------------------------


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def field_confidences(fields: dict[str, tuple[Column, str]], explicit: dict[str, Column] | None = None,
                      explicit_lists: dict[str, Column] | None = None) -> Column:
    """``map<field, confidence>``.

    ``fields`` maps a name to (value, kind) with kind string, array, map or other.
    An explicit double is clamped; an explicit list counts with its mean; the
    rest gets 1.0 when present, else 0.0.
    """
    explicit, explicit_lists = explicit or {}, explicit_lists or {}
    scores = []
    for name, (value, kind) in fields.items():
        score = scalars.presence(value, kind)
        if name in explicit:
            score = F.when(explicit[name].isNotNull(), clamp(explicit[name])).otherwise(score)
        if name in explicit_lists:
            numbers = F.filter(explicit_lists[name], lambda v: v.isNotNull())
            mean = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + clamp(v)) / F.size(numbers)
            score = (
                F.when(F.size(explicit_lists[name]) <= 0, score)
                .when(F.size(numbers) > 0, mean)
                .when(explicit_lists[name].isNotNull(), F.lit(0.0))
                .otherwise(score)
            )
        scores.append(score)
    return F.map_from_arrays(F.array(*[F.lit(n) for n in fields]), F.array(*scores))


def overall_confidence(confidences: Column, discounted: Column, pack_confidence: Column | None = None) -> Column:
    """mean; x0.8 once when a fallback or a model was used; x pack confidence if > 0."""
    values = F.map_values(confidences)
    mean = F.when(
        F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    ).otherwise(F.lit(0.0))
    score = F.round(clamp(F.when(discounted, mean * FALLBACK_FACTOR).otherwise(mean)), 4)
    if pack_confidence is not None:
        score = F.when(pack_confidence > 0, F.round(score * pack_confidence, 4)).otherwise(score)
    return score


def unified_struct(values: dict[str, Column]) -> Column:
    """a struct with all unified columns; unknown keys become ``metadata`` text.

    Missing lists default to empty ones, the content type to 'post'.
    """
    known = {}
    for name, kind in UNIFIED.items():
        if name == "metadata":
            continue
        value = values.get(name)
        value = F.lit(None).cast(kind) if value is None else value.cast(kind)
        if kind.startswith("array"):
            value = F.coalesce(value, F.array().cast(kind))
        elif name == "content_type":
            value = F.coalesce(value, F.lit("post"))
        elif name == "ai_assisted":
            value = F.coalesce(value, F.lit(False))
        known[name] = value
    entries = [
        F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
        for name, value in values.items()
        if name not in UNIFIED
    ]
    extras = (
        F.map_from_entries(F.filter(F.array(*entries), lambda e: e.value.isNotNull()))
        if entries
        else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    )
    return F.struct(*[c.alias(n) for n, c in known.items()], extras.alias("metadata"))


def normalize_fields(fields: dict[str, tuple[Column, str]], *, platform: Column, url: Column,
                     strategy: Column, fallback: Column, assisted: Column,
                     explicit: dict[str, Column] | None = None,
                     pack_confidence: Column | None = None,
                     content_type: Column | None = None) -> Column:
    """F1-F3 in one: unified struct with confidences of freshly extracted fields."""
    scored = field_confidences(
        {"platform": (platform, "string"), "url": (url, "string"), **fields}, explicit
    )

    def build(conf: Column) -> Column:
        values = {name: value for name, (value, _kind) in fields.items()}
        values.update(
            platform=platform, url=url, scraping_strategy=strategy, ai_assisted=assisted,
            field_confidences=conf,
            confidence=overall_confidence(conf, fallback | assisted, pack_confidence),
        )
        if content_type is not None:
            values["content_type"] = content_type
        return unified_struct(values)

    return let(scored, build)


def merge_enrichment(existing: Column, extra: Column, kind: str) -> Column:
    """fill only NULLs and blank strings; an existing empty list stays."""
    if kind.startswith("array"):
        return F.coalesce(existing, F.when(F.size(extra) > 0, extra))
    if kind == "string":
        return F.when(F.coalesce(strip(existing), F.lit("")) != "", existing).otherwise(
            F.coalesce(extra, existing)
        )
    return F.coalesce(existing, extra)


def merge_answers(pages: DataFrame, answers: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Left-join model answers and fill the gaps; one row per page.

    Where a key has several answers, each field takes the smallest value that is there
    (``enrich.fold_chunks`` folds answers that have an order).
    """
    there = {f: F.when(F.size(f) > 0, F.col(f)) if k.startswith("array") else F.col(f) for f, k in fields.items()}
    right = answers.groupBy(key).agg(*[F.min(c).alias(f"_{f}") for f, c in there.items()])
    joined = pages.join(right, key, "left")
    out = [
        merge_enrichment(F.col(c), F.col(f"_{c}"), fields[c]).alias(c) if c in fields else F.col(c)
        for c in pages.columns
    ]
    return joined.select(*out)


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """first successful strategy per request.

    ``attempts``: request, rank, strategy, ok.  Only as many values per request
    are kept as there are strategies, so repeated attempts aggregate map-side.
    """
    grouped = attempts.groupBy("request").agg(
        F.min(F.when(F.col("ok"), F.col("rank"))).alias("winner_rank"),
        F.array_sort(F.collect_set(F.struct("rank", "strategy"))).alias("tried"),
    )
    upto = F.filter(
        "tried", lambda t: F.col("winner_rank").isNull() | (t.rank <= F.col("winner_rank"))
    )
    return grouped.withColumn("tried", upto).select(
        "request",
        F.col("winner_rank").isNotNull().alias("success"),
        F.when(F.col("winner_rank").isNotNull(), F.element_at("tried", -1).strategy).alias("strategy"),
        F.transform("tried", lambda t: t.strategy).alias("strategies_attempted"),
        (F.size("tried") > 1).alias("fallback_triggered"),
    )


def choose_strategy(platform: Column, http_worked: Column, browser_worked: Column,
                    override: Column | None = None) -> Column:
    """F8: struct(primary, fallback, reason, rejected).

    A default of http flips to browser once browser worked on the domain and the
    other way round, even if both did.  An unknown override rejects the row.
    """
    wants = override if override is not None else F.lit(None).cast("string")
    default = F.when(platform.isin(BROWSER_FIRST), "browser").otherwise("http")
    http, browser = (F.coalesce(c, F.lit(False)) for c in (http_worked, browser_worked))
    to_browser = (default == "http") & browser
    to_http = (default == "browser") & http
    primary = (
        F.when(wants.isNotNull(), wants).when(to_browser, "browser").when(to_http, "http")
        .otherwise(default)
    )
    reason = (
        F.when(wants.isNotNull(), F.concat(F.lit("User override: "), wants))
        .when(to_browser, "Domain memory indicates browser strategy succeeds")
        .when(to_http, "Domain memory indicates HTTP strategy succeeds")
        .when(platform.isin(BROWSER_FIRST), F.concat(platform, F.lit(" requires JavaScript rendering")))
        .when(platform.isin(HTTP_WITH_BROWSER),
              F.concat(platform, F.lit(" prefers HTTP with browser fallback")))
        .otherwise("Generic/static pages default to HTTP")
    )
    return F.struct(
        primary.alias("primary"),
        F.when(primary == "http", "browser").otherwise("http").alias("fallback"),
        reason.alias("reason"),
        F.coalesce(~wants.isin(STRATEGIES), F.lit(False)).alias("rejected"),
    )


def with_strategy(pages: DataFrame, memory: DataFrame, *, url: str = "url", platform: str = "platform",
                  override: Column | None = None) -> DataFrame:
    """Look up the domain's memory (domain, http_ok, browser_ok) and choose.

    The memory has one row per domain.  It is stored first: Spark broadcasts it when its
    size allows, and otherwise both sides are plain shuffles, of which it splits hot domains.
    """
    keyed = pages.withColumn("domain", urls.domain_of(F.col(url)))
    memory = materialized(memory, "domain-strategies")
    return keyed.join(memory, "domain", "left").withColumn(
        "selection", choose_strategy(F.col(platform), F.col("http_ok"), F.col("browser_ok"), override)
    ).drop("http_ok", "browser_ok")


def envelope(success: Column, output: Column, error: Column, timings: Column) -> Column:
    """result struct; output only for successes, error only for failures."""
    return F.struct(
        success.alias("success"), F.when(success, output).alias("output"),
        F.when(~success, error).alias("error"), scalars.whole_millis(timings).alias("timing_ms"),
    )
