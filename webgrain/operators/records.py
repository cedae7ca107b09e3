"""The standard path from captures to unified records and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webgrain.functions import scalars, urls
from webgrain.operators import extract, normalize
from webgrain.operators.dom import parse_page
from webgrain.operators.selectors import Page


def classified(captures: DataFrame, url: str = "url") -> DataFrame:
    """Normalised URL, platform and content type; rejected URLs keep their reason.

    Everything is narrow and stays in the JVM.
    """
    rows = captures.withColumn("reject_reason", urls.reject_reason(F.col(url)))
    rows = rows.withColumn(url, F.coalesce(urls.normalize_url(F.col(url)), F.col(url)))
    rows = rows.withColumn("platform", urls.platform_of(F.col(url)))
    return rows.withColumn("content_type", urls.content_type_of(F.col("platform"), F.col(url)))


def basic_records(captures: DataFrame, *, fallback: Column | None = None, assisted: Column | None = None,
                  pack_confidence: Column | None = None) -> DataFrame:
    """The live path: classify, parse, basic fields (C2), normalise.

    ``captures``: url, html, strategy and anything else, which is kept (``html``
    is not).  One Python pass over ``html`` alone; no shuffle.
    """
    parsed = classified(captures).withColumn(
        "parsed", parse_page(F.col("html"), keep_tags=extract.BASIC_TAGS)
    ).drop("html")
    page = Page("parsed", F.col("url"))
    fields = extract.basic_fields(page)
    kinds = {
        "title": "string", "text": "string", "author": "string", "media_urls": "array",
        "selectors_used": "array",
    }
    rest = [c for c in captures.columns if c not in ("url", "html", "strategy")]
    flat = parsed.select(
        *rest, "url", "platform", "content_type", "strategy",
        *[fields[n].alias(f"f_{n}") for n in kinds],
    )
    record = normalize.normalize_fields(
        {n: (F.col(f"f_{n}"), k) for n, k in kinds.items()},
        platform=F.col("platform"), url=F.col("url"), strategy=F.col("strategy"),
        fallback=F.lit(False) if fallback is None else fallback,
        assisted=F.lit(False) if assisted is None else assisted,
        explicit={"author": F.lit(0.0)},
        pack_confidence=pack_confidence, content_type=F.col("content_type"),
    )
    return flat.select(*rest, record.alias("record"))


def scrape_results(captures: DataFrame) -> DataFrame:
    """The result envelope (F10) of every capture, good or bad.

    ``captures``: url, html, strategy, error struct(code, message) and anything
    else, which is kept.  Rejected URLs fail with the reason (D14), captures with
    a fetch error fail with that, all others succeed with their unified record.
    """
    rest = [c for c in captures.columns if c not in ("url", "html", "strategy", "error")]
    # Pages that fail anyway are not parsed.
    good = urls.reject_reason(F.col("url")).isNull() & F.col("error").isNull()
    rows = captures.select(
        *rest, "url", "strategy", F.when(good, F.col("html")).alias("html"),
        F.struct("error", urls.reject_reason(F.col("url")).alias("reject"), F.col("strategy").alias("by")).alias("fate"),
    )
    out = basic_records(rows)
    fate, record = F.col("fate"), F.col("record")
    success = fate.reject.isNull() & fate.error.isNull()
    tried = F.array(fate.by)
    rejected = scalars.error_record(
        F.lit("UnsupportedURLError"), fate.reject, record.url, F.array().cast("array<string>"),
        F.array().cast("array<string>"),
    )
    fetch = scalars.error_record(
        fate.error.code, fate.error.message, record.url, tried, F.array().cast("array<string>")
    )
    error = F.when(fate.reject.isNotNull(), rejected).otherwise(fetch)
    return out.select(
        *rest, record.url.alias("url"), success.alias("success"), F.when(success, record).alias("output"),
        F.when(~success, error).alias("error"),
    )


def domain_report(records: DataFrame) -> DataFrame:
    """Per domain: pages, pages with title and text, text volume, confidence."""
    r = F.col("record")
    filled = lambda c: F.count(F.when(F.trim(c) != "", F.lit(1)))
    return records.groupBy(urls.domain_of(r.url, keep_port=False).alias("domain")).agg(
        F.count(F.lit(1)).alias("pages"), filled(r.title).alias("with_title"), filled(r.text).alias("with_text"),
        F.sum(F.length(r.text)).alias("text_chars"),
        F.sum(r.confidence.cast("decimal(12,4)")).cast("double").alias("confidence_sum"),
        F.min(r.confidence).alias("min_confidence"), F.max(r.confidence).alias("max_confidence"),
    )
