"""Request and response tables for model enrichment.

No model is called here: requests go out as a table and answers come back as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from webgrain.functions import scalars
from webgrain.functions.gates import needs_enrichment
from webgrain.functions.text import strip
from webgrain.operators import ordered
from webgrain.operators.extract import html_chunks
from webgrain.operators.normalize import merge_answers
from webgrain.operators.repeats import split_repeats
from webgrain.schemas import ANSWER_FIELDS
from webgrain.session import materialized

# --- fixed values -----------------------------------------------------------
SYSTEM_PROMPT = (
    "You are an expert web data extraction engine. "
    "Your task is to parse HTML and extract structured data. "
    "Extract ONLY the requested fields. Be precise. "
    "Return valid JSON matching the provided schema. "
    "Do not hallucinate data -- if a field is not found, return null."
)
CACHE_TTL_SECONDS = 3600
# --- end of fixed values ----------------------------------------------------


def user_prompt(url: Column, platform: Column, content_type: Column, schema_text: Column,
                chunk: Column) -> Column:
    """The request text for one chunk."""
    return F.concat(
        F.lit("Extract data from this HTML page.\n\nURL: "), url, F.lit("\nPlatform: "), platform,
        F.lit("\nContent Type: "), content_type, F.lit("\n\nHTML:\n```html\n"), chunk,
        F.lit("\n```\n\nExtract the following fields as JSON:\n"), schema_text,
        F.lit("\n\nReturn ONLY valid JSON. No markdown, no explanation."),
    )


def lacking_pages(pages: DataFrame, schema_text: str) -> DataFrame:
    """M1: (page_id, cache_key) of all pages that lack a critical field, as a stored table.

    The one pass that needs the parsed fields.  It maps a content to all its pages, for
    ``request_table`` and ``merge_chunks`` alike.
    """
    lacking = pages.filter(needs_enrichment(F.col("text"), F.col("title"), F.col("author")))
    return materialized(
        lacking.select("page_id", scalars.cache_key(F.col("html"), F.lit(schema_text)).alias("cache_key")), "lacking")


def request_key(cache_key: Column, chunk_no: Column) -> Column:
    """M1/H8: key of one request: a content and the chunk of it that is asked about."""
    return F.sha2(F.concat(cache_key, F.lit(":"), chunk_no.cast("string")), 256)


def request_table(pages: DataFrame, schema_text: str, lacking: DataFrame | None = None) -> DataFrame:
    """M1: one request per chunk of every distinct page content that lacks a critical field.

    ``pages``: page_id, url, platform, content_type, html, and title, text, author
    unless ``lacking`` (of ``lacking_pages``) is given.  Pages with the same content
    share a cache key; the first page_id stands for them, and ``pages`` counts how
    many there are.  Without ``lacking`` a page body moves only if its content may repeat; with it,
    keys alone are aggregated and the bodies of the first pages are looked up by page_id.  A page without
    html keeps a row without prompt.
    """
    about = ["page_id", "url", "platform", "content_type", "html"]
    if lacking is None:
        lacks = needs_enrichment(F.col("text"), F.col("title"), F.col("author"))
        key = scalars.cache_key(F.col("html"), F.lit(schema_text)).alias("cache_key")
        once, again = split_repeats(pages, F.xxhash64("html"))
        met = once.where(lacks).select(key, F.lit(1).cast("long").alias("pages"), *about)
        if again is not None:
            groups = again.where(lacks).select(key, *about).groupBy("cache_key").agg(
                F.count(F.lit(1)).alias("pages"), F.min_by(F.struct(*about), "page_id").alias("first"))
            met = met.unionByName(groups.select("cache_key", "pages", "first.*"))
    else:
        firsts = lacking.groupBy("cache_key").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("pages"))
        met = pages.select(*about).join(firsts, "page_id")
    rows = met.select(
        "cache_key", "page_id", "pages", "url", "platform", "content_type",
        F.posexplode(F.coalesce(html_chunks(F.col("html")), F.array(F.lit(None).cast("string")))).alias("chunk_no", "chunk"),
    ).withColumn("request_key", request_key(F.col("cache_key"), F.col("chunk_no")))
    prompt = user_prompt(
        F.col("url"), F.col("platform"), F.col("content_type"), F.lit(schema_text), F.col("chunk")
    )
    return rows.withColumn("prompt", prompt).withColumn(
        "token_estimate", scalars.token_estimate(F.concat(F.lit(SYSTEM_PROMPT), F.col("prompt")))
    ).drop("chunk")


def within_budget(costs: DataFrame, cap: float, *, job: str = "job", seq: str = "seq",
                  cost: str = "cost", hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """H7: add ``allowed``: the cost of all earlier requests is below the cap (0 = no cap)."""
    rows = ordered.with_running(costs, [job], [seq], {"spent_before": F.col(cost)}, hot_rows)
    return rows.withColumn("allowed", F.lit(cap <= 0) | (F.col("spent_before") < cap))


def with_cached(requests: DataFrame, responses: DataFrame, *, ttl_seconds: int = CACHE_TTL_SECONDS,
                hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """As-of look-up of the latest stored response that is not too old.

    ``requests``: cache_key, seq, ts; ``responses``: cache_key, ts, body.  Give the
    ``request_key`` of M1 as ``cache_key`` where pages have several chunks.  A
    response counts while its age is at most the TTL.  Both sides are lined up
    in one ordered stream per key, so a popular key neither multiplies rows nor
    lands in one task.
    """
    body = F.struct("ts", "body")
    asked = requests.select("cache_key", "ts", "seq", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("body"))
    stored = responses.select("cache_key", "ts", F.lit(None).cast("bigint").alias("seq"), F.lit(0).alias("kind"), "body")
    lined = ordered.with_last(
        stored.unionByName(asked), ["cache_key"],
        ["ts", "kind", "seq", "body"], F.when(F.col("kind") == 0, body), "hit", hot_rows,
    ).filter(F.col("kind") == 1)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = micros("ts") - micros("hit.ts")
    return lined.select(
        "cache_key", "seq", "ts",
        F.when(age <= ttl_seconds * 1_000_000, F.col("hit.body")).alias("cached_body"),
        F.coalesce(age <= ttl_seconds * 1_000_000, F.lit(False)).alias("reused"),
    )


def response_table(responses: DataFrame, body: str = "body") -> DataFrame:
    """M2: answers to typed columns; ``parsed`` tells unusable answers apart."""
    value = F.col("__answer")
    columns = []
    for name, kind in ANSWER_FIELDS.items():
        if kind == "timestamp":
            column = scalars.parse_timestamp(scalars.json_text(value, f"$.{name}"))
        else:
            column = F.try_variant_get(value, f"$.{name}", kind)
        columns.append(column.alias(name))
    parsed = responses.withColumn("__answer", scalars.tolerant_json(F.col(body)))
    keep = [c for c in responses.columns if c != body]
    return parsed.select(*keep, value.isNotNull().alias("parsed"), *columns)


def fold_chunks(answers: DataFrame, fields: dict[str, str], key: str = "cache_key", order: str = "chunk_no") -> DataFrame:
    """M3: one row per content from the answers to its chunks.

    A field is the first value that is not NULL or blank, by chunk; lists are united
    in the order of the chunks.  Repeated answers to a chunk fold as well.
    """
    folded = []
    for name, kind in fields.items():
        if kind.startswith("array"):
            parts = F.array_sort(F.collect_list(F.when(F.size(name) > 0, F.struct(order, name))))
            folded.append(F.array_distinct(F.flatten(F.transform(parts, _field(name)))).alias(name))
        else:
            there = F.col(name).isNotNull() if kind != "string" else F.coalesce(strip(F.col(name)) != "", F.lit(False))
            folded.append(F.min_by(name, F.when(there, F.struct(order, name))).alias(name))
    return answers.groupBy(key).agg(*folded)


def _field(name: str) -> Callable[[Column], Column]:
    return lambda part: part[name]


def merge_chunks(pages: DataFrame, lacking: DataFrame, answers: DataFrame, fields: dict[str, str]) -> DataFrame:
    """M3: fill the gaps of every page from the answers to its content; one row per page.

    ``lacking``: page_id and cache_key of ``lacking_pages``; ``answers``: cache_key, chunk_no and the fields.
    """
    # Stored, so that the join is one of two plain shuffles: a content that many pages share is split.
    folded = materialized(fold_chunks(answers, fields), "folded-answers")
    by_page = lacking.select("page_id", "cache_key").join(folded, "cache_key").drop("cache_key")
    return merge_answers(pages, by_page, "page_id", fields)
