"""Link candidates and rule-pack routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webgrain.functions import urls
from webgrain.functions.text import strip
from webgrain.operators import ordered
from webgrain.session import materialized

# --- fixed values -----------------------------------------------------------
BLOCKED_HOSTS = [
    "youtube.com", "youtu.be", "facebook.com", "instagram.com",
    "tiktok.com", "twitter.com", "x.com", "linkedin.com",
]
# --- end of fixed values ----------------------------------------------------


def usable_link(url: Column) -> Column:
    """http(s), with a host that is not blocked."""
    host = urls.domain_of(url, keep_port=False)
    return (
        urls.scheme_of(url).isin("http", "https")
        & (urls.netloc_of(url) != "") & (host != "") & ~host.isin(BLOCKED_HOSTS)
    )


def ranked_links(links: DataFrame, *, top: int | None = None, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """Usable links per query, first occurrence only, ranked densely from 0.

    ``links``: query, seq, url, title, snippet.
    """
    clean = links.withColumn("url", strip(F.col("url"))).filter(usable_link(F.col("url")))
    rest = [c for c in links.columns if c not in ("query", "url", "seq")]
    first = clean.groupBy("query", "url").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct(*rest), "seq").alias("__rest")
    ).select("query", "seq", "url", "__rest.*")
    # Stored once: the ranking reads the distinct links more than once.
    first = materialized(first, "links")
    out = ordered.with_running(first, ["query"], ["seq"], {"rank": F.lit(1)}, hot_rows)
    return out if top is None else out.filter(F.col("rank") < top)


def route_to_pack(url: Column, packs: list) -> Column:
    """Name of the first non-generic pack with a matching pattern.

    Packs are few and known when the job is planned, so the choice is one CASE
    over anchored patterns rather than a join.  Packs registered later replace
    earlier ones of the same platform, while the earlier patterns keep routing:
    the pack that answers is the platform's current one.
    """
    current = {}
    for pack in packs:
        for platform in pack.platforms:
            current[platform] = pack
    ladder = None
    for pack in packs:
        if "generic" in pack.platforms:
            continue
        hit = url.rlike("(?i)^(?:" + "|".join(pack.url_patterns) + ")")
        name = current[pack.platforms[0]].name
        ladder = F.when(hit, name) if ladder is None else ladder.when(hit, name)
    return ladder if ladder is not None else F.lit(None).cast("string")


# --- B7 for any number of packs -------------------------------------------------------
# What a URL pattern says before its path, where it is ``https?://host/…`` with a host that cannot run over a slash.
_HOST_PART = r"^https?\??://((?:\[[^\]]*\]|\\.|[^/\[\\])*)/"
_HOST_TOKENS = r"^(?:\(\?:|[()|?*+a-zA-Z0-9-]|\\[.wd-]|\[\^[^\]]*/[^\]]*\]|\[[^\]^/][^\]/]*\]|\{\d+(?:,\d*)?\})*$"
_LITERAL_END = r"((?:[a-zA-Z0-9-]|\\\.)+)$"


def literal_suffix(pattern: Column) -> Column:
    """The labels that the host of every URL that ``pattern`` matches ends in; '' if the pattern does not say so plainly."""
    host = F.regexp_extract(pattern, _HOST_PART, 1)
    # A choice between whole patterns has no one host.
    whole = ~F.regexp_replace(pattern, r"\((?:[^()]|\([^()]*\))*\)", "").contains("|")
    end = F.regexp_extract(host, _LITERAL_END, 1)
    before = F.left(host, F.char_length(host) - F.char_length(end))
    bounded = (before == "") | before.rlike(r"\\\.\)?[?*+]?$")
    plain = F.lower(F.replace(end, F.lit("\\."), F.lit(".")))
    later = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"^[^.]*\.", "")).otherwise(F.lit(""))
    known = F.coalesce((host != "") & host.rlike(_HOST_TOKENS) & whole, F.lit(False))
    return F.when(known, F.regexp_replace(F.when(bounded, plain).otherwise(later), r"^\.", "")).otherwise(F.lit(""))


def pack_patterns(spark: SparkSession, packs: list) -> DataFrame:
    """(priority, pack, pattern) of packs that are known to the driver, in the order in which ``route_to_pack`` tries them."""
    current = {platform: pack for pack in packs for platform in pack.platforms}
    rows = [(i, current[p.platforms[0]].name, pattern) for i, p in enumerate(packs) if "generic" not in p.platforms for pattern in p.url_patterns]
    return spark.createDataFrame(rows, "priority long, pack string, pattern string")


def route_by_suffix(rows: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """B7/I2 for thousands of packs: ``rows`` with ``pack``, the first by priority of which a pattern matches.

    ``patterns``: priority, pack, pattern (anchored at the start, any case).  Patterns are filed by the literal end of
    their host.  Every host of ``rows``, once, looks up its own ends, label by label, so a URL is compared only
    with patterns of its host's; those that name no host are compared with all.  Equal priorities go by name.
    """
    filed = materialized(patterns.select(
        literal_suffix(F.col("pattern")).alias("end"), F.struct("priority", "pack", F.concat(F.lit("(?i)^(?:"), "pattern", F.lit(")")).alias("pattern")).alias("rule")), "filed-patterns")
    # As long as it is a host at all; user names and ports are part of what patterns see.
    host = F.lower(F.regexp_extract(F.col(url), r"^[^:/?#]+://([^/?#]*)", 1))
    given = rows.withColumn("__host", host)
    labels = F.split("__host", r"\.")
    ends = F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    hosts = given.select("__host").where("__host IS NOT NULL").distinct().select("__host", F.explode(F.array_distinct(ends)).alias("end"))
    found = hosts.join(filed, "end").groupBy("__host").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    # Stored, so that the join is one of two plain shuffles: a host of many rows is split, or the routes are broadcast if they are few.
    found = materialized(found.withColumnRenamed("__host", "__of"), "routes")
    met = given.join(found, F.col("__host") == F.col("__of"), "left")
    hits = F.filter("rules", lambda r: F.rlike(F.col(url), r.pattern))
    return met.select(*rows.columns, F.get(hits, F.lit(0)).getField("pack").alias("pack"))


def uncovered(links: DataFrame, packs: list, url: str = "url") -> DataFrame:
    """I8: candidates that no specific pack covers yet."""
    return links.filter(route_to_pack(F.col(url), packs).isNull())
