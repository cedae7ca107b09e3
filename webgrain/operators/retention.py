"""Robots rules, retention, export and deletion over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webgrain.functions.urls import domain_of
from webgrain.operators.ordered import latest
from webgrain.session import materialized
from webgrain.sources.tables import audit_lines


def allowed_by_robots(urls: DataFrame, rules: DataFrame, *, key: str, url: str = "url") -> DataFrame:
    """Add ``allowed``: the longest rule that is a prefix of the path decides; allow wins ties.

    ``rules``: host, prefix, allow, of the user agent in question.  ``key`` names a
    unique column.  A URL meets rules by equality of (host, prefix): its path is
    expanded to the prefix lengths that its host's rules have, so nothing is
    compared with a whole rule list.  Without a rule everything is allowed.
    """
    # Stored, so that each join is one of two plain shuffles: a host of many URLs is split.
    rules = materialized(rules.select("host", "prefix", "allow"), "prefix-rules")
    lengths = materialized(rules.groupBy("host").agg(F.collect_set(F.char_length("prefix")).alias("lengths")), "prefix-lengths")
    path = F.regexp_extract(F.col(url), r"^[a-z]+://[^/?#]*([^#]*)", 1)
    rows = urls.select(
        key, domain_of(F.col(url)).alias("host"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("path"))
    parts = rows.join(lengths, "host").select(
        key, "host", "path", F.explode("lengths").alias("size")).filter(F.col("size") <= F.char_length("path"))
    hits = parts.withColumn("prefix", F.expr("left(path, size)")).join(rules, ["host", "prefix"])
    verdict = latest(hits.select(key, "size", "allow"), [key], ["size", "allow"]).select(key, F.col("allow").alias("allowed"))
    return urls.join(verdict, key, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """(host, pattern, allow) of the groups that ``agent`` obeys: those that name it, any case, else those of ``*``.

    ``rules``: host, agent, pattern, allow.  The groups of one name count as one; hosts without a group
    for the agent or ``*`` have no rules.  An empty pattern says nothing.
    """
    named = F.lower(F.col("agent")) == agent.lower()
    held = rules.where(named | (F.col("agent") == "*")).withColumn("__own", named)
    best = materialized(held.groupBy("host").agg(F.max("__own").alias("__best")).withColumnRenamed("host", "__host"), "robots-groups")
    own = held.join(best, F.col("host").eqNullSafe(F.col("__host"))).where(F.col("__own") == F.col("__best"))
    return own.where("pattern <> ''").select("host", "pattern", "allow").distinct()


def robots_verdicts(urls: DataFrame, rules: DataFrame, agent: str, *, key: str, url: str = "url") -> DataFrame:
    """N3 with agents and wildcards: add ``allowed``.

    In a pattern ``*`` stands for anything and ``$`` at its end for the end of the path (with its query).  Of all that
    match the longest pattern decides, counted in octets; allow wins ties; without one everything is
    allowed.  A pattern is filed by what stands before its first ``*``: a path meets it by equality of
    host and that piece, expanded to the lengths that the host's rules have, and only those that
    meet are matched.  ``key`` names a unique column.  NULL URLs are allowed.
    """
    pattern = F.col("pattern")
    piece = F.regexp_extract(pattern, r"^([^*]*?)(?:\*|\$$|$)", 1)
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"[^*]+", r"\\Q$0\\E")
    wild = F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))
    filed = agent_rules(rules, agent).select(
        F.col("host").alias("__host"), piece.alias("piece"), F.octet_length("pattern").alias("size"), "allow",
        F.when(pattern.contains("*") | pattern.endswith("$"), wild).alias("regex"))
    filed = materialized(filed, "robots-rules")
    lengths = filed.groupBy("__host").agg(F.collect_set(F.char_length("piece")).alias("lengths"))
    # Stored, so that the rows of a host that holds a third of all URLs are split.
    lengths = materialized(lengths, "robots-lengths")
    path = F.regexp_extract(F.col(url), r"^[a-z]+://[^/?#]*([^#]*)", 1)
    rows = urls.select(
        F.col(key).alias("__key"), domain_of(F.col(url)).alias("host"),
        F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("path"))
    parts = rows.join(lengths, F.col("host") == F.col("__host")).select(
        "__key", "host", "path", F.explode("lengths").alias("length")).where(F.col("length") <= F.char_length("path"))
    parts = parts.withColumn("start", F.expr("left(path, length)"))
    met = parts.join(filed, (F.col("host") == F.col("__host")) & (F.col("start") == F.col("piece")))
    hits = met.where(F.col("regex").isNull() | F.rlike(F.col("path"), F.col("regex")))
    verdict = hits.groupBy("__key").agg(F.max(F.struct("size", "allow")).alias("best"))
    out = urls.join(verdict, F.col(key) == F.col("__key"), "left")
    return out.select(*urls.columns, F.coalesce(F.col("best.allow"), F.lit(True)).alias("allowed"))


def of_domain(stored: DataFrame, domain: Column | str, url: str = "url") -> DataFrame:
    """Everything stored about a domain, for export."""
    return stored.filter(domain_of(F.col(url)) == domain)


def without_domain(stored: DataFrame, domain: Column | str, url: str = "url") -> DataFrame:
    """What stays after the domain's rows are deleted; rows without a readable URL stay."""
    return stored.filter(~F.coalesce(domain_of(F.col(url)) == domain, F.lit(False)))


def retained(stored: DataFrame, days: int, now: Column, ts: str = "created_at") -> DataFrame:
    """Rows not older than ``days``; rows without a time stay."""
    return stored.filter(F.coalesce(F.col(ts) >= now - F.make_dt_interval(F.lit(days)), F.lit(True)))


def rewrite(kept: DataFrame, path: str, removed: DataFrame | None = None, audit_path: str | None = None) -> None:
    """Write the kept rows to a new place, and one audit line for each removed row.

    A table is never overwritten while it is read: point readers to the new place afterwards.
    """
    kept.write.mode("errorifexists").parquet(path)
    if removed is not None and audit_path is not None:
        audit_lines(removed, "deleted").write.mode("append").text(audit_path)
