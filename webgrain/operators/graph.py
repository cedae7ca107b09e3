"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webgrain.session import materialized

# Rows of two short columns that one task may hold.
ONE_TASK = 200_000


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A stored table; in one partition if it is small, so that late rounds need no exchange."""
    kept = materialized(df, name)
    return kept.coalesce(1) if kept.count() <= ONE_TASK else kept


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of a link (a, b); component is the smallest node that it reaches.

    Every round hooks each node to the neighbour that comes first in an order drawn anew,
    itself included, and contracts the links; whatever the graph, a constant share of
    the nodes is expected to go in a round.  Rows with a NULL end and links of a node to itself are
    ignored.  A round aggregates and joins by node; nothing is collected.
    """
    edges = _stored(links.where("a < b OR b < a").select("a", "b"), "links")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(hooks)), c).alias("r"), F.col(c).alias("node"))  # noqa: B023, E731
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("best")).select("a", F.least("best", rank("a")).getField("node").alias("up"))
        hook = _stored(hook, "hooks")
        hooks.append(hook)
        moved = edges.join(hook, "a").select("b", F.col("up").alias("u"))
        moved = moved.join(hook.select(F.col("a").alias("b"), F.col("up").alias("v")), "b")
        edges = _stored(moved.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "links")
    if not hooks:
        return links.where("false").select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = hooks.pop()
    while hooks:
        above = found.select(F.col("a").alias("up"), F.col("up").alias("top"))
        found = hooks.pop().join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up"))
    found = materialized(found, "roots")
    least = materialized(found.groupBy("up").agg(F.min("a").alias("component")), "least-nodes")
    return found.join(least, "up").select(F.col("a").alias("node"), "component")
