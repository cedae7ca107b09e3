"""Ordered per-key state that survives hot keys.

A plain window ``PARTITION BY key ORDER BY ts`` sends one key to one task.  One
host or URL may hold a third of all rows, so every function here first counts
rows per key (a map-side aggregate over the key columns alone).  The rows of keys
with more than ``hot_rows`` rows are range-partitioned by (key, order), which cuts
those keys into slices of about half of ``hot_rows`` rows, wherever in time they
lie, and stored once.  Rows are windowed inside (key, slice).  The state at the end of
every slice is one row; those rows are such a table again, and the same function
carries the state over them, level by level, until a key's slices fit one task.
All other keys are windowed whole.

The hot keys, at most (all rows / ``hot_rows``) of them, are written to the
shared folder before the plan is built, so that the planner knows their size:
below Spark's threshold they are broadcast, beyond it they are joined by a shuffle.
Inputs should be stored tables, as they are read more than once.

NULL is a key like any other.  Rows that agree in key and all order columns stay in
one slice; give enough order columns to tell rows apart.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.window import WindowSpec

from webgrain.functions.text import let
from webgrain.session import materialized

_SLICE, _AT, _PAYLOAD, _LOCAL, _TAIL, _CARRY = "__slice", "__at", "__payload", "__local", "__tail", "__carry"
# A key with more rows than this is cut into slices.
HOT_ROWS = 1_000_000
# Below this, levels of carried state would not shrink.
LEAST_HOT = 16


def _inside(keys: list[str], order: list[str]) -> WindowSpec:
    return W.partitionBy(*keys, _SLICE).orderBy(*order)


def _beside(right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that they are the same, NULL included."""
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    return right.withColumnsRenamed(names), reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])


def _cut(df: DataFrame, keys: list[str], order: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their slice (0 for keys that stay whole), and those of hot keys, if any."""
    hot_rows = max(hot_rows, LEAST_HOT)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    hot = materialized(counts, "hot-keys")
    rows = hot.agg(F.sum("__n")).first()[0]
    if not rows:
        return df.withColumn(_SLICE, F.lit(0).cast("bigint")), None
    marks, same = _beside(hot.drop("__n"), keys)
    whole = df.join(marks, same, "left_anti").withColumn(_SLICE, F.lit(0).cast("bigint"))
    sliced = df.join(marks, same, "left_semi").repartitionByRange(-(-2 * rows // hot_rows), *keys, *order)
    sliced = materialized(sliced.withColumn(_SLICE, F.spark_partition_id().cast("bigint") + 1), "slices")
    return whole.unionByName(sliced), sliced


def _carried(rows: DataFrame, carry: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with the state carried into their slice; NULLs where nothing was."""
    right, same = _beside(carry.select(*keys, F.col(_AT).alias("__into"), *columns), keys)
    return rows.join(right, same & (F.col(_SLICE) == F.col("__into")), "left")


def with_last(df: DataFrame, keys: list[str], order: list[str], payload: Column, name: str,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the last non-NULL ``payload`` of the key's earlier rows."""
    rows, hot = _cut(df.withColumn(_PAYLOAD, payload), keys, order, hot_rows)
    before = _inside(keys, order).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn(_LOCAL, F.last(_PAYLOAD, ignorenulls=True).over(before))
    if hot is None:
        return local.withColumn(name, F.col(_LOCAL)).select(*df.columns, name)
    when = F.when(F.col(_PAYLOAD).isNotNull(), F.struct(*order))
    tails = hot.groupBy(*keys, F.col(_SLICE).alias(_AT)).agg(F.max_by(_PAYLOAD, when).alias(_TAIL))
    carry = with_last(tails, keys, [_AT], F.col(_TAIL), _CARRY, hot_rows)
    out = _carried(local, carry, keys, [_CARRY])
    return out.withColumn(name, F.coalesce(_LOCAL, _CARRY)).select(*df.columns, name)


def _tail_of(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n, F.lit(0)) + 1, F.lit(n))


def with_history(df: DataFrame, keys: list[str], order: list[str], payload: Column, n: int, name: str,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the array of the ``n`` latest payloads up to and including the row, oldest first.

    The carried state is the top n rows per slice; Spark cuts those down before
    the shuffle.
    """
    rows, hot = _cut(df.withColumn(_PAYLOAD, payload), keys, order, hot_rows)
    local = rows.withColumn(
        _LOCAL, F.collect_list(_PAYLOAD).over(_inside(keys, order).rowsBetween(-(n - 1), 0))
    )
    if hot is None:
        return local.withColumn(name, F.col(_LOCAL)).select(*df.columns, name)
    newest = W.partitionBy(*keys, _SLICE).orderBy(*[F.desc(c) for c in order])
    tops = hot.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= n)
    held = F.array_sort(
        F.collect_list(F.struct("__n", _PAYLOAD)), lambda a, b: b["__n"] - a["__n"]
    )
    tails = tops.groupBy(*keys, F.col(_SLICE).alias(_AT)).agg(F.transform(held, lambda h: h[_PAYLOAD]).alias(_TAIL))
    # n earlier slices always hold n earlier rows, because no slice of a key is empty.
    carry = with_history(tails, keys, [_AT], F.col(_TAIL), n + 1, "__recent", hot_rows)
    earlier = F.slice("__recent", F.lit(1), F.size("__recent") - 1)
    carry = carry.withColumn(_CARRY, let(F.flatten(earlier), lambda v: _tail_of(v, n)))
    out = _carried(local, carry, keys, [_CARRY])
    merged = let(F.concat(_CARRY, _LOCAL), lambda v: _tail_of(v, n))
    return out.withColumn(name, F.coalesce(merged, _LOCAL)).select(*df.columns, name)


def with_running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add running sums over the key's earlier rows (the row itself not included)."""
    rows, hot = _cut(df, keys, order, hot_rows)
    zero = F.lit(0)
    before = _inside(keys, order).rowsBetween(W.unboundedPreceding, -1)
    for name, value in sums.items():
        rows = rows.withColumn(f"{_LOCAL}_{name}", F.coalesce(F.sum(value).over(before), zero))
    carries = {n: f"{_CARRY}_{n}" for n in sums}
    if hot is not None:
        totals = hot.groupBy(*keys, F.col(_SLICE).alias(_AT)).agg(*[F.sum(v).alias(f"{_TAIL}_{n}") for n, v in sums.items()])
        carry = with_running(totals, keys, [_AT], {c: F.col(f"{_TAIL}_{n}") for n, c in carries.items()}, hot_rows)
        rows = _carried(rows, carry, keys, list(carries.values()))
    for name, carry_name in carries.items():
        local = F.col(f"{_LOCAL}_{name}")
        rows = rows.withColumn(name, local if hot is None else F.coalesce(carry_name, zero) + local)
    return rows.select(*df.columns, *sums)


def with_running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
                     hot_rows: int = HOT_ROWS, inclusive: bool = True) -> DataFrame:
    """Add the largest ``value`` of the key's rows up to this one (or before it); NULL where there is none."""
    rows, hot = _cut(df.withColumn(_PAYLOAD, value), keys, order, hot_rows)
    upto = _inside(keys, order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumn(_LOCAL, F.max(_PAYLOAD).over(upto))
    if hot is None:
        return local.withColumn(name, F.col(_LOCAL)).select(*df.columns, name)
    tails = hot.groupBy(*keys, F.col(_SLICE).alias(_AT)).agg(F.max(_PAYLOAD).alias(_TAIL))
    carry = with_running_max(tails, keys, [_AT], F.col(_TAIL), _CARRY, hot_rows, inclusive=False)
    out = _carried(local, carry, keys, [_CARRY])
    return out.withColumn(name, F.greatest(_CARRY, _LOCAL)).select(*df.columns, name)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, as a mergeable aggregate: no window, and one row per key and task moves.

    The rows travel in struct buffers, so Spark sorts by key before it aggregates.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)
