"""A mix of all sources at target weights, in words.

Method: subset-sum budget fitting.  Documents are counted by exact length, a
bounded-knapsack dynamic program fits what is left of a source's budget with
those counts, and the documents behind a count are chosen by a seeded hash.

A target above a source's size takes whole passes over the source first; the rest
of the budget is fitted.  Most of that rest is spread over all lengths in
proportion (so that the mix keeps the source's lengths), and the dynamic program
fills the last ``WINDOW`` words exactly where that is possible.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webgrain.llm.common import whole, word_count
from webgrain.session import materialized

WEIGHTS = (5, 2, 1)
MOST = 3  # times its size that a source may be taken
SEED = 7
# Words of a budget that the dynamic program fits; the rest is spread over all lengths.
WINDOW = 20_000
# Documents of one (source, length) that are ranked together.
BUCKET = 2_000


def shares(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` with ``target``: the weights' shares, none above ``most`` times its size.

    Each round fixes the sources that are above and shares what they leave by
    weight; a round is one small aggregate.
    """
    # One row per source.  Sources order by code point (UTF-8 bytes), NULL last.
    order = Window.orderBy(F.col("source").isNull(), "source")
    names = sources.withColumn("_n", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    names = materialized(names.select("source", "source_size", weight.alias("_w")), "sources")
    cap = F.col("source_size") * most
    total = names.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level = 0.0
    while True:
        held = cap <= F.col("_w") * F.lit(level)
        seen = names.agg(
            F.coalesce(F.sum(F.when(held, cap)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~held, F.col("_w"))), F.lit(0.0)).alias("weight")).first()
        if not seen["weight"]:
            break
        higher = (total - seen["capped"]) / seen["weight"]
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return names.select("source", "source_size", F.least(cap.cast("double"), F.col("_w") * F.lit(level)).alias("target"))


def spread_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that all lengths are taken in proportion, at most ``budget`` words in all.

    From the longest to the shortest; what rounding leaves over goes on to the next length.
    """
    taken = np.zeros_like(counts)
    words = int((lengths * counts).sum())
    if budget <= 0 or not words:
        return taken
    due = 0.0
    for i in np.argsort(-lengths, kind="stable"):
        due += int(lengths[i]) * int(counts[i]) * (budget / words)
        taken[i] = min(int(counts[i]), int(due // int(lengths[i])))
        due -= int(taken[i]) * int(lengths[i])
    return taken


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: counts of each length whose words come as near to ``budget`` from below as possible."""
    reach = np.full(budget + 1, -1, np.int64)  # the length index that reached a sum last; -2 for the empty sum
    reach[0] = -2
    uses = np.zeros(budget + 1, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        size, have = int(lengths[i]), int(counts[i])
        if not 0 < size <= budget or not have:
            continue
        # Sums that the lengths before reach need none of this one; the others one more than the sum ``size`` below.
        used = np.where(reach != -1, 0, have + 1)
        for at in range(size, budget + 1, size):
            new = used[at:at + size]
            more = used[at - size:at - size + len(new)] + 1
            better = (new > have) & (more <= have)
            new[better] = more[better]
        fresh = (reach == -1) & (used <= have)
        reach[fresh] = i
        uses[fresh] = used[fresh]
        if reach[budget] != -1:
            break
    out = np.zeros_like(counts)
    at = int(np.flatnonzero(reach != -1)[-1])
    while at:
        i = reach[at]
        out[i] += uses[at]
        at -= int(uses[at]) * int(lengths[i])
    return out


def chosen_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """Counts of each length to take for ``budget``, each at most what there is."""
    taken = spread_counts(lengths, counts, budget - window)
    left = budget - int((taken * lengths).sum())
    # Whole shares are below the budget less the window; only the rest of one document can add to it.
    if left > 2 * window:
        taken = taken + spread_counts(lengths, counts - taken, left - window)
        left = budget - int((taken * lengths).sum())
    return taken + fit_counts(lengths, counts - taken, min(left, 2 * window + int(lengths.max(initial=0))))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken and the source: one row for each row of ``docs``.

    ``taken`` is a whole multiple of ``size``, the words the mix takes of the row.
    A document without words (or NULL) has size 0 and is never taken.  NULL is a
    source of its own, after all others.  NULL ids take part.  Rows that agree in
    id, source and size are interchangeable; reruns then give the same rows.  A
    mix without any words has targets of 0; an empty table an empty result.  Extra
    columns are ignored.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, most, seed).drop("_text")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """``mix`` with a hash of each row's text."""
    rows = materialized(docs.select(
        F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"),
        F.xxhash64(whole(F.col(text_col))).alias("_text")), "sizes")
    # The null-safe key: a source and whether it is there.
    # Rows without id, or of one id, differ by their texts.
    rows = rows.select("doc_id", "size", "source", "_text", F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_no"),
                       F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "_text").alias("_h"))
    lengths = materialized(rows.groupBy("_s", "_no", "size").agg(F.count("*").alias("n")), "lengths")
    sources = lengths.groupBy("_s", "_no").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).select(
        F.when(~F.col("_no"), F.col("_s")).alias("source"), "source_size")
    targets = shares(sources, weights=weights, most=most).select(
        F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_no"), "source_size", "target")
    targets = materialized(targets.withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ).withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")), "targets")

    def choose(whole: pd.DataFrame) -> pd.DataFrame:
        # One source's lengths: as many rows as it has different lengths, never its documents.
        whole = whole.sort_values("size")
        take = chosen_counts(whole["size"].to_numpy(), whole["n"].to_numpy(), int(whole["budget"].iloc[0]))
        return whole[["_s", "_no", "size", "n"]].assign(k=take)

    counted = lengths.where("size > 0").join(targets.select("_s", "_no", "budget"), ["_s", "_no"])
    picked = materialized(counted.groupBy("_s", "_no").applyInPandas(
        choose, "_s string, _no boolean, size long, n long, k long"), "picked")
    # Equal lengths are ranked by hash, in buckets of bounded size: whole buckets first, one is cut.
    bucketed = picked.withColumn("_buckets", F.ceil(F.col("n") / BUCKET).cast("long"))
    placed = rows.where("size > 0").join(bucketed, ["_s", "_no", "size"]).withColumn(
        "_b", F.pmod(F.shiftright("_h", 20), F.col("_buckets")))
    fill = placed.groupBy("_s", "_no", "size", "_b").agg(F.count("*").alias("_c"), F.first("k").alias("_k"))
    before = Window.partitionBy("_s", "_no", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    fill = fill.withColumn("_room", F.col("_k") - F.coalesce(F.sum("_c").over(before), F.lit(0)))
    cut = materialized(fill.where("_room > 0 AND _room < _c").select("_s", "_no", "size", "_b", F.col("_room").alias("_cut")), "cut")
    wholly = materialized(fill.where("_room >= _c").select("_s", "_no", "size", "_b", F.lit(True).alias("_all")), "wholly")
    key = ["_s", "_no", "size", "_b"]
    inside = placed.join(cut, key)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_h", "doc_id"))
    some = inside.withColumn("_once", (rank <= F.col("_cut")).cast("long")).select("doc_id", "_text", *key, "_once")
    rest = placed.join(cut, key, "left_anti").join(wholly, key, "left").select(
        "doc_id", "_text", *key, F.when(F.col("_all"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("_once"))
    none = rows.where("size = 0").select("doc_id", "_text", "_s", "_no", "size", F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("_once"))
    out = some.unionByName(rest).unionByName(none).join(targets, ["_s", "_no"])
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("_once"))).alias("taken"),
        F.when(~F.col("_no"), F.col("_s")).alias("source"), "_text")


def take_mixed(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns.

    Rows meet their decision by id, source and a hash of the text, so rows without id, or of one id, are told
    apart and reruns take the same texts.  Of rows that agree in all three as many are taken as the mix says; which of
    them is left open.  Rows without words (or NULL) are never taken; an empty table stays empty.
    """
    taken = _mixed(docs, id_col, text_col, source_col, weights, most, seed)

    def key(doc: Column, source: Column) -> list[Column]:
        return [F.coalesce(doc.cast("long"), F.lit(0)).alias("_id"), doc.isNull().alias("_un"), F.coalesce(source, F.lit("")).alias("_s"),
                source.isNull().alias("_no")]

    times = taken.where("taken > 0").select(
        *key(F.col("doc_id"), F.col("source")), "size", "_text", (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    same = ["_id", "_un", "_s", "_no", "size", "_text"]
    times = materialized(times.groupBy(*same).agg(F.sort_array(F.collect_list("_times"), asc=False).alias("_times")), "times")
    mine = docs.select(
        F.struct("*").alias("_row"), *key(F.col(id_col), F.col(source_col).cast("string")), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(whole(F.col(text_col))).alias("_text"))
    # Rows that share all of these are numbered; as a rule there are none.
    repeated = materialized(mine.groupBy(*same).count().where("count > 1").select(*same), "repeated")
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    numbered = mine.join(repeated, same, "left_semi").withColumn("_nth", nth)
    plain = mine.join(repeated, same, "left_anti").withColumn("_nth", F.lit(1))
    met = plain.unionByName(numbered).join(times.hint("shuffle_hash"), same)
    each = met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.get("_times", F.col("_nth") - 1))))
    return each.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
