"""Structural drift between successive captures of a page (C17, H1-H3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webgrain.functions.scalars import CRITICAL_FIELDS
from webgrain.operators import ordered

SIZE_THRESHOLD = 0.3
# Columns that describe the page of an alert.
ABOUT = ["platform", "content_type"]


def fingerprint(skeleton: Column) -> Column:
    """C17: hash of tags and attribute names."""
    return F.sha2(F.regexp_replace(skeleton, r"\s+", " "), 256)


def degraded_fields(before: Column, now: Column) -> Column:
    """H2: fields that vanished, or matched before and do not match now.

    Both sides are ``map<field, struct(selector, matched, confidence)>``; the
    page-wide entry ``_page`` is not looked at.
    """
    lost = F.filter(
        F.map_entries(before),
        lambda e: (e.key != "_page")
        & (now[e.key].isNull() | (e.value.matched & ~now[e.key].matched)),
    )
    return F.transform(
        lost, lambda e: F.struct(e.key.alias("field"), e.value.selector.alias("selector"))
    )


def content_changed(before: Column, now: Column) -> Column:
    """H3: both hashes known and different, so any edit counts."""
    return F.coalesce(before != now, F.lit(False))


def drift_alert(prev: Column, cur: Column, threshold: float = SIZE_THRESHOLD) -> Column:
    """H1: compare two baselines, each struct(id, fp, snapshot, hash, size).

    struct(alert_type, severity, baseline_id, old_fingerprint, new_fingerprint,
    degraded, lost_fields, baseline_size, current_size, delta_ratio), or NULL when
    nothing moved or there is no earlier capture.  The details of a kind of change
    are NULL unless the alert is of that kind.
    """
    degraded = degraded_fields(prev.snapshot, cur.snapshot)
    structural = prev.fp != cur.fp
    selectors = F.coalesce(F.size(degraded) > 0, F.lit(False))
    loss = content_changed(prev.hash, cur.hash)
    delta = F.when(prev.size > 0, F.abs(cur.size - prev.size) / prev.size)
    size = F.coalesce(delta > threshold, F.lit(False))
    kinds = F.concat_ws(
        ",",
        F.when(structural, "structural_change"),
        F.when(selectors, "selector_degradation"),
        F.when(loss, "field_loss"),
        F.when(size, "size_anomaly"),
    )
    return F.when(
        prev.isNotNull() & (kinds != ""),
        F.struct(
            kinds.alias("alert_type"),
            F.when(loss, "critical").otherwise("warning").alias("severity"),
            prev.id.alias("baseline_id"),
            F.when(structural, prev.fp).alias("old_fingerprint"),
            F.when(structural, cur.fp).alias("new_fingerprint"),
            F.when(selectors, degraded).alias("degraded"),
            F.when(loss, F.array(*[F.lit(f) for f in CRITICAL_FIELDS])).alias("lost_fields"),
            F.when(size, prev.size).alias("baseline_size"),
            F.when(size, cur.size).alias("current_size"),
            F.when(size, F.round(delta, 3)).alias("delta_ratio"),
        ),
    )


def baseline_struct() -> Column:
    """The compared part of a capture row."""
    return F.struct(F.col("seq").alias("id"), "fp", "snapshot", "hash", "size")


def drift_alerts(captures: DataFrame, *, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """H1 in batch: alert rows for all captures that differ from the one before.

    ``captures``: url, ts, seq, fp, snapshot, hash, size, best a stored table, since
    it is read twice (state per time slice, then the rows); platform and
    content_type go into the alert where they are given.  "Before" means by
    (ts, seq).  The first capture of a URL only becomes the baseline.
    """
    paired = ordered.with_last(captures, ["url"], ["ts", "seq"], baseline_struct(), "prev", hot_rows)
    return (
        paired.withColumn("alert", drift_alert(F.col("prev"), baseline_struct()))
        .filter(F.col("alert").isNotNull())
        .select("url", "ts", "seq", *[c for c in ABOUT if c in captures.columns], "alert.*")
    )
