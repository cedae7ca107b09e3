"""Pacing analysis over fetch logs (H4-H6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from webgrain.functions.gates import BLOCKING_STATUS
from webgrain.functions.text import let
from webgrain.operators import ordered
from webgrain.session import materialized

# --- fixed values -----------------------------------------------------------
DEFAULT_RATE = 1.0 / 3.0
# Requests per second, looked up by substring of the host in this order.
PLATFORM_RATES = {
    "instagram": 0.5, "x": 0.5, "twitter": 0.5, "tiktok": 0.5, "linkedin": 0.2,
    "facebook": 0.5, "youtube": 0.5,
}
WINDOW = 10
TARGET_LATENCY_MS = 1000.0
MIN_FACTOR, MAX_FACTOR = 0.5, 5.0
ERROR_RATE_THRESHOLD = 0.2
# Least seconds between two requests to a domain, and to any other.
LEAST_DELAYS = {
    "instagram.com": 1.0, "twitter.com": 1.0, "x.com": 1.0, "tiktok.com": 1.0, "linkedin.com": 2.0, "facebook.com": 1.0,
    "youtube.com": 0.5,
}
LEAST_DELAY = 0.5
SLOW_ERRORS = ["AntiBotDetectedError", "RateLimitExceededError"]
# --- end of fixed values ----------------------------------------------------


def pacing_factor(history: Column) -> Column:
    """H4: delay multiplier from the latest outcomes, oldest first.

    Each outcome is struct(ok, latency_ms, status, error).
    """
    def mean(value: Callable[[Column], Column]) -> Column:
        return F.aggregate(history, F.lit(0.0), lambda a, o: a + value(o)) / F.size(history)

    return let(
        F.struct(
            F.element_at(history, -1).alias("last"),
            mean(lambda o: F.when(o.ok, 0.0).otherwise(1.0)).alias("errors"),
            mean(lambda o: o.latency_ms).alias("latency"),
        ),
        lambda s: _factor(s["last"], s.errors, s.latency),
    )


def _factor(last: Column, rate: Column, latency: Column) -> Column:
    factor = F.when(rate > ERROR_RATE_THRESHOLD, 1.0 + rate * 2.0).otherwise(F.lit(1.0))
    factor = factor * F.when(last.status.isin(BLOCKING_STATUS), 1.5).otherwise(1.0)
    factor = factor * F.when(last.error.isin(SLOW_ERRORS), 2.0).otherwise(1.0)
    factor = factor * F.when(
        latency > TARGET_LATENCY_MS, F.least(F.lit(3.0), latency / TARGET_LATENCY_MS)
    ).otherwise(1.0)
    return F.greatest(F.lit(MIN_FACTOR), F.least(F.lit(MAX_FACTOR), factor))


def outcome_struct() -> Column:
    return F.struct("ok", "latency_ms", "status", "error")


def with_pacing(outcomes: DataFrame, *, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """H4: add ``factor`` after every outcome.

    ``outcomes``: host, ts, seq, ok, latency_ms, status, error.
    """
    rows = ordered.with_history(outcomes, ["host"], ["ts", "seq"], outcome_struct(), WINDOW, "recent", hot_rows)
    return rows.withColumn("factor", pacing_factor(F.col("recent"))).drop("recent")


def base_rate(host: Column, overrides: dict[str, float] | None = None) -> Column:
    """H5: requests per second: exact host, platform override, platform default, else 1/3.

    The platform is the first whose name occurs in the host ('x' fits widely).
    """
    overrides = overrides or {}
    platform_rate = F.lit(DEFAULT_RATE)
    for name, rate in reversed(PLATFORM_RATES.items()):
        platform_rate = F.when(host.contains(name), overrides.get(name, rate)).otherwise(platform_rate)
    out = platform_rate
    for name, rate in overrides.items():
        out = F.when(host == name, rate).otherwise(out)
    return out


def polite_schedule(queue: DataFrame, *, order: list[str],
                    overrides: dict[str, float] | None = None, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """H6: seconds after which each queued request of a host may start.

    ``queue``: host, factor and the order columns.  Every request waits for the
    intervals of those before it, factor / rate each and never under the host's
    least delay (N6), so starts never go back when the factor varies.
    """
    interval = F.greatest(F.coalesce("factor", F.lit(1.0)) / base_rate(F.col("host"), overrides), least_delay(F.col("host")))
    return ordered.with_running(queue, ["host"], order, {"not_before_s": interval}, hot_rows)


def arrival_schedule(requests: DataFrame, *, order: list[str], capacity: int = 1, overrides: dict[str, float] | None = None,
                     hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """H6 with arrivals and bursts: ``start_s``, when each request of a host may start.

    ``requests``: host, arrival_s, factor and the order columns.  Up to ``capacity`` requests may start at once:
    each starts when it has arrived, and not before the one ``capacity`` places ahead of it has
    started and waited its own interval (factor / rate, never under the least delay).  Along every
    ``capacity``-th request that is start = max(arrival, start before + interval before), so with D the
    running sum of intervals start - D is a running maximum of arrival - D: two passes of mergeable state, however
    long a host's queue is.
    """
    if capacity < 1:
        raise ValueError("at least one request at a time")
    interval = F.greatest(F.coalesce("factor", F.lit(1.0)) / base_rate(F.col("host"), overrides), least_delay(F.col("host")))
    rows, lane = requests, []
    if capacity > 1:
        rows = materialized(ordered.with_running(rows, ["host"], order, {"__place": F.lit(1)}, hot_rows), "places")
        rows, lane = rows.withColumn("__lane", F.col("__place") % capacity), ["__lane"]
    rows = materialized(ordered.with_running(rows, ["host", *lane], order, {"__waited": interval}, hot_rows), "waits")
    ahead = F.col("arrival_s") - F.col("__waited")
    rows = ordered.with_running_max(rows, ["host", *lane], order, ahead, "__ahead", hot_rows)
    return rows.select(*requests.columns, (F.col("__ahead") + F.col("__waited")).alias("start_s"))


def least_delay(host: Column) -> Column:
    """Seconds between requests that no override goes below; looked up by domain, subdomains included."""
    out = F.lit(LEAST_DELAY)
    for domain, seconds in LEAST_DELAYS.items():
        out = F.when((host == domain) | host.endswith(f".{domain}"), seconds).otherwise(out)
    return out
