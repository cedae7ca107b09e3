"""Roll-ups of fetch outcomes and selector results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values -----------------------------------------------------------
DEGRADED_BELOW = 0.5
DEGRADED_MIN_ATTEMPTS = 5
PROMPT_TOKEN_PRICE = 0.00001
COMPLETION_TOKEN_PRICE = 0.00003
# --- end of fixed values ----------------------------------------------------


def _count(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def domain_partials(outcomes: DataFrame) -> DataFrame:
    """Mergeable counters per domain, for one batch of outcomes.

    ``outcomes``: domain, ok, ts, seq, error_code, confidence.  Confidences are
    summed as decimals, so the sum does not depend on the order of merging.
    """
    ok = F.col("ok")
    return outcomes.groupBy("domain").agg(
        F.count(F.lit(1)).alias("attempts"),
        _count(ok).alias("successes"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max(F.when(~ok, F.col("ts"))).alias("last_failure"),
        F.max(
            F.when(~ok & F.col("error_code").isNotNull(), F.struct("ts", "seq", "error_code"))
        ).alias("last_error"),
        F.sum(F.when(ok, F.col("confidence").cast("decimal(12,8)"))).alias("confidence_sum"),
        _count(ok & F.col("confidence").isNotNull()).alias("confidence_count"),
    )


def fold_partials(partials: DataFrame) -> DataFrame:
    """Counters of any number of batches as those of one."""
    return partials.groupBy("domain").agg(
        F.sum("attempts").alias("attempts"), F.sum("successes").alias("successes"),
        F.max("last_success").alias("last_success"), F.max("last_failure").alias("last_failure"),
        F.max("last_error").alias("last_error"),
        F.sum("confidence_sum").cast("decimal(22,8)").alias("confidence_sum"),
        F.sum("confidence_count").alias("confidence_count"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """G1 from counters of any number of batches."""
    return _finish(fold_partials(partials))


def _finish(merged: DataFrame) -> DataFrame:
    return merged.select(
        "domain", "attempts", "successes", (F.col("attempts") - F.col("successes")).alias("failures"),
        F.round(F.col("successes") / F.col("attempts"), 3).alias("success_rate"),
        "last_success", "last_failure", F.col("last_error.error_code").alias("last_error_code"),
        F.when(
            F.col("confidence_count") > 0,
            F.round(F.col("confidence_sum") / F.col("confidence_count"), 4).cast("double"),
        ).alias("average_confidence"),
    )


def domain_rollup(outcomes: DataFrame) -> DataFrame:
    """G1: counts, rates and last events per domain.

    The average confidence is the exact mean over successes, whatever the order
    of arrival.  All parts are mergeable: hot domains combine map-side.
    """
    return _finish(domain_partials(outcomes))


def strategy_memory(outcomes: DataFrame) -> DataFrame:
    """Per (domain, strategy): did it ever work, and when last it did or did not."""
    ok = F.col("ok")
    return (
        outcomes.filter(F.col("strategy").isin("http", "browser"))
        .groupBy("domain", "strategy")
        .agg(
            F.bool_or(ok).alias("success"),
            F.max(F.when(ok, F.col("ts"))).alias("last_success"),
            F.max(F.when(~ok, F.col("ts"))).alias("last_failure"),
        )
    )


def domain_strategies(memory: DataFrame) -> DataFrame:
    """One row per domain (http_ok, browser_ok), the look-up side of F8."""
    return memory.groupBy("domain").agg(
        F.bool_or((F.col("strategy") == "http") & F.col("success")).alias("http_ok"),
        F.bool_or((F.col("strategy") == "browser") & F.col("success")).alias("browser_ok"),
    )


def selector_stats(events: DataFrame) -> DataFrame:
    """Per (domain, field, selector): attempts, successes, rate, last seen, last confidence."""
    matched = F.col("matched")
    return events.groupBy("domain", "field", "selector").agg(
        F.count(F.lit(1)).alias("attempts"),
        _count(matched).alias("successes"),
        F.round(_count(matched) / F.count(F.lit(1)), 3).alias("match_rate"),
        F.max("ts").alias("last_seen"),
        F.round(F.max_by("confidence", F.struct("ts", "seq")), 3).alias("confidence"),
        F.min("seq").alias("first_seq"),
    )


def best_selectors(stats: DataFrame) -> DataFrame:
    """Per (domain, field) the best selector: rate, then attempts, then first seen."""
    rank = F.struct("match_rate", "attempts", -F.col("first_seq"))
    return stats.groupBy("domain", "field").agg(F.max_by("selector", rank).alias("best_selector"))


def selector_health(events: DataFrame) -> DataFrame:
    """Per (platform, field, selector): successes, failures, total, rate, last seen."""
    matched = F.col("matched")
    return events.groupBy("platform", "field", "selector").agg(
        _count(matched).alias("successes"),
        _count(~matched).alias("failures"),
        F.count(F.lit(1)).alias("total"),
        F.round(_count(matched) / F.count(F.lit(1)), 3).alias("match_rate"),
        F.max("ts").alias("last_seen"),
    )


def is_degraded(threshold: float = DEGRADED_BELOW, min_attempts: int | None = None) -> Column:
    """Enough attempts and a rate strictly below the threshold (0 attempts means default)."""
    return (F.col("total") >= (min_attempts or DEGRADED_MIN_ATTEMPTS)) & (
        F.col("match_rate") < threshold
    )


def health_summary(health: DataFrame) -> DataFrame:
    """One row; zeros when there is nothing to report."""
    return health.agg(
        F.count(F.lit(1)).alias("total_selectors"),
        F.round(F.coalesce(F.avg("match_rate"), F.lit(0.0)), 3).alias("average_match_rate"),
        _count(is_degraded()).alias("degraded_count"),
    )


def batch_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, successful, failed."""
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("count"),
        _count(F.col("success")).alias("successful"),
        _count(~F.col("success")).alias("failed"),
    )


def usage_totals(responses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, reported tokens and cost.  Estimates are kept apart, not added."""
    prompt, done = (F.coalesce(c, F.lit(0)) for c in ("prompt_tokens", "completion_tokens"))
    return responses.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(prompt).alias("prompt_tokens"),
        F.sum(done).alias("completion_tokens"),
        F.sum(prompt + done).alias("total_tokens"),
        F.round(F.sum(prompt) * PROMPT_TOKEN_PRICE + F.sum(done) * COMPLETION_TOKEN_PRICE, 6).alias("cost_usd"),
    )
