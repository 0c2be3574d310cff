"""Runs, calls and stages: ledgers, running totals, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidary import fixed
from evidary.functions.labels import format_cost
from evidary.functions.text import strings
from evidary.operators.common import running_sums


def _spend() -> list[Column]:
    return [
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"),
        F.count_if(F.col("usd").isNull()).alias("unpriced_calls"),
    ]


def cost_ledger(calls: DataFrame, *keys: str) -> DataFrame:
    """Per role and in total: calls, tokens, priced spend, unpriced calls.

    The total's ``role`` is ``(all)``; ``keys`` (a run, say) group both.
    """
    by_role = calls.groupBy(*keys, "role").agg(*_spend())
    total = (
        by_role.groupBy(*keys)
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.sum("usd").alias("usd"),
            F.sum("unpriced_calls").alias("unpriced_calls"),
        )
        .withColumn("role", F.lit("(all)"))
    )
    both = by_role.unionByName(total.select(by_role.columns))
    return both.withColumn("display", format_cost("usd", "calls", "unpriced_calls"))


def call_totals(calls: DataFrame) -> DataFrame:
    """Totals of each run as of each call: tokens, spend, calls, unpriced."""
    zero = F.lit(0)
    return running_sums(
        calls,
        ["at", "call_id"],
        {
            "total_prompt_tokens": F.col("prompt_tokens"),
            "total_completion_tokens": F.col("completion_tokens"),
            "total_usd": F.coalesce("usd", F.lit(0.0)),
            "total_calls": F.lit(1),
            "unpriced_calls": F.when(F.col("usd").isNull(), F.lit(1)).otherwise(zero),
        },
        ["run_id"],
    )


def stage_durations(events: DataFrame) -> DataFrame:
    """Seconds between each stage's start and its finish.

    ``events`` is ``(run_id, node, kind, at)`` with kinds ``NodeStarted`` and ``NodeFinished``.
    """
    span = events.groupBy("run_id", "node").agg(
        F.min(F.when(F.col("kind") == "NodeStarted", F.col("at"))).alias("started"),
        F.max(F.when(F.col("kind") == "NodeFinished", F.col("at"))).alias("finished"),
    )
    seconds = F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return span.withColumn("seconds", F.when(seconds >= 0, seconds / F.lit(1_000_000.0)))


def furthest_stage(finished: DataFrame, stages: tuple[str, ...] = fixed.MILESTONES) -> DataFrame:
    """The furthest stage each run reached (G14): ``(run_id, node)`` in, one row per run out.

    ``stages`` names the stages in their order.
    """
    place = F.array_position(strings(stages), F.col("node")).cast("int")
    best = finished.groupBy("run_id").agg(F.max(F.struct(place.alias("p"), F.col("node").alias("node"))).alias("m"))
    return best.select(
        "run_id", F.when(F.col("m.p") > 0, F.col("m.node")).otherwise(F.lit("not started")).alias("reached")
    )


def request_statistics(requests: DataFrame) -> DataFrame:
    """Requests, cache hits and hit rate of a request log."""
    return requests.agg(
        F.count_if(~F.col("cache_hit")).alias("requests"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.sum("retries").alias("retries"),
        F.sum("bytes").alias("bytes_downloaded"),
    ).withColumn(
        "hit_rate",
        F.when(F.col("requests") + F.col("cache_hits") > 0, F.col("cache_hits") / (F.col("requests") + F.col("cache_hits"))).otherwise(0.0),
    )


def price_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Spend from a price table per role; a role without a price stays unpriced."""
    known = prices.select("role", "price_in", "price_out")
    usd = F.col("prompt_tokens") / F.lit(1_000_000.0) * F.col("price_in") + F.col(
        "completion_tokens"
    ) / F.lit(1_000_000.0) * F.col("price_out")
    return calls.join(known, "role", "left").withColumn("usd", usd).drop("price_in", "price_out")
