"""Run events as a stream: meters, stage status, counters and alerts.

What must outlive a batch lies in Spark's state store: built-in aggregates keep meters, stages and counters, and stateful processors
keep spending per key and stages with a time to live.  Events are summed up per Arrow batch before the shuffle, so one busy run
is a few rows a task and not one task's work.  Results go to tables that rewrite only what a batch touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidary.streaming.running import by_keys

# One wide schema for every kind of event; a kind leaves the fields it lacks null.
EVENT_SCHEMA = (
    "kind string, run_id string, node string, role string, model string, message string, "
    "summary string, prompt_tokens long, completion_tokens long, usd double, seconds double, "
    "current long, total long, fatal boolean, ok boolean, at timestamp"
)


def read_events(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Events as they land in a folder."""
    reader = spark.readStream.format(fmt).schema(EVENT_SCHEMA)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def live_meter(events: DataFrame) -> DataFrame:
    """Running totals per run and role (S2); batch and stream alike."""
    return (
        events.filter(F.col("kind") == "LLMCall")
        .groupBy("run_id", "role")
        .agg(
            F.count("*").alias("calls"),
            F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
            F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"),
            F.sum(F.coalesce("usd", F.lit(0.0))).alias("usd"),
            F.count_if(F.col("usd").isNull()).alias("unpriced_calls"),
        )
    )


def stage_status(events: DataFrame) -> DataFrame:
    """Status, seconds and last progress of every stage of every run (S3); batch and stream alike."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    return (
        events.filter(F.col("kind").isin("NodeStarted", "NodeFinished", "Progress"))
        .groupBy("run_id", "node")
        .agg(
            F.min(F.when(F.col("kind") == "NodeStarted", micros)).alias("_from"),
            F.max(F.when(F.col("kind") == "NodeFinished", micros)).alias("_to"),
            F.max(
                F.when(
                    (F.col("kind") == "Progress") & F.col("current").isNotNull() & F.col("total").isNotNull(),
                    F.struct(micros.alias("m"), "current", "total"),
                )
            ).alias("_progress"),
        )
        .select(
            "run_id",
            "node",
            F.when(F.col("_to").isNotNull(), F.lit("done")).otherwise(F.lit("running")).alias("status"),
            ((F.col("_to") - F.col("_from")) / F.lit(1_000_000.0)).alias("seconds"),
            F.col("_progress.current").alias("current"),
            F.col("_progress.total").alias("total"),
        )
    )


def trouble_counters(events: DataFrame) -> DataFrame:
    """Warnings and errors per run."""
    return events.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "WarningEvent").alias("warnings"),
        F.count_if(F.col("kind") == "ErrorEvent").alias("errors"),
    )


# --- state per key ---------------------------------------------------------------------------

_STAGE = "began long, ended long, moved long, current long, total long"
_STAGE_OUT = "run_id string, node string, status string, seconds double, current long, total long"


def _number(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _stage_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a batch of events says of each stage: first start, last finish, last progress."""
    for events in batches:
        at = events["micros"]
        started, finished = at.where(events["kind"] == "NodeStarted"), at.where(events["kind"] == "NodeFinished")
        moved = events[(events["kind"] == "Progress") & events["current"].notna() & events["total"].notna()]
        last = moved.sort_values(["micros", "current", "total"]).groupby(["run_id", "node"], as_index=False, dropna=False).last()
        ends = events.assign(began=started, ended=finished).groupby(["run_id", "node"], as_index=False, dropna=False)[["began", "ended"]].agg({"began": "min", "ended": "max"})
        both = ends.merge(last[["run_id", "node", "micros", "current", "total"]].rename(columns={"micros": "moved"}), how="left", on=["run_id", "node"])
        yield both[["run_id", "node", "began", "ended", "moved", "current", "total"]].astype({c: "Int64" for c in ("began", "ended", "moved", "current", "total")})


class StageTracker(StatefulProcessor):
    """Keeps when a stage began and ended and its last progress; says its status whenever it hears of it."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stage = handle.getValueState("stage", _STAGE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        began, ended, *progress = self.stage.get() if self.stage.exists() else (None,) * 5
        for marks in rows:
            for mark in marks.itertuples(index=False):
                if (at := _number(mark.began)) is not None:
                    began = at if began is None else min(began, at)
                if (at := _number(mark.ended)) is not None:
                    ended = at if ended is None else max(ended, at)
                found = [_number(mark.moved), _number(mark.current), _number(mark.total)]
                if found[0] is not None and (progress[0] is None or found > progress):
                    progress = found
        self.stage.update((began, ended, *progress))
        seconds = (ended - began) / 1_000_000.0 if ended is not None and began is not None else None
        said = [*key, "running" if ended is None else "done", seconds, progress[1], progress[2]]
        yield pd.DataFrame([said], columns=["run_id", "node", "status", "seconds", "current", "total"]).astype({"seconds": "Float64", "current": "Int64", "total": "Int64"})


def tracked_stages(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of the status of each stage that a batch says something of (S3).

    Without ``ttl_ms`` built-in aggregates keep the stages.  With it a stage that nothing is heard of for so long is forgotten; that
    needs a processor of its own and a stream that runs on, as it never comes to an end.
    """
    if ttl_ms is None:
        return stage_status(events)
    told = events.where(F.col("kind").isin("NodeStarted", "NodeFinished", "Progress"))
    marks = told.select("kind", "run_id", "node", "current", "total", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))
    marks = marks.mapInPandas(_stage_marks, f"run_id string, node string, {_STAGE}")
    return by_keys(marks, "run_id", "node").transformWithStateInPandas(StageTracker(ttl_ms), _STAGE_OUT, "Update", "ProcessingTime")


def _spent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for calls in batches:
        yield calls.fillna({"usd": 0.0}).groupby("run_id", as_index=False, dropna=False)[["usd"]].sum()


class BudgetAlert(StatefulProcessor):
    """Keeps what a run has spent and whether it was named; names it once, when the limit is reached."""

    def __init__(self, limit: float) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "usd double, named boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        usd, named = self.spent.get() if self.spent.exists() else (0.0, False)
        for sums in rows:
            usd += float(sums["usd"].sum())
        reached = usd >= self.limit
        self.spent.update((usd, named or reached))
        if reached and not named:
            message = f"soft budget reached: ${round(usd, 4):,.4f} of ${self.limit:,.2f}"
            yield pd.DataFrame({"run_id": [key[0]], "usd": [round(usd, 4)], "message": [message]})


def budget_alerts(events: DataFrame, limit: float) -> DataFrame:
    """A stream that names each run once, in the batch in which its spending reaches ``limit``."""
    calls = events.where(F.col("kind") == "LLMCall").select("run_id", F.col("usd").cast("double").alias("usd"))
    sums = calls.mapInPandas(_spent, "run_id string, usd double")
    return by_keys(sums, "run_id").transformWithStateInPandas(BudgetAlert(limit), "run_id string, usd double, message string", "Append", "None")
