"""What old runs and old files could go: plans only, nothing is deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidary.operators.common import running_sums


def bytes_per_run(checkpoints: DataFrame, writes: DataFrame) -> DataFrame:
    """Bytes each run holds in both tables (F20): ``(run_id, bytes)``."""
    return (
        checkpoints.select("run_id", "bytes")
        .unionByName(writes.select("run_id", "bytes"))
        .groupBy("run_id")
        .agg(F.sum("bytes").alias("bytes"))
    )


def runs_to_drop(runs: DataFrame, keep: int, max_bytes: int = 0) -> DataFrame:
    """Runs beyond the newest ``keep``, over the size cap, or orphaned (G10): ``(run_id, reason)``.

    ``runs`` is ``(run_id, bytes, finished, output_exists)``; ids sort by age.  The cap never
    takes the newest run, and once it is passed every older run goes.
    """
    ranked = runs
    counted = None
    if keep > 0:
        ranked = runs.orderBy(F.desc("run_id")).limit(keep)
        counted = runs.join(ranked.select("run_id"), "run_id", "left_anti").select(
            "run_id", F.lit("count").alias("reason")
        )
    ranked = running_sums(ranked, [F.desc("run_id")], {"held": F.col("bytes"), "place": F.lit(1)})
    over = (F.col("held") > max_bytes) & (F.col("place") > 1) if max_bytes > 0 else F.lit(False)
    reason = F.when(over, F.lit("size")).when(F.col("finished") & ~F.col("output_exists"), F.lit("orphan"))
    rest = ranked.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("run_id", "reason")
    return rest if counted is None else counted.unionByName(rest)


def files_to_trim(files: DataFrame, max_bytes: int) -> DataFrame:
    """The oldest files whose going brings the rest under the budget (G11): ``(path, bytes)``.

    ``files`` is ``(path, mtime, bytes)``; a budget of 0 or less means no ceiling.
    """
    if max_bytes <= 0:
        return files.limit(0)
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t")).first()["t"]
    excess = total - max_bytes
    if excess <= 0:
        return files.limit(0)
    summed = running_sums(files, ["mtime", "bytes", "path"], {"gone": F.col("bytes")})
    # A file goes while what went before it does not suffice yet.
    return summed.filter(F.col("gone") - F.col("bytes") < excess).drop("gone")
