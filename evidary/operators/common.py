"""Top rows per key when one key may hold a large share of all rows, and places in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidary.session import durable

#: Rows that a last window may order without a cut before it; tasks that first cut one key's rows.
WINDOW_ROWS, MOST_SALTS = 1 << 16, 512


def _sorted_by(order: list[str]) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def _not_after(order: list[str], bound: str) -> Column:
    """Whether a row stands at or before the values ``{bound}0``, ``{bound}1``, ... in ``order``, nulls being least."""
    found = F.lit(True)
    for k in reversed(range(len(order))):
        down, name = order[k].startswith("-"), order[k].lstrip("-")
        mine, other = F.col(name), F.col(f"{bound}{k}")
        if down:
            before = (mine > other) | (mine.isNotNull() & other.isNull())
        else:
            before = (mine < other) | (mine.isNull() & other.isNotNull())
        found = F.coalesce(before, F.lit(False)) | (mine.eqNullSafe(other) & found)
    return found


def near_top(df: DataFrame, keys: list[str], order: list[str], limit: int, spread: list[str]) -> DataFrame:
    """Rows of ``df`` that hold the first ``limit`` per key, and no more than about twice as many.

    The rows of a key are cut to ``limit`` within salts of their identity.  Every so-many-th row of each salt then
    makes a summary of the key; the first place in the merged summaries before which ``limit`` rows must lie is the
    key's cut value, and what stands behind it goes.
    """
    salts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_SALTS)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    first = Window.partitionBy(*keys, "_salt").orderBy(*_sorted_by(order))
    cut = salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= limit)
    if limit * salts <= WINDOW_ROWS:
        return cut.drop("_salt", "_rn")
    step = -(-limit // salts)
    merged = Window.partitionBy(*keys).orderBy(*_sorted_by(order))
    seen = F.row_number().over(merged) * step
    values = [F.col(c.lstrip("-")).alias(f"_c{k}") for k, c in enumerate(order)]
    summary = cut.filter(F.col("_rn") % step == 0).withColumn("_seen", seen)
    bound = summary.filter((F.col("_seen") >= limit) & (F.col("_seen") - step < limit)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *values)
    # A copy for each salt, so that the join needs no more of a key in one task than its salts are.
    bound = bound.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_bounded", F.lit(True))
    same = F.col("_salt") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    kept = cut.join(bound, same, "left").filter(F.col("_bounded").isNull() | _not_after(order, "_c"))
    return kept.select(*df.columns)


def top_rows(df: DataFrame, keys: list[str], order: list[str], limit: int, spread: list[str], name: str = "rn") -> DataFrame:
    """The first ``limit`` rows per key in ``order`` (``-`` in front of a column: descending), numbered from 1 in ``name``.

    However many rows a key has, the last task orders about twice ``limit`` of them (or ``WINDOW_ROWS``, for small limits).
    """
    last = Window.partitionBy(*keys).orderBy(*_sorted_by(order))
    return near_top(df, keys, order, limit, spread).withColumn(name, F.row_number().over(last)).filter(F.col(name) <= limit)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with each row's 0-based place in ``order``, without one big window.

    The range-sorted rows are made durable, which freezes their partitions; a row's
    place is that in its partition plus the sizes of the partitions before it.
    """
    frozen = durable(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    placed = frozen.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row per partition; the running sum below is over that short list.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_part", "_place", "_id", "_start")
    )


def running_sums(df: DataFrame, order: list[Column | str], sums: dict[str, Column | str], keys: list[str] | None = None) -> DataFrame:
    """``df`` with running sums in ``order``, each row's own value included, per ``keys`` (none: over all rows).

    A prefix sum by range partitions: the rows are range-sorted by key and order and frozen, each partition
    sums up its own rows, and what the partitions before it hold of the same key is added.  So a key may
    span any number of tasks, and no task orders more than a range partition.  ``sums`` maps new names to values; a null counts as nothing.
    Rows that are equal in ``order`` are taken in any order, so ``order`` should be total.
    """
    keys = keys or []
    weights = {f"_w{k}": F.col(v) if isinstance(v, str) else v for k, v in enumerate(sums.values())}
    lined = durable(df.withColumns(weights).orderBy(*[F.col(k).asc_nulls_first() for k in keys], *order))
    placed = lined.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    runs = durable(placed.groupBy("_part", *keys).agg(*[F.coalesce(F.sum(w), F.lit(0)).alias(f"{w}_all") for w in weights]))
    # One row for each partition and key in it: a key's rows here are at most as many as there are partitions.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"{w}_all").over(before), F.lit(0)).alias(f"{w}_start") for w in weights],
    )
    inside = Window.partitionBy("_part", *keys).orderBy("_id")
    local = placed.withColumns({f"{w}_here": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    same = local["_part"] == starts["_p"]
    for i, k in enumerate(keys):
        same = same & local[k].eqNullSafe(starts[f"_k{i}"])
    named = [(F.col(f"{w}_here") + F.col(f"{w}_start")).alias(name) for w, name in zip(weights, sums)]
    return local.join(starts, same).select(*df.columns, *named)
