"""Top rows and running sums where one key holds nearly all rows."""

import random

from pyspark.sql import functions as F

from evidary.operators import common, retention, runlog


def _hot(spark, n):
    """Nearly all rows under one key, with ties and nulls in what orders them."""
    value = F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)))
    key = F.when(F.col("id") % 50 == 0, F.concat(F.lit("k"), F.col("id") % 7)).when(F.col("id") == 51, F.lit(None)).otherwise(F.lit("hot"))
    return spark.range(n).select(key.alias("key"), value.cast("double").alias("value"), "id")


def _brute(rows, key, limit, descending):
    """Nulls are least: first where values ascend, last where they descend."""
    mine = [r for r in rows if r["key"] == key]
    low = float("-inf")
    place = lambda v: low if v is None else v
    mine.sort(key=lambda r: (-place(r["value"]) if descending else place(r["value"]), r["id"]))
    return [r["id"] for r in mine[:limit]]


def test_the_last_task_orders_about_twice_the_limit(spark):
    df, limit = _hot(spark, 200_000), 30_000
    rows = df.collect()
    for descending in (True, False):
        order = ["-value" if descending else "value", "id"]
        kept = {r["key"]: r["count"] for r in common.near_top(df, ["key"], order, limit, ["id"]).groupBy("key").count().collect()}
        assert limit <= kept["hot"] <= 2 * limit + common.MOST_SALTS
        got = {}
        for r in common.top_rows(df, ["key"], order, limit, ["id"]).orderBy("rn").select("key", "id").collect():
            got.setdefault(r["key"], []).append(r["id"])
        assert set(got) == {r["key"] for r in rows}
        for key in got:
            assert got[key] == _brute(rows, key, limit, descending)


def test_small_limits_take_one_cut(spark):
    df = _hot(spark, 5000)
    rows = df.collect()
    got = {}
    for r in common.top_rows(df, ["key"], ["-value", "id"], 3, ["id"]).orderBy("rn").collect():
        got.setdefault(r["key"], []).append(r["id"])
    assert all(got[k] == _brute(rows, k, 3, True) for k in got) and common.top_rows(df.limit(0), ["key"], ["id"], 3, ["id"]).count() == 0


def test_running_sums_of_a_hot_key_and_of_all_rows(spark):
    df = _hot(spark, 20_000)
    rows = sorted(df.collect(), key=lambda r: r["id"])
    held, total, want = {}, 0, {}
    for r in rows:
        held[r["key"]] = held.get(r["key"], 0) + (r["value"] or 0)
        total += r["value"] or 0
        want[r["id"]] = (held[r["key"]], total)
    by_key = {r["id"]: r["s"] for r in common.running_sums(df, ["id"], {"s": F.col("value")}, ["key"]).collect()}
    overall = {r["id"]: (r["s"], r["n"]) for r in common.running_sums(df, ["id"], {"s": "value", "n": F.lit(1)}).collect()}
    assert all(abs(by_key[k] - want[k][0]) < 1e-6 and abs(overall[k][0] - want[k][1]) < 1e-6 and overall[k][1] == k + 1 for k in want)
    assert common.running_sums(df.limit(0), ["id"], {"s": "value"}).count() == 0


def test_ids_of_any_shape_share_no_bucket(spark):
    """Runs whose ids open with no date, and calls of one hour, are summed up like others."""
    rng = random.Random(2)
    runs = [(f"{rng.choice('abcxyz')}-{k:05d}", rng.randint(1, 100), True, rng.random() < 0.8) for k in range(3000)]
    got = {r["run_id"]: r["reason"] for r in retention.runs_to_drop(spark.createDataFrame(runs, "run_id string, bytes long, finished boolean, output_exists boolean"), 2000, 50_000).collect()}
    held, want = 0, {}
    for place, (run, size, _, there) in enumerate(sorted(runs, reverse=True)):
        held += size
        if place >= 2000:
            want[run] = "count"
        elif held > 50_000 and place:
            want[run] = "size"
        elif not there:
            want[run] = "orphan"
    assert got == want
    calls = spark.createDataFrame([("r", f"c{k:04d}", 1, 2, None if k % 3 else 0.5) for k in range(500)], "run_id string, call_id string, prompt_tokens long, completion_tokens long, usd double").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    last = runlog.call_totals(calls).where("call_id = 'c0499'").first()
    assert (last["total_prompt_tokens"], last["total_completion_tokens"], last["total_calls"], last["unpriced_calls"], last["total_usd"]) == (500, 1000, 500, 333, 83.5)
