"""Streams over several batches and restarts, and the tables they end in."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from evidary.operators.merge import merge_rounds
from evidary.streaming import events as E, rounds, running
from evidary.streaming.running import BatchLog, KeyedTable, run_to_end


def _land(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def _call(run, usd, at="2024-01-01T00:00:00Z"):
    return {"kind": "LLMCall", "run_id": run, "role": "fast", "prompt_tokens": 10, "completion_tokens": 1, "usd": usd, "at": at}


def _stage(kind, run, node, at, current=None, total=None):
    return {"kind": kind, "run_id": run, "node": node, "current": current, "total": total, "at": f"2024-01-01T00:00:{at:02d}Z"}


def test_meter_and_alert_over_three_batches_and_restarts(spark, tmp_path):
    """Each batch is a query of its own, so what is known comes from the checkpoint."""
    land = tmp_path / "in"
    land.mkdir()
    alerts = BatchLog(spark, str(tmp_path / "alerts"))
    meter = KeyedTable(spark, str(tmp_path / "meter"), ["run_id", "role"])
    batches = [[_call("r", 6.0), _call("s", None)], [_call("r", 5.0), _call(None, 50.0)], [_call("r", 5.0), _call("s", 1.0)] + [_call("s", 0.0)] * 50]
    for k, rows in enumerate(batches):
        _land(land, f"{k}.json", rows)
        run_to_end(E.budget_alerts(E.read_events(spark, str(land)), 10.0), alerts.append, str(tmp_path / "c1"), "append")
        run_to_end(E.live_meter(E.read_events(spark, str(land))), meter.upsert, str(tmp_path / "c2"))
    got = {r["run_id"]: (r["calls"], r["usd"], r["unpriced_calls"]) for r in meter.read().collect()}
    assert got == {"r": (3, 16.0, 0), "s": (52, 1.0, 1), None: (1, 50.0, 0)}
    fired = sorted((str(r["run_id"]), r["usd"], r["message"]) for r in alerts.read().collect())
    assert fired == [("None", 50.0, "soft budget reached: $50.0000 of $10.00"), ("r", 11.0, "soft budget reached: $11.0000 of $10.00")]


def test_stages_over_batches_equal_all_events_at_once(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    table = KeyedTable(spark, str(tmp_path / "t"), ["run_id", "node"])
    batches = [
        [_stage("NodeStarted", "r", "rank", 1), _stage("Progress", "r", "rank", 2, 1, 4), _stage("NodeStarted", "q", "rank", 1)],
        [_stage("Progress", "r", "rank", 4, 3, 4), _stage("Progress", "r", "rank", 3, 2, 4), _stage("NodeFinished", "q", "rank", 9), _stage("Progress", "r", "rank", 5)],
        [_stage("NodeFinished", "r", "rank", 6), _stage("NodeStarted", "r", "screen", 7), _stage("WarningEvent", "r", "rank", 8), _stage("NodeFinished", "z", "late", 8)],
    ]
    for k, rows in enumerate(batches):
        _land(land, f"{k}.json", rows)
        run_to_end(E.tracked_stages(E.read_events(spark, str(land))), table.upsert, str(tmp_path / "c"))
    whole = E.stage_status(spark.read.schema(E.EVENT_SCHEMA).json(str(land)))
    got, want = ({tuple(r) for r in df.select("run_id", "node", "status", "seconds", "current", "total").collect()} for df in (table.read(), whole))
    assert got == want and ("r", "rank", "done", 5.0, 3, 4) in got and ("z", "late", "done", None, None, None) in got


def test_stages_with_a_time_to_live_in_a_stream_that_runs_on(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    _land(land, "a.json", [_stage("NodeStarted", "r", "rank", 1)])
    said = []
    provider = spark.conf.get(running._PROVIDER)
    spark.conf.set(running._PROVIDER, running._ROCKS)
    stream = E.tracked_stages(E.read_events(spark, str(land)), ttl_ms=3_600_000)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: said.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    spark.conf.set(running._PROVIDER, provider)
    until = time.time() + 60
    while not said and time.time() < until and query.isActive:
        time.sleep(0.5)
    query.stop()
    assert [r["status"] for r in said] == ["running"]


# --- tables ---------------------------------------------------------------------------------------


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_a_batch_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=8)
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    table.upsert(rows, 0)
    before = _files(tmp_path / "data")
    one = spark.createDataFrame([(7, 1)], "k long, v int")
    bucket = one.select(F.pmod(F.xxhash64("k"), F.lit(8))).first()[0]
    table.upsert(one, 1)
    after = _files(tmp_path / "data")
    same = {f for f in before if f"bucket={bucket}/" not in f}
    assert same and all(after.get(f) == before[f] for f in same)
    assert {r["k"]: r["v"] for r in table.read().collect()} == {k: int(k == 7) for k in range(200)}


def test_a_repeated_batch_changes_nothing_wherever_it_failed(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], buckets=4)
    first, second = ([(k, f"{w}{k}") for k in range(n)] for w, n in (("a", 30), ("b", 10)))
    schema = "k long, v string"
    table.upsert(spark.createDataFrame(first, schema), 0)
    table.upsert(spark.createDataFrame(second, schema), 1)
    want = {**dict(first), **dict(second)}
    read = lambda: {r["k"]: r["v"] for r in table.read().collect()}
    assert read() == want
    # put in place only in part: one partition is lost, the batch comes again
    lost = next(p for p in sorted((tmp_path / "data").iterdir()) if p.name.startswith("bucket="))
    for f in lost.iterdir():
        f.unlink()
    table.upsert(spark.createDataFrame(second, schema), 1)
    assert read() == want
    table.upsert(spark.createDataFrame([], schema), 2)
    assert read() == want


# --- rounds ---------------------------------------------------------------------------------------

_SEEN = "pmid string, title string, abstract string, pmcid string, found_by array<string>, best_rank int, year int, seq long"


def test_rounds_in_the_state_store_equal_merged_rounds(spark, tmp_path):
    rng = random.Random(4)

    def sighting(k, seq):
        some = lambda *xs: rng.choice(xs)
        return (str(k), some("", f"t{seq}"), some(None, "", f"a{seq}"), some(None, f"P{seq}"), rng.sample(["q1", "q2", "q3", "q4"], rng.randint(0, 3)), rng.randint(0, 50), some(None, 2000 + seq), seq)

    kept = KeyedTable(spark, str(tmp_path / "t"), ["pmid"])
    merged = None
    for k in range(3):
        rows = [sighting(p, 100 * k + p) for p in range(20) if rng.random() < 0.7]
        batch = spark.createDataFrame(rows, _SEEN)
        batch.write.mode("append").parquet(str(tmp_path / "in"))
        run_to_end(rounds.merged_candidates(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))), kept.upsert, str(tmp_path / "c"))
        fresh = merge_rounds(batch.drop("seq").limit(0), batch.drop("seq"))
        merged = fresh if merged is None else merge_rounds(merged, fresh)
    columns = ["pmid", "title", "abstract", "pmcid", "found_by", "best_rank", "year"]
    got, want = (sorted(map(str, df.select(columns).collect())) for df in (kept.read(), merged))
    assert got == want


def test_repeated_sightings_of_a_batch_count_in_order(spark, tmp_path):
    rows = [("1", "", "late", None, ["q2", "q1"], 3, None, 9), ("1", "early", "", None, ["q3"], 8, 1999, 2), ("1", "t", "early", "P", ["q1"], 5, 2005, 5)]
    spark.createDataFrame(rows, _SEEN).write.parquet(str(tmp_path / "in"))
    kept = KeyedTable(spark, str(tmp_path / "t"), ["pmid"])
    run_to_end(rounds.merged_candidates(spark.readStream.schema(_SEEN).parquet(str(tmp_path / "in"))), kept.upsert, str(tmp_path / "c"))
    row = kept.read().first()
    assert (row["title"], row["abstract"], row["pmcid"], row["found_by"], row["best_rank"], row["year"]) == ("early", "early", "P", ["q3", "q1", "q2"], 3, 1999)


def test_rounds_merged_into_a_table_equal_those_in_the_state_store(spark, tmp_path):
    """Repeated sightings of a paper within a batch, orders that start again with each batch, empty and null fields, papers without terms."""
    rng = random.Random(9)
    some = lambda *xs: rng.choice(xs)
    stored, joined = (KeyedTable(spark, str(tmp_path / name), ["pmid"]) for name in ("a", "b"))
    for k in range(3):
        rows = [
            (str(rng.randint(0, 12)), some("", f"t{k}-{i}", None), some(None, "", f"a{k}-{i}"), some(None, f"P{k}-{i}"), rng.sample(["q1", "q2", "q3", "q4"], rng.randint(0, 3)), rng.randint(0, 50), some(None, 2000 + i), i)
            for i in range(25)
        ]
        spark.createDataFrame(rows, _SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        landed = spark.readStream.schema(_SEEN).parquet(str(tmp_path / "in"))
        run_to_end(rounds.merged_candidates(landed), stored.upsert, str(tmp_path / "c1"))
        run_to_end(landed, rounds.merging(joined), str(tmp_path / "c2"))
        columns = ["pmid", "title", "abstract", "pmcid", "found_by", "best_rank", "year"]
        got, want = (sorted(map(str, t.read().select(columns).collect())) for t in (joined, stored))
        assert got == want and len(got) > 5
    before = sorted(map(str, joined.read().collect()))
    rounds.merging(joined)(spark.createDataFrame(rows, _SEEN), 2)
    assert sorted(map(str, joined.read().collect())) == before


def test_stages_without_a_time_to_live_need_no_python(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = E.tracked_stages(E.read_events(spark, str(tmp_path / "in")))
    assert "Pandas" not in stream._jdf.queryExecution().logical().toString()


def test_a_screened_paper_is_never_screened_again(spark):
    candidates = spark.createDataFrame([("1", 3), ("2", 1), ("3", 0)], "pmid string, best_rank int")
    verdicts = spark.createDataFrame([("2", True), ("9", False)], "pmid string, include boolean")
    assert sorted(r["pmid"] for r in rounds.to_screen(candidates, verdicts).collect()) == ["1", "3"]
