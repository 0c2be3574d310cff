"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evidary.catalog import QUERIES  # noqa: E402
from evidary.session import local_session  # noqa: E402

HEADLINE = (
    "diversified_pool merged_sightings folded_titles relevance_scores quota_selection placement finding_checks row_strength "
    "mirrored_interactions phrase_clusters predictor_groups outcome_groups selected_sections paper_texts findings_tables "
    "document_rules window_parts running_totals cost_ledger live_meter token_sets sentences_of_documents numbers_in_texts"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "evidary-bench", memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2) if cpus.isdigit() else 16))
    # Code paths and Python workers start outside the timings.
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
