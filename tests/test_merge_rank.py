import random

import pytest
from pyspark.sql import functions as F

from evidary.operators import merge, ranking

SCHEMA = "pmid string, title string, abstract string, journal string, doi string, pmcid string, found_by array<string>, best_rank int, year int, seq long"


def _fold(rows):
    """Sequential fold: the leader takes in each sighting, or is taken in by it."""
    groups, out = {}, []
    for r in rows:
        key = " ".join("".join(c if c.isalnum() else " " for c in r["title"].lower()).split())
        if not key:
            out.append(dict(r))
            continue
        if key not in groups:
            groups[key] = dict(r)
            continue
        lead = groups[key]
        power = lambda x: (len(x["found_by"]), -x["best_rank"], x["pmcid"] is not None)
        first, second = (lead, r) if power(lead) >= power(r) else (r, lead)
        merged = dict(first)
        merged["found_by"] = list(dict.fromkeys([*first["found_by"], *second["found_by"]]))
        merged["best_rank"] = min(first["best_rank"], second["best_rank"])
        for f in ("abstract", "doi", "pmcid", "journal"):
            merged[f] = first[f] or second[f] or first[f]
        groups[key] = merged
    return out + list(groups.values())


@pytest.mark.parametrize("seed", range(4))
def test_title_merge_equals_the_sequential_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        rows.append(
            {
                "pmid": str(i), "title": rng.choice(["A study!", "a  study", "B", "c", "", "D."]), "abstract": "x", "journal": rng.choice(["", "J1", "J2"]),
                "doi": rng.choice([None, f"d{i}"]), "pmcid": rng.choice([None, None, f"P{i}"]), "found_by": rng.sample("abcdefgh", rng.randint(0, 5)),
                "best_rank": rng.randint(0, 6), "year": i, "seq": i,
            }
        )
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    got = {r["pmid"]: r for r in merge.merge_titles(df).collect()}
    want = {r["pmid"]: r for r in _fold(rows)}
    assert got.keys() == want.keys()
    for pmid, w in want.items():
        g = got[pmid]
        assert (g["found_by"], g["best_rank"], g["pmcid"], g["year"]) == (w["found_by"], w["best_rank"], w["pmcid"], w["year"])
        assert (g["doi"], g["journal"]) == (w["doi"], w["journal"] or "")


def _walk(items, limit, lam):
    """Plain diversified order: re-evaluate everything after each pick."""
    def overlap(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    left, picked = dict(items), []
    while left and len(picked) < limit:
        value = {}
        for pmid, (score, tokens) in left.items():
            near = max((overlap(tokens, items[p][1]) for p in picked), default=0.0)
            value[pmid] = (lam * score - (1.0 - lam) * near, score)
        top = max(value.values())
        best = min(p for p in left if value[p] == top)
        picked.append(best)
        del left[best]
    return picked


@pytest.mark.parametrize("seed,batch", [(0, 4096), (1, 7), (2, 3)])
def test_diversified_order_equals_the_plain_walk(spark, seed, batch):
    rng = random.Random(seed)
    groups = {}
    for g in ("x", "y"):
        groups[g] = {
            f"{g}{i:03d}": (rng.choice([0.9, 0.8, 0.75, 0.7, 0.4, 0.1]), frozenset(rng.sample("abcdefghij", rng.randint(0, 4)))) for i in range(60)
        }
    rows = [(p, s, sorted(t), g) for g, items in groups.items() for p, (s, t) in items.items()]
    df = spark.createDataFrame(rows, "pmid string, score double, tokens array<string>, topic string").repartition(6)
    got = ranking.mmr_order(df, 12, 0.7, "topic", batch).orderBy("topic", "pick").collect()
    for g, items in groups.items():
        assert [r["pmid"] for r in got if r["topic"] == g] == _walk(items, 12, 0.7)


def test_lambda_one_is_the_pure_order(spark):
    df = spark.createDataFrame([(str(i), (i * 7 % 10) / 10.0, ["a"]) for i in range(20)], "pmid string, score double, tokens array<string>")
    got = [r["pmid"] for r in ranking.mmr_order(df, 5, 1.0).orderBy("pick").collect()]
    assert got == [r["pmid"] for r in ranking.pure_top(df, 5).collect()]


def test_quota_keeps_thin_topics_and_fills_up(spark):
    rows = [(f"a{i:02d}", 0.9 - i / 100, ["t%d" % i], "a") for i in range(30)] + [("b1", 0.1, ["z"], "b"), ("n1", 0.05, ["q"], "")]
    df = spark.createDataFrame(rows, "pmid string, score double, tokens array<string>, topic string")
    pool = [r["pmid"] for r in ranking.quota_select(df, 10, 0.7).collect()]
    assert len(pool) == 10 and {"b1", "n1"} <= set(pool)


def test_positions_are_a_total_order(spark):
    rows = [(f"{i:03d}", (i % 5) / 5.0) for i in range(200)]
    df = spark.createDataFrame(rows, "pmid string, score double").repartition(7)
    got = {r["pmid"]: r["position"] for r in ranking.with_positions(df).collect()}
    want = {p: i for i, (p, s) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_unknown_metrics_change_no_ordering(spark):
    base = "pmid string, found_by array<string>, best_rank int, year int, abstract string, publication_types array<string>, source_type string, is_research_article boolean, metrics_known boolean, rcr double, citation_count long"
    rows = [(str(i), ["q"] * (i % 3), i, 2000 + i, "x", [], "journal", True, False, None, 0) for i in range(6)]
    df = ranking.score(spark.createDataFrame(rows, base), 2026)
    assert {round(r["components"]["citation"], 9) for r in df.collect()} == {0.075}


def test_affinity_takes_the_first_topic_in_plan_order(spark):
    plan = spark.createDataFrame([(0, "q1", "A"), (1, "q2", "B"), (2, "q3", "A"), (3, "q4", "")], "ord int, term string, topic string")
    df = spark.createDataFrame([("1", ["q2", "q3"]), ("2", ["q2"]), ("3", ["q4"])], "pmid string, found_by array<string>")
    got = {r["pmid"]: r["topic"] for r in ranking.topic_affinity(df, plan).collect()}
    assert got == {"1": "A", "2": "B", "3": ""}
    many = spark.createDataFrame([(i, f"q{i % 900}", f"T{i}") for i in range(1200)], "ord int, term string, topic string")
    got = {r["pmid"]: r["topic"] for r in ranking.topic_affinity(df, many).collect()}
    assert got == {"1": "T2", "2": "T2", "3": "T4"}


def test_failed_availability_keeps_the_paper(spark):
    df = spark.createDataFrame([("1", 0.9, "P1", "x"), ("2", 0.8, "P2", "x"), ("3", 0.7, None, "x"), ("4", 0.6, "P4", "x")], "pmid string, score double, pmcid string, abstract string")
    seen = spark.createDataFrame([("1", False), ("2", None)], "pmid string, available boolean")
    assert [r["pmid"] for r in ranking.apply_basis(df, "full-text", 2, seen).collect()] == ["2"]
    assert ranking.apply_basis(df, "abstract", 2).count() == 4


def test_fallback_counts_only_without_primary(spark):
    papers = spark.createDataFrame([("1",), ("2",)], "pmid string")
    counts = spark.createDataFrame([("1", 5)], "pmid string, cited_by long")
    none = spark.createDataFrame([], "pmid string, citation_count long, relative_citation_ratio double, is_research_article boolean")
    got = {r["pmid"]: (r["metrics_known"], r["citation_count"]) for r in merge.attach_metrics_or_counts(papers, none, counts).collect()}
    assert got == {"1": (True, 5), "2": (False, 0)}
    some = spark.createDataFrame([("2", 9, 1.0, True)], none.schema)
    got = {r["pmid"]: r["citation_count"] for r in merge.attach_metrics_or_counts(papers, some, counts).collect()}
    assert got == {"1": 0, "2": 9}
    assert F is not None
