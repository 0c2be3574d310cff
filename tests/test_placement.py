import random

import pytest

from evidary.operators import placement as P


def _sequential(slugs, kept, rank, reserve, bounds):
    """The bounds applied one paper at a time."""
    key = lambda p: (rank.get(p, 10**6), p)
    taken, lists = {}, {s: [] for s in slugs}
    for s in slugs:
        for p in kept.get(s, []):
            if p not in taken:
                taken[p] = s
                lists[s].append(p)
    for s in slugs:
        lists[s].sort(key=key)
        for p in lists[s][bounds.ceiling :]:
            del taken[p]
        del lists[s][bounds.ceiling :]
    for s in slugs:
        for p in reserve.get(s, []):
            if len(lists[s]) < bounds.floor and p not in taken:
                taken[p] = s
                lists[s].append(p)
    while sum(map(len, lists.values())) > bounds.target:
        wide = [s for s in slugs if len(lists[s]) > bounds.floor]
        if not wide:
            break
        lists[max(wide, key=lambda s: (len(lists[s]), s))].pop()
    return {s: sorted(ps, key=key) for s, ps in lists.items()}


@pytest.mark.parametrize("seed", range(8))
def test_bounds_equal_the_sequential_passes(spark, seed):
    rng = random.Random(seed)
    slugs = [f"t{i}" for i in range(rng.randint(1, 5))]
    rng.shuffle(slugs)
    floor = rng.randint(1, 5)
    bounds = P.Bounds(floor, floor + rng.randint(0, 6), rng.randint(3, 25))
    pmids = [f"{i:02d}" for i in range(60)]
    rank = {p: i for i, p in enumerate(rng.sample(pmids, 55))}
    named = slugs + (["unknown"] if rng.random() < 0.3 else [])
    kept = {s: rng.sample(pmids, rng.randint(0, 20)) for s in named}
    reserve = {s: rng.sample(pmids, rng.randint(0, 12)) for s in slugs}
    if seed % 2:  # every second time one topic per paper, as in a whole run
        pool = [p for p in pmids if all(p not in ps for ps in kept.values())]
        reserve = {s: pool[i :: len(slugs)] for i, s in enumerate(slugs)}
    topics = spark.createDataFrame([(i, s) for i, s in enumerate(slugs)], "ord int, slug string")
    k = spark.createDataFrame([(s, p) for s, ps in kept.items() for p in ps], "topic string, pmid string")
    o = spark.createDataFrame(list(rank.items()), "pmid string, order int")
    q = spark.createDataFrame([(s, p, i) for s, ps in reserve.items() for i, p in enumerate(ps)], "topic string, pmid string, seq int")
    got = {s: [] for s in slugs}
    for r in P.place(k, o, topics, bounds, q).orderBy("topic", "position").collect():
        got[r["topic"]].append(r["pmid"])
    assert got == _sequential(slugs, kept, rank, reserve, bounds)


def test_nearest_topic_ties_go_to_the_earlier(spark):
    topics = spark.createDataFrame(
        [(0, "b", "sleep health", "", []), (1, "a", "sleep habits", "", [])], "ord int, slug string, title string, scope string, seed_terms array<string>"
    )
    df = spark.createDataFrame([("1", ["sleep"]), ("2", ["pain"]), ("3", ["habits", "sleep"])], "pmid string, tokens array<string>")
    assert {r["pmid"]: r["nearest"] for r in P.nearest_topics(df, topics).collect()} == {"1": "b", "3": "a"}


def test_many_topics_lose_no_paper(spark):
    topics = spark.range(201).selectExpr("cast(id as int) as ord", "concat('t', id) as slug", "concat('word', id) as title", "'' as scope", "array('x') as seed_terms")
    kept = spark.range(402).selectExpr("concat('t', id % 201) as topic", "cast(id as string) as pmid")
    order = kept.selectExpr("pmid", "cast(pmid as int) as order")
    assert P.place(kept, order, topics, P.Bounds(1, 5, 1000)).count() == 402
    verdicts = kept.selectExpr("pmid", "'' as topic", "true as include")
    papers = kept.selectExpr("pmid", "'' as topic", "array(concat('word', cast(pmid as int) % 201)) as tokens")
    assigned = P.assign_topics(verdicts, papers, topics)
    assert assigned.where("topic = concat('t', cast(pmid as int) % 201)").count() == 402
    failed = topics.selectExpr("slug as topic")
    none = spark.createDataFrame([], "topic string, pmid string, keep boolean, rationale string")
    assert P.reconcile_decisions(kept, none, failed).where("keep").count() == 402


def test_silence_and_invention(spark):
    offered = spark.createDataFrame([("t", "1"), ("t", "2"), ("u", "3")], "topic string, pmid string")
    said = spark.createDataFrame([("t", "1", True, "good"), ("t", "9", True, "made up")], "topic string, pmid string, keep boolean, rationale string")
    failed = spark.createDataFrame([("u",)], "topic string")
    got = {r["pmid"]: (r["keep"], r["rationale"]) for r in P.reconcile_decisions(offered, said, failed).collect()}
    assert got == {"1": (True, "good"), "2": (False, "the curator did not answer"), "3": (True, "curation unavailable")}


def test_an_empty_topic_is_a_gap(spark):
    topics = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, slug string")
    placed = spark.createDataFrame([("a", "1")], "topic string, pmid string")
    got = {r["topic"]: r["shortfall"] for r in P.gaps(placed, topics, 1).collect()}
    assert got == {"b": 1}


def test_topic_names_are_recovered(spark):
    topics = spark.createDataFrame([(0, "heart-rate"), (1, "sleep")], "ord int, slug string")
    df = spark.createDataFrame([("Heart Rate",), ("pain; SLEEP; heart-rate",), ("pain",)], "n string")
    got = {r["n"]: r["recovered"] for r in P.recover_topics(df, "n", topics).collect()}
    assert got == {"Heart Rate": "heart-rate", "pain; SLEEP; heart-rate": "sleep", "pain": None}


def test_first_claims_of_rows_that_stand_for_several(spark):
    topics = spark.createDataFrame([("b", 0), ("a", 1)], "slug string, ord int")
    rows = [("p", "a", 2), ("p", "b", 3), ("q", "a", 1), ("q", "gone", 5)]
    counted = spark.createDataFrame(rows, "pmid string, topic string, claims long")
    single = spark.createDataFrame([(p, t) for p, t, n in rows for _ in range(n)], "pmid string, topic string")
    want = [("p", "b", 5), ("q", "a", 1)]
    assert sorted(map(tuple, P.first_claim(counted, topics).collect())) == want
    assert sorted(map(tuple, P.first_claim(single, topics).collect())) == want
