import random

import pytest
from pyspark.sql import functions as F

from evidary import fixed
from evidary.operators import interactions as I, recurrence as R, strength, verification as V
from evidary.plans.reconcile import reconcile

FINDING = (
    "pmid string, row int, predictor string, effect double, ci_low double, ci_high double, effect_raw string, effect_measure string, "
    "confidence string, quote string, adjusted boolean"
)
SENTENCE = "In adjusted models the odds ratio was 1.82 (95% CI 1.21-2.74)."
SOURCE = f"## RESULTS\nWe enrolled 1,204 adults. {SENTENCE} Nothing else held.\nTable 4 from 2019 listed 244 and code E11.9."


def _checked(spark, rows, source=SOURCE):
    features = V.source_features(spark.createDataFrame([("p", source)], "pmid string, text string"))
    return V.check_rows(spark.createDataFrame(rows, FINDING), features)


def test_rows_against_their_source(spark):
    rows = [
        ("p", 1, "a", 1.82, 1.21, 2.74, "1.82", "OR", "high", "In adjusted models the", True),
        ("p", 2, "b", 4.44, 3.1, 6.02, "4.44 (95% CI 3.10-6.02)", "OR", "high", "", None),
        ("p", 3, "c", 1.82, 1.05, 2.74, "1.82", "OR", "medium", "In adjusted models", None),
        ("p", 4, "d", 1.82, None, None, "3.91", "OR", "low", "nobody wrote this", None),
        ("q", 5, "e", 1.0, None, None, "1.0", "OR", "high", "", None),
    ]
    kept = {r["row"]: r for r in V.strip_unsupported(_checked(spark, rows)).collect()}
    assert kept[1]["quote"] == SENTENCE and kept[1]["effect"] == 1.82 and kept[1]["confidence"] == "high"
    assert kept[2]["effect"] is None and kept[2]["confidence"] == "medium" and kept[2]["claimed"].startswith("4.44")
    assert kept[3]["effect"] == 1.82 and kept[3]["ci_low"] is None and kept[3]["confidence"] == "low"
    assert kept[4]["effect"] is None and kept[4]["quote"] == "" and kept[4]["quote_missing"]
    assert kept[5]["effect"] is None  # no source supports nothing


def test_expanding_twice_changes_nothing(spark):
    rows = [("p", 1, "a", 1.82, None, None, "", "", "high", "in adjusted models", None)]
    once = _checked(spark, rows).select([c.split()[0] for c in FINDING.split(", ")])
    twice = V.check_rows(once, V.source_features(spark.createDataFrame([("p", SOURCE)], "pmid string, text string")))
    assert once.first()["quote"] == twice.first()["quote"] == SENTENCE


def test_a_table_is_windowed_from_its_locator(spark):
    table = " ".join(f"cell{i}" for i in range(300))
    rows = [("p", 1, "a", None, None, None, "", "", "high", "cell150 cell151", None)]
    words = _checked(spark, rows, table).first()["quote"].split()
    assert len(words) == fixed.MAX_LOCATED_QUOTE_WORDS and words[0] == "cell150"


def test_codes_match_on_word_boundaries(spark):
    features = V.source_features(spark.createDataFrame([("p", "ICD E11·9 and 1250.")], "pmid string, text string"))
    codes = spark.createDataFrame([("p", 1, "x", "icd", "250"), ("p", 2, "x", "icd", "E11.9")], "pmid string, seq int, concept string, system string, code string")
    assert {r["seq"]: r["code_missing"] for r in V.check_codes(codes, features).collect()} == {1: True, 2: False}


def test_strength_of_a_row_follows_its_study(spark):
    papers = spark.createDataFrame(
        [("p", "randomized_trial", 50000, ["age"], "full_text"), ("u", "unclear", None, [], "abstract")],
        "pmid string, design string, n int, adjusted_for array<string>, basis string",
    )
    rows = spark.createDataFrame(
        [("p", 1, "a", 2.0, 1.5, 2.5, "", "OR", "high", "", True), ("u", 1, "b", None, None, None, "", "", "high", "", None)], FINDING
    )
    graded = strength.score_papers(papers, rows, 500, 50000)
    got = {r["pmid"]: r for r in graded.collect()}
    assert got["p"]["grade"] == "strong" and got["p"]["score"] == 1.0 and got["p"]["unmeasured"] == []
    assert got["u"]["unmeasured"] == ["design", "size", "adjustment"]
    scored = {r["pmid"]: r for r in strength.score_rows(rows, graded).collect()}
    assert scored["u"]["row_unmeasured"] == ["precision", "adjusted"]
    assert scored["p"]["row_score"] > scored["u"]["row_score"]


INTER = "pmid string, row int, seq int, feature string, kind string, measure string, value double, measure_raw string, mirrored boolean"


def test_mirrors(spark):
    rows = spark.createDataFrame([("p", 1, "Sleep"), ("p", 2, "Pain"), ("p", 3, "sleep "), ("p", 4, "Age")], "pmid string, row int, predictor string")
    links = spark.createDataFrame(
        [
            ("p", 1, 1, "pain", "modifies", "r", 0.5, "r=.5", False),
            ("p", 2, 1, "AGE", "confounds", "", None, "", False),
            ("p", 4, 1, "Pain", "correlated", "", None, "", False),
            ("p", 1, 2, "Sleep", "correlated", "", None, "", False),
            ("p", 3, 1, "elsewhere", "correlated", "", None, "", False),
        ],
        INTER,
    )
    once = I.mirror_interactions(rows, links)
    new = [(r["row"], r["feature"], r["kind"], r["seq"]) for r in once.collect() if r["mirrored"]]
    assert new == [(2, "Sleep", "modified_by", 2)]
    again = I.mirror_interactions(rows, once)
    assert again.count() == once.count()


def _phrase_walk(counts):
    """Clusters by walking them one at a time."""
    refused = set(fixed.POLARITY_WORDS + fixed.INTERVENTION_WORDS)
    keys = {}
    for form, n in counts.items():
        keys.setdefault(frozenset(form.split()), []).append((form, n))
    order = sorted(keys.items(), key=lambda kv: (-sum(n for _, n in kv[1]), min((-n, len(f), f) for f, n in kv[1])[2]))
    accepted = []
    for key, forms in order:
        for host in accepted:
            small, large = sorted((host[0], key), key=len)
            extra = large - small
            if small < large and len(extra) == 1 and not extra & refused and all(len(w) > 2 for w in extra):
                host[1].extend(forms)
                break
        else:
            accepted.append((key, list(forms)))
    return {frozenset(f for f, _ in forms): min((-n, len(f), f) for f, n in forms)[2] for _, forms in accepted}


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    words = "sleep pain chronic weekly heavy duration maternal index treatment".split()
    counts = {}
    for _ in range(40):
        form = " ".join(sorted(rng.sample(words, rng.randint(1, 4)), key=lambda w: rng.random()))
        counts[form] = counts.get(form, 0) + rng.randint(1, 5)
    rows, i = [], 0
    for form, n in counts.items():
        for _ in range(n):
            rows.append((form, i))
            i += 1
    df = spark.createDataFrame(rows, "phrase string, ord long").repartition(5)
    got = {}
    for r in R.cluster_phrases(df, "phrase", "ord").collect():
        got.setdefault(r["label"], set()).add(r["form"])
    assert {frozenset(v): k for k, v in got.items()} == _phrase_walk(counts)


def test_what_merges_and_what_does_not(spark):
    phrases = ["Sleep restriction", "Chronic sleep restriction (CSR)", "short sleep", "long sleep", "Alcohol", "Heavy alcohol", "Pain", "Pain treatment",
               "Sleep duration", "SD of sleep duration", "Smoking", "Smoking cessation", "Comorbidity index score (≥1)", "Comorbidity index score ≥8"]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(phrases)], "phrase string, ord long")
    label = {r["form"]: r["label"] for r in R.cluster_phrases(df, "phrase", "ord").collect()}
    assert label["Sleep restriction"] == label["Chronic sleep restriction (CSR)"] == "Sleep restriction"
    assert label["Comorbidity index score (≥1)"] == label["Comorbidity index score ≥8"] == "Comorbidity index score"
    for a, b in (("short sleep", "long sleep"), ("Alcohol", "Heavy alcohol"), ("Pain", "Pain treatment"), ("Sleep duration", "SD of sleep duration"), ("Smoking", "Smoking cessation")):
        assert label[a] != label[b]


def test_groups_need_two_papers_and_show_disagreement(spark):
    rows = [("1", "a", 1, "Sleep loss", "Pain", "increases", 0), ("2", "b", 1, "sleep loss", "pain", "decreases", 1), ("2", "b", 2, "Age", "", "none", 2)]
    sites = spark.createDataFrame(rows, "pmid string, domain string, row int, predictor string, outcome string, direction string, ord long")
    named, clusters = R.label_sites(sites)
    groups = R.predictor_groups(named, clusters)
    [g] = groups.collect()
    assert (g["papers"], g["rows"], g["topics"]) == (2, 2, ["a", "b"])
    outcomes, _ = R.outcome_groups(named, groups)
    [o] = outcomes.collect()
    assert o["contested"] and o["papers"] == 2
    t = R.index_totals(named, groups).first()
    assert (t["groups"], t["once"], t["rows"], t["papers"]) == (1, 1, 3, 2)


def test_the_whole_reconcile_plan(spark):
    rows = spark.createDataFrame(
        [("p", 1, "a", 1.82, 1.21, 2.74, "1.82", "OR", "high", "In adjusted models", True), ("p", 2, "b", 9.9, None, None, "9.9", "OR", "high", "", None)], FINDING
    )
    papers = spark.createDataFrame([("p", "case_control", 1204, [], "abstract")], "pmid string, design string, n int, adjusted_for array<string>, basis string")
    nulls = spark.createDataFrame([("p", 1, "x", "We enrolled 1,204")], "pmid string, seq int, predictor string, quote string")
    codes = spark.createDataFrame([("p", 1, "x", "icd", "Z99.9")], "pmid string, seq int, concept string, system string, code string")
    links = spark.createDataFrame([("p", 1, 1, "b", "correlated", "r", 0.62, "r = 0.62", False)], INTER)
    sources = spark.createDataFrame([("p", SOURCE)], "pmid string, text string")
    done = reconcile(papers, sources, rows, nulls, codes, links, (500, 5000))
    s = done.summary.first()
    assert (s["rows"], s["effects_dropped"], s["quotes_dropped"], s["codes_dropped"], s["interactions_dropped"], s["sample_sizes_dropped"]) == (2, 1, 0, 1, 1, 0)
    assert {r["kind"] for r in done.notes.collect()} == {"effect", "interaction", "code"}
    assert done.interactions.filter("mirrored").count() == 1 and done.codes.count() == 0
    assert done.nulls.first()["quote"] == "We enrolled 1,204 adults."
    assert F is not None


def test_texts_are_brought_into_their_form_once_each(spark, monkeypatch):
    """However many rows hold a text, and however it is spaced, its form is counted and labelled as before."""
    seen = []
    keep = R.inline
    monkeypatch.setattr(R, "inline", lambda c: seen.append(str(c)) or keep(c))
    rows = [(str(k), ("old age", " old  age", "ages of old")[k % 3], ("x", None, " ")[k % 3], k, "t", "increases") for k in range(30)]
    sites = spark.createDataFrame(rows, "pmid string, predictor string, outcome string, ord int, domain string, direction string")
    named, clusters = R.label_sites(sites)
    got = {r["form"]: r["n"] for r in clusters.collect()}
    assert got == {"old age": 20, "ages of old": 10} and named.count() == 30
    assert seen and all("_text" in c for c in seen)
    _, labelled = R.outcome_groups(named, R.predictor_groups(named, clusters))
    assert sorted(r["outcome_label"] for r in labelled.collect()) == [""] * 20 + ["x"] * 10


def test_a_text_is_folded_once_and_signs_are_met_first(spark):
    """the folded text comes from its folded sentences; what stands before a sign is only looked at where a sign is."""
    from evidary.functions.numbers import NUMBER
    from evidary.functions.text import fold

    text = "A “Risk” of 3−4 rose. By -2.5 (CI -1 to 1,200)!\r\n\r\nfig. 3 \x85 İSTANBUL.) ﬁn"
    made = V.source_features(spark.createDataFrame([("p", text), ("q", "")], "pmid string, text string"))
    features = {r.pmid: r for r in made.collect()}
    whole = spark.createDataFrame([(text,)], "text string").select(fold("text")).first()[0]
    assert features["p"].src_folded == whole and features["q"].src_folded == ""
    assert [float(v) for v in features["p"].src_values] == [3, 4, -2.5, -1, 1200]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2  # a branch for ASCII, one for the rest
    assert NUMBER.startswith("(?:[-−–]")
