import json
import os
import random

import pytest
from pyspark.sql import functions as F

from evidary.operators import budgets, chunks as K, fulltext, quality as Q, retention
from evidary.sinks import bundle
from evidary.sources import bibxml as X, documents as D, landed_json as J, replies as R

DOC = """---
type: "Literature Evidence"
title: "A \\"b\\" | c"
domain: "t"
tags: ["x", "y"]
---

# Bottom line

Sum it.

- **Design** — cohort
- **N** — 1,200

# Predictors reported

| # | Predictor | Effect | Timing |
|---|---|---|---|
| 1 | a \\| b | — | early |
| 2 | c | 1.2 | — |

Quoted from the paper, by row:

1. q one

# Null or non-significant findings

None.

# Vocabulary hints

None.

# Caveats

None stated.
"""


def _docs(spark, *texts):
    rows = [(f"t/{i}.md", "t", f"{i}.md", t) for i, t in enumerate(texts)]
    return D.parse_documents(spark.createDataFrame(rows, "path string, topic string, filename string, text string"))


def test_bundle_round_trip_over_files(spark, tmp_path):
    root = str(tmp_path / "b")
    bundle.write_documents(spark.createDataFrame([("t", "1_A.md", DOC), ("t", "2_B.md", "no fence")], "domain string, filename string, text string"), root)
    os.makedirs(os.path.join(root, "old"))
    good, bad = D.parse_documents(D.read_documents(spark, root))
    [doc] = good.collect()
    assert doc["fields"]["title"] == 'A "b" | c' and doc["topic"] == "t" and [s["heading"] for s in doc["sections"]][0] == "Bottom line"
    assert [r["problem"] for r in bad.collect()] == ["document does not open with a frontmatter fence"]
    topics = spark.createDataFrame([("t",)], "slug string")
    assert [r["slug"] for r in bundle.stale_topics(spark, root, topics).collect()] == ["old"]


def test_frontmatter_rules(spark):
    _, bad = _docs(spark, "---\n a: 1\n---\n", "---\na 1\n---\n", "---\na: 1\na: 2\n---\n", "---\na: 1\n", "---\n9x: 1\n---\n")
    assert sorted(r["problem"] for r in bad.collect()) == [
        "frontmatter block is never closed", "line 1 has an unusable key", "line 1 has no key", "line 1 is indented", "line 2 repeats the key a",
    ]


def test_tables_facts_and_quotes(spark):
    good, _ = _docs(spark, DOC)
    part = lambda h: D.section_text("sections", h)
    r = good.select(
        D.markdown_table(part("Predictors reported")).alias("t"), D.fact_list(part("Bottom line")).alias("f"),
        D.numbered_quotes(part("Predictors reported")).alias("q"), D.first_paragraph(part("Bottom line")).alias("p"),
    ).first()
    assert r["t"] == [{"#": "1", "Predictor": "a | b", "Effect": "", "Timing": "early"}, {"#": "2", "Predictor": "c", "Effect": "1.2", "Timing": ""}]
    assert (r["f"], r["q"], r["p"]) == ({"Design": "cohort", "N": "1,200"}, {1: "q one"}, "Sum it.")


def test_validator_on_a_clean_and_a_broken_document(spark):
    broken = DOC.replace('domain: "t"', 'domain: "elsewhere"\nn: 12').replace("# Caveats", "# Surprise").replace("q one", "q \\u2265")
    good, _ = _docs(spark, DOC, broken)
    rules = [(r["path"], r["rule"]) for r in Q.check_fields(good).unionByName(Q.check_bare_scalars(good)).unionByName(Q.check_sections(good)).unionByName(Q.check_escapes(good)).collect()]
    assert all(p == "t/1.md" for p, _ in rules)
    assert {r for _, r in rules} == {"domain", "bare scalar", "unknown section", "missing section", "escape"}


def test_links_resolve_from_their_folder(spark):
    good, _ = _docs(spark, DOC.replace("Sum it.", "[a](./0.md) [b](../index.md#x) [c](/t/0.md) [d](../../no.md) [e](https://x.y/z)"))
    files = spark.createDataFrame([("t/0.md",), ("index.md",)], "path string")
    assert [r["message"] for r in Q.check_links(good, files).collect()] == ["link to ../../no.md does not resolve"]


def test_chunks_have_both_levels_and_no_null(spark):
    good, _ = _docs(spark, DOC)
    made = K.chunk_documents(good)
    rows = {r["chunk_id"]: r for r in made.collect()}
    assert set(rows) == {"0#0", "0#1", "0#2"}
    assert "Predictors reported" not in rows["0#0"]["text"] and rows["0#0"]["timing"] == ""
    assert "Predictor: a | b" in rows["0#1"]["text"] and "Quoted from the paper: q one" in rows["0#1"]["text"] and rows["0#1"]["timing"] == "early"
    q = Q.null_metadata(made).first()
    assert (q["chunks"], q["with_null"], q["concept_with_row_level"]) == (3, 0, 0)


@pytest.mark.parametrize("seed", range(20))
def test_packing_loses_no_word_and_fits(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join("w%d" % rng.randint(0, 999) for _ in range(n))
    blocks = ["\n".join(words(rng.randint(1, 60)) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 6))]
    count = lambda t: len(t.split())
    parts = K.pack(blocks, "the lead", 40, count)
    assert all(p.startswith("the lead") for p in parts)
    assert [w for p in parts for w in p.split()[2:]] == [w for b in blocks for w in b.split()]
    assert all(count(p) <= 40 for p in parts)


def test_an_encoder_must_answer_for_every_text(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "text string")
    assert {tuple(r["embedding"]) for r in K.embed(rows, lambda: lambda ts: [[1.0, float(len(t))] for t in ts]).collect()} == {(1.0, 1.0)}
    with pytest.raises(Exception, match="vectors for"):
        K.embed(rows, lambda: lambda ts: []).collect()


@pytest.mark.parametrize("seed", range(3))
def test_section_budget_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    kinds = ["RESULTS", "INTRO", "TABLE", "OTHER", "ABSTRACT"]
    rows = [(f"P{i % 3}", i, rng.choice(kinds), rng.choice(["paragraph", "fig_caption"]), "x" * rng.randint(0, 60)) for i in range(90)]
    df = spark.createDataFrame(rows, "pmcid string, seq int, section_type string, passage_type string, text string").repartition(4)
    got = {(r["pmcid"], r["seq"]) for r in fulltext.select_sections(df, 300).collect()}
    order = ["TITLE", "ABSTRACT", "RESULTS", "TABLE", "FIG", "CONCL", "METHODS", "DISCUSS", "INTRO"]
    want = set()
    for doc in ("P0", "P1", "P2"):
        spent = 0
        rank = lambda r: order.index(r[2]) if r[2] in order else (4 if "fig" in r[3] else 9)
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: (rank(r), r[1])):
            cost = len(r[4]) + len(r[2]) + 6
            if r[4] and spent + cost <= 300:
                spent += cost
                want.add((doc, r[1]))
    assert got == want


def test_abstract_stands_in_for_missing_full_text(spark):
    papers = spark.createDataFrame([("1", "T", "J", 2020, "abs", "PMC1"), ("2", "", "", None, "", None)], "pmid string, title string, venue string, year int, abstract string, pmcid string")
    raw = spark.createDataFrame([("PMC1", json.dumps([{"documents": [{"infons": {"license": "CC0"}, "passages": [{"infons": {"section_type": "RESULTS"}, "text": "r"}, {"infons": {"section_type": "REF"}, "text": "8.77"}]}]}]))], "pmcid string, raw string")
    got = {r["pmid"]: r for r in fulltext.paper_texts(papers, J.parse_full_text(raw)).collect()}
    assert got["1"]["text"] == "Title: T\nPublished in: J 2020\nRead from: full text (PMC), license CC0\n\n## RESULTS\nr"
    assert got["2"]["text"] == "Title: (untitled)\nRead from: abstract only\n\n## ABSTRACT\n(no abstract available)"


XML = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedBookArticle><BookDocument><PMID>7</PMID><ArticleIdList><ArticleId IdType="bookaccession">N</ArticleId></ArticleIdList><Book><BookTitle>The Book</BookTitle><PubDate><Year>2011</Year></PubDate></Book></BookDocument></PubmedBookArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">8</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1998 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>Role of <i>TP53</i> &lt; x</ArticleTitle></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/a</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="pmc">PMC1</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>
</PubmedArticleSet>"""


def test_books_and_journals_are_siblings(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML, encoding="utf-8")
    rows = {r["pmid"]: r for r in X.parse_articles(X.read_article_sets(spark, str(tmp_path))).collect()}
    assert rows["7"]["title"] == "The Book" and rows["7"]["source_type"] == "book" and rows["7"]["year"] == 2011
    assert rows["8"]["title"] == "Role of TP53 < x" and rows["8"]["year"] == 1998 and rows["8"]["pmcid"] is None and rows["8"]["doi"] == "10.1/a"


def test_replies_are_unwrapped_and_the_bad_kept_apart(spark):
    rows = [("1", '```json\n{"verdict": {"include": true, "reason": "a } b",}}\n```'), ("2", "none"), ("3", 'ok {"queries": "{\\"include\\": false}"} bye'), ("4", '{"include": true, "tags": "[\\"a\\"]"}')]
    good, bad = R.parse_replies(spark.createDataFrame(rows, "pmid string, t string"), "t", "pmid string, include boolean, reason string, tags array<string>", nested=["tags"], known=["pmid"], required=["include"])
    got = {r["pmid"]: (r["include"], r["reason"], r["tags"]) for r in good.collect()}
    assert got == {"1": (True, "a } b", None), "3": (False, None, None), "4": (True, None, ["a"])}
    assert [r["pmid"] for r in bad.collect()] == ["2"]


def test_search_errors_fail_loudly(spark):
    with pytest.raises(Exception, match="rejected"):
        J.parse_search_results(spark.createDataFrame([("x", '{"esearchresult":{"ERROR":"bad"}}')], "term string, raw string")).collect()


def test_null_findings_are_never_absent(spark):
    df = spark.createDataFrame([("1", [])], "pmid string, null_findings array<struct<predictor:string,outcome:string,detail:string,quote:string>>")
    assert budgets.null_findings_or_sentinel(df).first()["null_findings"][0]["predictor"] == "none reported"


def test_files_go_oldest_first_until_it_fits(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 5), ("b", "2024-01-02", 5), ("c", "2024-03-01", 5)], "path string, day string, bytes long").withColumn("mtime", F.to_timestamp("day"))
    names = lambda cap: sorted(r["path"] for r in retention.files_to_trim(df, cap).collect())
    assert (names(0), names(15), names(14), names(9), names(1)) == ([], [], ["a"], ["a", "b"], ["a", "b", "c"])


def test_runs_beyond_count_size_or_output(spark):
    runs = spark.createDataFrame([("20240105-000000-a", 90, False, True), ("20240104-000000-b", 20, True, False), ("20240103-000000-c", 20, True, True), ("20240102-000000-d", 1, True, True)], "run_id string, bytes long, finished boolean, output_exists boolean")
    got = {r["run_id"][-1]: r["reason"] for r in retention.runs_to_drop(runs, 3, 120).collect()}
    assert got == {"b": "orphan", "c": "size", "d": "count"}
    assert retention.runs_to_drop(runs, 0, 0).count() == 1
