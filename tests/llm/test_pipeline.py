"""The pipeline on a small folder, each stage against a plain version of its decision."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from evidary.llm import langid, mixing, simhash, toxicity
from evidary.llm.common import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "row", "sig", "language"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(9)
    words = {"en": "the and of thing stone with house from that".split(), "de": "der und nicht schloss das mit haus von dass".split()}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        text = " ".join(words[lang][k] for k in rng.integers(0, 9, 60))
        rows.append((i, text + (" idiot fool idiot" if i % 5 == 0 else ""), lang))
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 %%", None), (103, rows[3][1], "en"), (103, rows[3][1], "en"), (None, rows[4][1], "de")]
    docs = spark.createDataFrame([(i, t, k, "s", len(t or ""), "r", "g", "l") for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, sig string, language string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def _ids(df):
    return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "packing"]
    assert {f"op{n}_" for n in range(1, 11)} <= {name[: name.index("_") + 1] for name in queries() if name.startswith("op")}
    assert queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in oracle_sql()


def test_every_stage_decides_as_its_operator_says(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, docs, folder)
    assert first.columns == COLUMNS
    learn = F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)
    said = langid.identify(docs, langid.fit(docs, learn), "said", corpus_pipeline.LANGUAGE_MARGIN).collect()
    want = sorted(str(r["doc_id"]) for r in said if r["said"]["lang_pred"] != "und" and not r["said"]["ambiguous"])
    assert _ids(first) == want and not {"100", "101", "102"} & set(want) and len(want) >= 80

    second = stages["toxicity"](spark, first, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id"), 4, 2))
    scored = toxicity.score(first, toxicity.fit(first, labels), "score").collect()
    assert _ids(second) == sorted(str(r["doc_id"]) for r in scored if r["score"] < corpus_pipeline.TOXIC)
    assert second.columns == COLUMNS and not {str(i) for i in range(0, 80, 5)} & set(_ids(second))

    third = stages["near_duplicates"](spark, second, folder)
    rows = second.collect()
    prints = {r["text"]: simhash.fingerprint(r["text"].encode()) % (1 << 64) for r in rows}
    values = sorted(set(prints.values()))
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if bin(a ^ b).count("1") <= 3 and root[b] > root[a]:
                    root[b], changed = root[a], True
    groups = {}
    for r in rows:
        groups.setdefault(root[prints[r["text"]]], []).append((r["doc_id"] is None, r["doc_id"] or 0))
    assert _ids(third) == sorted(str(None if least[0] else least[1]) for least in map(min, groups.values()))

    fourth = stages["mixing"](spark, third, folder)
    plan = mixing.mix(third, spark.read.parquet(f"{folder}/labels.parquet")).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    assert fourth.columns == COLUMNS
    assert Counter(_ids(fourth)) == {str(r["doc_id"]): r["n"] for r in plan if r["n"]}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    copies = Counter((r["doc_id"], r["text"] or "") for r in fourth.collect())
    pieces = Counter()
    for r in stages["packing"](spark, fourth, folder).collect():
        pieces[r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]] += 1
    for (doc, text), n in copies.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        mine = {k: m for k, m in pieces.items() if k[0] == doc and k[1] == len(ids)}
        held = np.zeros(len(ids), int)
        for (_, _, start, length, crc), m in mine.items():
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
            held[start : start + length] += m
        assert (held == n).all()
    assert {k[0] for k in pieces} == {doc for doc, _ in copies}


def test_empty_tables_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name


def test_mixing_stage_meets_the_targets(spark, tmp_path):
    rng = np.random.default_rng(15)
    words = [f"word{chr(97 + k)}" for k in range(26)]
    rows, labels = [], []
    for i in range(1000):
        text = " ".join(words[k] for k in rng.integers(0, 26, 40))
        toxic, low = i < 20, 20 <= i < 220
        rows.append((i, text + " idiot fool" * 3 if toxic else text + " %%% ||| $$$ ###" * 8 if low else text))
        labels.append((i, int(not low), int(toxic)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    model = mixing.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    sums = mixing.posteriors(got, model).agg(*[F.expr(f"sum(tokens * p[{d}])") for d in range(3)]).first()
    shares = np.array(sums) / sum(sums)
    assert np.abs(shares - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 0.015, shares
