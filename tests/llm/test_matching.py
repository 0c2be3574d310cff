"""Fixity, near-duplicates and nearest neighbours against brute force, with every awkward row."""

import hashlib
import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidary.llm import fixity, graph, hnsw, rabitq, simhash

# --- components ---------------------------------------------------------------------------


def _roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_noise(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(40)] + [(500, 500 + k) for k in range(1, 60)] + [(1000, 1000), (7, None)]
    edges += [tuple(map(int, e)) for e in rng.integers(2000, 2100, (70, 2))]
    real = [(a, b) for a, b in edges if b is not None and a != b]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _roots({x for e in real for x in e}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash ---------------------------------------------------------------------------------


def _slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_masks_cover_the_radius():
    for radius in (1, 2, 3):
        masks = [m % (1 << 64) for m in simhash.covering_masks(radius)]
        rng = np.random.default_rng(radius)
        for _ in range(3000):
            bits = rng.choice(64, radius, replace=False)
            flip = sum(1 << int(b) for b in bits)
            assert any(not m & flip for m in masks)


@pytest.mark.parametrize("text", [None, "", " \t", "one", "one two", "Ein Über-Wort ÄB c d", "a b c " * 40_000, "x" * 100_000 + " y z"])
def test_fingerprints_of_odd_texts(text):
    assert simhash.fingerprint(None if text is None else text.encode()) % (1 << 64) == _slow_print(text)


@pytest.mark.parametrize("limit", [2, 256])
def test_near_duplicates_equal_all_pairs(spark, limit):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 8)]
    prints = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            for _ in range(12):
                prints.add(b ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)))
    prints = sorted(prints)
    edges = [(a, b) for a, b in itertools.combinations(prints, 2) if bin(a ^ b).count("1") <= 3]
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), pair_limit=limit).collect()
    assert all(bin(r["a"] ^ r["b"]).count("1") <= 3 for r in found)
    assert _roots(prints, [(r["a"], r["b"]) for r in found]) == _roots(prints, edges)


def test_groups_and_the_one_that_stays(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [(3, long, "a"), (1, long + " more", "b"), (2, "something else entirely here", None), (2, "something else entirely here", None), (9, None, "x"), (8, "", "x"), (None, "", "q"), (None, "free words of no one", "q")]
    docs = spark.createDataFrame([(i, t, s, "f") for i, t, s in rows], "doc_id long, text string, sig string, fp string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    near = bin(_slow_print(rows[0][1]) ^ _slow_print(rows[1][1])).count("1") <= 3
    assert near
    assert got == sorted([("3", "1"), ("1", "1"), ("2", "2"), ("2", "2"), ("9", "8"), ("8", "8"), ("None", "8"), ("None", "None")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "8", "None"]
    assert simhash.keep_one(docs.limit(0)).count() == simhash.near_duplicates(docs.limit(0)).count() == 0


# --- fixity -------------------------------------------------------------------------------------


def test_audit_descends_to_the_damage_only(spark):
    rows = [(f"f{k % 3}", k * 5000, hashlib.sha256(str(k).encode()).hexdigest()) for k in range(300)]
    hurt = [r if k not in (40, 41, 250) else (r[0], r[1], "0" * 64) for k, r in enumerate(rows) if k != 77] + [("f9", 12, "a")]
    a, b = (spark.createDataFrame(x, "file string, offset long, digest string") for x in (rows, hurt))
    found, counts = fixity.audit(a, b)
    got = {(r["file"], r["offset"], r["kind"]) for r in found.collect()}
    assert got == {(rows[k][0], rows[k][1], "changed") for k in (40, 41, 250)} | {(rows[77][0], rows[77][1], "missing"), ("f9", 12, "extra")}
    assert counts[-1] == 5 and max(counts) <= 5  # no more nodes differ in a level than there are damaged places
    same, counts = fixity.audit(a, a)
    assert same.count() == 0 and set(counts) == {0}
    none = a.limit(0)
    assert fixity.audit(none, none)[0].count() == 0 and fixity.audit(a, none)[0].where("kind = 'missing'").count() == 300


def test_awkward_records_and_pages(spark):
    rows = [("f", 1, None), ("f", 1, "x"), (None, 2, "y"), ("f", None, "z"), ("f", 5, "q")]
    a = spark.createDataFrame(rows, "file string, offset long, digest string")
    assert fixity.leaves(a).count() == 2
    b = spark.createDataFrame([("f", 1, "x"), ("f", 5, "q")], "file string, offset long, digest string")
    assert [(r["offset"], r["kind"]) for r in fixity.audit(a, b)[0].collect()] == [(1, "changed")]
    pages = spark.createDataFrame([(1, "u", "<p>"), (1, "u", "<p>"), (None, None, None), (2, None, "x" * 100_000), (3, "v", "")], "page_id long, url string, html string")
    laid = fixity.laid_out(pages).orderBy("page_id").collect()
    assert len(laid) == 4 and [r["offset"] for r in laid if r["file"] == "pages-0.warc"] == [0, laid[1]["length"], laid[1]["length"] + laid[2]["length"]]
    # of the records only those that the plan damages are found
    lots = {r["page_id"]: (r["page_id"] * 7 + len(r["html"])) % 97 for r in pages.collect() if r["page_id"] is not None}
    assert {r["page_id"] for r in fixity.audit_pages(pages).collect() if r["page_id"]} == {k for k, lot in lots.items() if lot in (5, 11, 17)}
    assert fixity.audit_pages(pages.limit(0)).count() == 0


# --- vectors ------------------------------------------------------------------------------------------


ODD = [(None, [1.0, 0.0], 1), (900, None, 1), (901, [0.0, 0.0], 1), (902, [float("nan"), 1.0], 1), (903, [None, 1.0], 1), (904, [float("inf"), 1.0], 1), (905, [1.0, 0.0], None), (906, [], 1), (907, [1.0, 0.0, 0.0], 1)]
VECTORS = "vec_id long, embedding array<float>, label int, cls string, side string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, k, "c", "s") for i, v, k in rows], VECTORS)


@pytest.mark.parametrize("shard", [90, 16384])
def test_vector_groups_equal_all_pairs(spark, shard):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        centre = rng.standard_normal(8)
        rows += [(k * 5 + j, [float(x) for x in centre + rng.standard_normal(8) * 0.12], k % 2) for j in range(5)]
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, rows[0][1], 1)]
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(_table(spark, rows + ODD), shard=shard).collect()}
    assert len(got) == len(rows) + len(ODD)
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    root = _roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link))])
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[k].sum(), root[i], root[i] == i)
    for i in (901, 902, 903, 904, 905, 900, 906, 907):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert hnsw.near_duplicates(_table(spark, rows).limit(0)).count() == 0


def test_beams_widen_over_a_crowd():
    rng = np.random.default_rng(4)
    crowd = rng.standard_normal(16) + rng.standard_normal((700, 16)) * 0.05
    x = hnsw._unit(np.concatenate([crowd, rng.standard_normal((300, 16))]))
    got = np.unpackbits(hnsw.linked(x, None, 0.93), axis=1)[:, :1000].astype(bool)
    want = (x @ x.T >= 0.93) & ~np.eye(1000, dtype=bool)
    assert not (got & ~want).any() and (got & want).sum() >= 0.99 * want.sum() and (got == got.T).all()


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.standard_normal(24)], 0) for k in range(1500)]
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 0)]
    odd = [(None, [0.5] * 24, 1), (3000, None, 1), (3001, [0.0] * 24, 1), (3002, [float("nan")] * 24, 1), (3003, [1.0, 2.0], 1), (3100, [1.0, 2.5], 1)]
    got = rabitq.search(_table(spark, rows + odd), F.col("vec_id") % 100 == 0, slice_rows=5).toPandas()
    x = np.array([r[1] for r in rows] + [[0.5] * 24], np.float32).astype(float)
    ids = np.array([r[0] for r in rows] + [10**9])
    hits = total = 0
    for q in [i for i in ids if i % 100 == 0 and i < 10**9]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        found = mine["vec_id"].fillna(10**9).astype(int).tolist()
        assert mine["score"].tolist() == [d[np.flatnonzero(ids == i)[0]] for i in found]
        hits += len(set(found) & set(ids[best].tolist()))
        total += 10
    assert hits / total >= 0.95
    short = got[got["query_id"] == 3100]
    assert short["vec_id"].tolist() == [3003] and short["score"].tolist() == [0.5]
    assert rabitq.search(_table(spark, rows).limit(0), F.lit(True)).count() == 0


def test_bounds_hold_for_nearly_all(spark):
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    turn = rabitq.rotation(64)
    o = x / np.linalg.norm(x, axis=1, keepdims=True) @ turn.T
    fit = np.abs(o).sum(axis=1) / 8
    unit = q / np.linalg.norm(q) @ turn.T
    guess = np.sign(o) @ unit / 8 / fit
    off = rabitq.BOUND * np.sqrt(1 / fit**2 - 1) / np.sqrt(63)
    assert (np.abs(guess - o @ unit) <= off).mean() > 0.99


@pytest.mark.parametrize("copies", [4, 30])
def test_a_repeated_query_row_takes_no_ones_place(spark, copies):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((900, 32)).astype(np.float32)
    rows = [(k, [float(v) for v in row], 0) for k, row in enumerate(x)] + [(0, [float(v) for v in x[0]], 0)] * (copies - 1)
    got = rabitq.search(_table(spark, rows).coalesce(1), F.col("vec_id") == 0).orderBy("rank").collect()
    d = np.sqrt(((x[1:].astype(float) - x[0].astype(float)) ** 2).sum(axis=1))
    best = np.argsort(d)[:10]
    assert [r["vec_id"] for r in got] == (best + 1).tolist() and np.allclose([r["score"] for r in got], d[best])


def test_sparse_links_and_islands_are_found():
    rng = np.random.default_rng(13)
    x = rng.standard_normal((3000, 24))
    few = np.concatenate([x, x[:6] + rng.standard_normal((6, 24)) * 0.05])
    tight = [c + rng.standard_normal((70, 24)) * 0.02 for c in rng.standard_normal((12, 24))]
    for rows in (few, np.concatenate([x, *tight])[rng.permutation(3840)]):
        v = hnsw._unit(rows)
        want = (v @ v.T >= 0.93) & ~np.eye(len(v), dtype=bool)
        got = np.unpackbits(hnsw.linked(v, None, 0.93), axis=1)[:, : len(v)].astype(bool)
        assert want.any() and (got == want).all()


@pytest.mark.parametrize("kind", ["sparse", "none", "dense", "two shards"])
def test_links_come_from_the_graph(kind):
    """The graph is asked and passes its audit whether links are many, few or none."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((1500, 24))
    if kind == "sparse":
        x[:40] = x[40:80] + rng.standard_normal((40, 24)) * 0.05
    if kind == "dense":
        x = x[rng.integers(0, 150, 1500)] + rng.standard_normal((1500, 24)) * 0.08
    v = hnsw._unit(x)
    a, b = (v, None) if kind != "two shards" else (v[:700], hnsw._unit(x[600:] + rng.standard_normal((900, 24)) * 0.03))
    report = {}
    got = np.unpackbits(hnsw.linked(a, b, 0.93, report), axis=1)[:, : len(v if b is None else b)].astype(bool)
    want = a @ (a if b is None else b).T >= 0.93
    if b is None:
        np.fill_diagonal(want, False)
    assert not report["exact"] and report["searched"] == len(a) and report["recall"][0] >= 0.9
    assert not (got & ~want).any() and (got & want).sum() >= 0.999 * want.sum() and (kind == "none") == (not want.any())


def test_a_graph_that_finds_nothing_is_not_trusted(monkeypatch):
    lost = lambda self, q, beam: (np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -3, np.float32))
    monkeypatch.setattr(hnsw.Graph, "search", lost)
    rng = np.random.default_rng(14)
    x = rng.standard_normal((900, 24))
    v = hnsw._unit(np.concatenate([x, x[:100] + rng.standard_normal((100, 24)) * 0.05]))
    want = (v @ v.T >= 0.93) & ~np.eye(len(v), dtype=bool)
    report = {}
    got = np.unpackbits(hnsw.linked(v, None, 0.93, report), axis=1)[:, : len(v)].astype(bool)
    assert want.sum() >= 200 and (got == want).all() and report["exact"] and not report["searched"]
