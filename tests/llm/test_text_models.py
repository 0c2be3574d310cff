"""Classifiers, the language model and packing on small tables, with every awkward row."""

import math
import pickle
from functools import partial
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evidary.llm import common, ctw, langid, mixing, packing, quality, toxicity

WORDS = {"en": "the and of thing stone with house", "de": "der und nicht schloss über wände das"}
DOCS = "doc_id long, text string, lang string, score string, row string, p string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        words = WORDS[lang].split()
        text = " ".join(words[(i * k + k) % 7] for k in range(1, 40))
        rows.append((i, text + (" idiot you idiot" if i % 4 == 1 else ""), lang))
    rows += [(100, None, None), (101, "", "en"), (102, "123 %%%", "de"), (None, "the and of thing", "en"), (103, "the " * 50_000, "en"), (5, rows[5][1], "en"), (5, rows[5][1], "en")]
    return _docs(spark, rows)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1 if i % 3 else 0, 1 if i % 4 == 1 else 0) for i in range(60)] + [(None, 1, 1), (7, None, None), (999, 1, 0), (5, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return _docs(spark, []).limit(0)


def test_held_out_is_the_stated_remainder(spark, corpus):
    got = corpus.select("doc_id", common.held_out(F.col("doc_id"), 4, 2).alias("out")).collect()
    assert all(r["out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


@pytest.mark.parametrize("overlap", [0, 3])
def test_runs_hold_every_text_once(overlap):
    texts = [b"", None, b"abc" * 5000, b"x", b"y" * 70_000, b"", b"end"]
    back = {}
    for first, rows, pieces in common.segments(texts, overlap, 1 << 14, 3):
        for r, p in pieces:
            whole = back.setdefault(first + r, b"")
            back[first + r] = whole + (p[overlap:] if overlap and whole else p)
    assert [back[k] for k in range(len(texts))] == [t or b"" for t in texts]


def _long_texts():
    rng = np.random.default_rng(12)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 12, 300)]
    long = " ".join(words[k] if rng.random() < 0.9 else "same same" for k in rng.integers(0, 300, 500_000))
    return ["ab ab", None, "é abc " * 9000, "", "zz", long, "x" * 700_000 + " end end", long[:5000], "tail"]


@pytest.mark.parametrize("limit", [1 << 10, 1 << 14, 1 << 20])
def test_counts_do_not_depend_on_where_texts_are_cut(monkeypatch, limit):
    texts = _long_texts()
    cut, whole = (partial(common.segments, limit=n, rows=rows) for n, rows in ((limit, 4), (1 << 30, 256)))
    found = {}
    for name, segments in (("cut", cut), ("whole", whole)):
        monkeypatch.setattr(common, "segments", segments)
        monkeypatch.setattr(quality, "segments", segments)
        grams = [m for _, x in langid._features(texts) for m in x]
        terms = [m for _, x in quality.features(t and t.encode() for t in texts) for m in x]
        found[name] = np.array(grams), np.array(terms)
    for a, b in zip(found["cut"], found["whole"]):
        assert len(a) == len(texts) and np.allclose(a, b, atol=1e-6)


def test_quality_terms_of_long_texts_equal_plain_counts(monkeypatch):
    monkeypatch.setattr(quality, "segments", partial(common.segments, limit=1 << 12))
    long = _long_texts()[5][:300_000]
    [(_, counts)] = list(quality._counts([long.encode() + b"\n"]))
    words = long.split()
    plain = len(words), sum(x == y for x, y in zip(words, words[1:])), len(set(words))
    assert tuple(counts[0, quality.TERMS : quality.TERMS + 3].astype(int)) == plain
    assert counts[0, : quality.TERMS].sum() == len(long)


def test_equally_near_neighbours_are_taken_in_order():
    near = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [1.0, 1.0, 1.0, 1.0, 1.0], [0.1, 0.2, 0.3, 0.4, 0.5]])
    assert quality._nearest(near, 2).tolist() == [[0, 1], [0, 1], [3, 4]]
    assert quality._nearest(near, 5).tolist() == [[0, 1, 2, 3, 4]] * 3


def test_language_decoding_equals_a_plain_version(spark, corpus):
    """The loss-weighted nearest codeword, worked out bit by bit for each text."""
    model = langid.fit(corpus, F.col("lang").isNotNull())
    langs, code, w, right = pickle.loads(model)
    got = langid.identify(corpus, model, "said").select("text", "said.*").collect()
    for r in got:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0, True)
            continue
        plain = r["text"].lower().encode().translate(langid._SPACES)
        counts = np.zeros(langid.DIMS)
        for n in (1, 2, 3):
            for k in range(len(plain) - n + 1):
                gram = int.from_bytes(plain[k : k + n], "big")
                counts[((gram + (n << 24)) * 2654435761 % (1 << 32)) >> 20] += 1
        x = np.sqrt(counts)
        x /= np.linalg.norm(x)
        losses = []
        for k in range(len(langs)):
            losses.append(sum(max(right[b] - 0.5, 0.01) * math.log1p(math.exp(-code[k, b] * (x @ w[:-1, b] + w[-1, b]))) for b in range(code.shape[1])))
        p = np.exp(min(losses) - np.array(losses))
        assert r["lang_pred"] == langs[int(np.argmin(losses))] and r["score"] == pytest.approx(p.max() / p.sum(), abs=1e-4)


def test_hashed_words_are_words():
    data = np.frombuffer(b"  one two\tone\n" + b"q" * 200 + b" two" + b" " + b"q" * 200, np.uint8)
    starts, lengths, keys = common.hashed_words(data)
    words = [data[s : s + n].tobytes() for s, n in zip(starts, lengths)]
    assert words == bytes(data).split()
    assert len(set(zip(words, keys.tolist()))) == len(set(words)) == len(set(keys.tolist()))


def test_places_number_keys():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 70_000, dtype=np.uint64)
    places = common.Places(4)
    for part in np.split(keys, 7):
        places.add(part)
    assert (places.find(keys) == np.arange(70_000)).all() and places.find(np.array([5], np.uint64))[0] == -1


def test_languages(spark, corpus, nothing):
    got = {(r["doc_id"], i): r for i, r in enumerate(langid.predictions(corpus, F.col("lang").isNotNull()).collect())}
    assert len(got) == corpus.count()
    lang = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    for (i, _), r in got.items():
        if i in (100, 101, 102):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] == (lang[i] or "en") and 0 <= r["score"] <= 1
    assert langid.predictions(nothing, F.lit(True)).collect() == []
    alone = langid.predictions(corpus.where("doc_id < 60"), F.col("lang") == "en").select("lang_pred").distinct().collect()
    assert [r[0] for r in alone] == ["en"]
    assert {r[0] for r in langid.predictions(corpus, F.lit(False)).select("lang_pred").distinct().collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 40])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == (n if n > 1 else 1)
    if n in (4, 6):
        assert ((code.shape[1] - code @ code.T) / 2 + 99 * np.eye(n)).min() == 2 ** (n - 2)


def test_toxic_words_are_learned(spark, corpus, labels, nothing, monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(corpus, known).collect()}
    assert len(got) == 65 and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i in range(60) if i % 4 == 1) > max(got[i] for i in range(60) if i % 4 != 1)
    assert got[100] == got[101]
    assert toxicity.scores(nothing, known).collect() == []
    assert {r["score"] for r in toxicity.scores(corpus, known.limit(0)).collect()} == {0.0}


def test_toxic_weights_are_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(0, 5000, 30), [7777] if k % 2 else [])).astype(np.int32), k % 2) for k in range(200)]
    w, _ = toxicity.ftrl(rows)
    assert w.argmax() == 7777 and (w != 0).sum() < 100


def test_skip_grams_reach_over_words():
    a, b = (set(toxicity.feature_ids(t).tolist()) for t in ("you stupid person", "you person"))
    assert len(a) == 6 and len(b) == 3 and len(a & b) == 2
    assert toxicity.feature_ids(None).tolist() == toxicity.feature_ids(" ,.").tolist() == []


def test_quality_votes_are_the_nearest_labels(spark, corpus, labels, nothing):
    known = labels.select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(corpus, known)
    import pickle

    fitted = pickle.loads(model)
    mean, turn, vectors, label, weight = fitted
    rows = corpus.where("doc_id < 60").dropDuplicates(["doc_id"]).collect()
    x = np.concatenate([m for _, m in quality.features([r["text"].encode() for r in rows])])
    got = quality.vote(x, fitted)
    y = (x - mean) @ turn
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for k in range(len(rows)):
        near = y[k] @ vectors.T
        cut = np.sort(near)[-quality.NEIGHBOURS]
        if (near == cut).sum() > 1 or (np.abs(near - cut) < 1e-6).sum() > 1:
            continue  # a tie for the last place
        best = near >= cut
        v = np.maximum(near[best], 1e-6) ** 4 * weight[best]
        assert got[k] == pytest.approx((v * label[best]).sum() / v.sum(), abs=1e-4)
    everything = quality.scores(corpus, known).collect()
    assert len(everything) == corpus.count() and all(0 <= r["score"] <= 1 for r in everything)
    assert quality.scores(nothing, known).collect() == []
    assert {r["score"] for r in quality.scores(corpus, known.limit(0)).collect()} == {0.5}


def _slow_tree(texts, depth, threshold):
    """Counts of each kept context by plain loops."""
    counts = {}
    edge = [ctw.EDGE] * depth
    total = 0
    for t in texts:
        data = edge + list(t) + [ctw.EDGE]
        for at in range(depth, len(data)):
            total += 1
            for d in range(depth + 1):
                counts.setdefault(tuple(data[at - d : at]), Counter())[data[at]] += 1
    return {c: n for c, n in counts.items() if not c or sum(n.values()) * threshold >= total}, total


def _slow_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def _slow_code(tree, depth, history, byte):
    """log10 of a byte's probability by the recursion over contexts, one decision at a time."""
    path = [()]
    while len(path[-1]) < depth:
        longer = tuple(history[len(history) - len(path[-1]) - 1 :])
        if longer not in tree:
            break
        path.append(longer)
    total = 0.0

    def split(counts, prefix, level):
        a = sum(n for y, n in counts.items() if y >> (8 - level) == prefix and not y >> (7 - level) & 1)
        b = sum(n for y, n in counts.items() if y >> (8 - level) == prefix and y >> (7 - level) & 1)
        return a, b

    def rest(context):
        left = Counter(tree[context])
        for child in tree:
            if len(child) == len(context) + 1 and child[1:] == context:
                left.subtract(tree[child])
        return left

    def weighted(context, prefix, level):
        own = _slow_kt(*split(tree[context], prefix, level))
        if len(context) == depth:
            return own
        below = _slow_kt(*split(rest(context), prefix, level))
        below += sum(weighted(c, prefix, level) for c in tree if len(c) == len(context) + 1 and c[1:] == context)
        return np.logaddexp(own, below) - math.log(2)

    for level in range(8):
        prefix, bit = byte >> (8 - level), byte >> (7 - level) & 1
        p, left = 0.0, 1.0
        for context in path:
            a, b = split(tree[context], prefix, level)
            stop = 1.0 if len(context) == depth else math.exp(_slow_kt(a, b) - math.log(2) - weighted(context, prefix, level))
            p += left * stop * (b + 0.5) / (a + b + 1)
            left *= 1 - stop
        a, b = split(rest(path[-1]), prefix, level) if len(path[-1]) < depth else (0, 0)
        p += left * (b + 0.5) / (a + b + 1)
        total += math.log10(p if bit else 1 - p)
    return total


def test_unigram_baseline_equals_plain_counts(spark, corpus, nothing):
    out = common.held_out(F.col("doc_id"), 7, 2)
    got = ctw.score_all(corpus, out).collect()
    rows = corpus.collect()
    assert len(got) == len(rows)
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    train = Counter(w for r in rows if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for w in tokens(r["text"]))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for r in rows:
        words = tokens(r["text"])
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
        want[(r["doc_id"], len(words), sum(train[w] > 0 for w in words), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert ctw.score_all(nothing, out).collect() == []
    untrained = ctw.score_all(corpus.where("doc_id = 101"), F.lit(True)).collect()
    assert [r["base_score"] for r in untrained] == [0.0] and abs(untrained[0]["score"] - 8 * math.log10(0.5)) <= 1e-6


def test_mixing_meets_targets_by_plain_arithmetic(spark, corpus, labels, nothing):
    assert mixing.mix(nothing, labels).collect() == []
    rows = mixing.mix(corpus, labels.limit(0)).collect()  # no labels: equal posteriors
    assert len(rows) == corpus.count() and {tuple(round(x, 9) for x in r["p"]) for r in rows} == {(1 / 3 // 1e-9 * 1e-9 + 0.0,) * 3}
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], 300)
    t = rng.integers(1, 100, 300)
    scored = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "tokens int, p array<double>")
    rate, log = mixing.rates(scored, {"clean": 0.5, "low": 0.2, "toxic": 0.3})
    r = np.array([x[0] for x in scored.select(rate).collect()])
    assert (r >= 0).all() and [b["loss"] <= a["loss"] + 1e-9 for a, b in zip(log, log[1:])].count(False) == 0
    have = (t * r) @ p
    first = t @ p
    goal = np.array([0.5, 0.2, 0.3]) * first[0] / 0.5
    assert np.abs(have - goal).max() / goal.sum() < 1e-2
    copies = mixing.mixed(corpus, labels)
    assert copies.columns == corpus.columns and copies.count() <= corpus.count()
    assert copies.select("doc_id").subtract(corpus.select("doc_id")).count() == 0


def test_packing_is_an_exact_round_trip(spark, corpus, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = _docs(spark, [(900, "Don't x.'s <|endoftext|> ΑΣ a≠b 3é C3PO--x …y", "en"), (901, "w" * 9000, "en"), (902, "a1b22", None)])
    docs = corpus.unionByName(odd)
    pieces = packing.pack(docs, path).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    ids = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [packing.END] for r in docs.collect()}
    copies = Counter(r["doc_id"] for r in docs.collect())
    covered, sequences = Counter(), {}
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {d: n * len(ids[d]) for d, n in copies.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH and at & (at - 1) == 0  # full, or a power of two
    assert packing.pack(nothing, path).collect() == []


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert_neighbours_touch(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_words_of_very_long_texts_are_whole(spark):
    rng = np.random.default_rng(12)
    long = "\t".join("".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(1, 3000, 2000))  # about 3 MB
    rows = [(1, long), (2, "w" * 700_000 + "\n" + "v" * 700_000), (3, "w")]
    got = {r["doc_id"]: r for r in ctw.score_all(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    train = Counter(w for _, t in rows for w in [*t.split(), None])
    n, v = sum(train.values()), len(train)
    for i, t in rows:
        words = [*t.split(), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(words), len(words), n)
        assert got[i]["base_score"] == pytest.approx(base)


@pytest.mark.parametrize(("frequent", "grams"), [(20, 1 << 18), (6, 5)])
def test_byte_scores_use_every_context(spark, monkeypatch, frequent, grams):
    monkeypatch.setattr(ctw, "FREQUENT", frequent, raising=False)
    monkeypatch.setattr(ctw, "GRAMS", grams, raising=False)
    # beside the long text all others' contexts hold less than 2^-16 of the bytes
    rows = [(0, "z" * 400_000), (1, "abracadabra"), (2, "abab abba"), (3, "ära"), (4, ""), (5, "abba abracadabra"), (6, "zebra"), (None, "qq"), (1, "abracadabra")]
    out = F.coalesce(F.col("doc_id") >= 5, F.lit(False))
    got = ctw.score_all(spark.createDataFrame(rows, "doc_id long, text string"), out).collect()
    tree, total = _slow_tree([t.encode() for i, t in rows if i is not None and i < 5], ctw.DEPTH, 1 << 60)
    want = []
    for i, t in rows[1:]:
        data = [ctw.EDGE] * ctw.DEPTH + list(t.encode()) + [ctw.EDGE]
        want.append((str(i), sum(_slow_code(tree, ctw.DEPTH, data[:at], data[at]) for at in range(ctw.DEPTH, len(data)))))
    mine = sorted((str(r["doc_id"]), r["score"]) for r in got if r["doc_id"] != 0)
    assert [i for i, _ in mine] == [i for i, _ in sorted(want)]
    assert np.allclose([x for _, x in mine], [x for _, x in sorted(want)], atol=1e-9)


def test_quality_tells_texts_by_their_words(spark):
    rng = np.random.default_rng(16)
    kinds = [["".join(map(chr, w)) for w in rng.integers(97, 123, (60, 6))] for _ in range(2)]  # as long and as lower-case
    docs = [(i, " ".join(kinds[i % 2][k] for k in rng.integers(0, 60, 40))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, label int")
    got = quality.scores(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] >= 200]
    assert len(right) == 200 and sum(right) >= 195


def test_no_task_or_driver_sees_the_whole_tree(spark, monkeypatch):
    monkeypatch.setattr(ctw, "FREQUENT", 0, raising=False)  # only a gram of all places would be broadcast
    docs = spark.createDataFrame([(1, "abracadabra"), (2, "abab abba")], "doc_id long, text string")
    grams = ctw.language_model(docs.select(F.col("text").cast("binary").alias("text"), F.lit(True).alias("learned")))[0][0]
    assert len(grams) == 0 and not hasattr(ctw, "_fit") and not hasattr(ctw, "weigh")
