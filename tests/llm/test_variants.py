"""Spelling variants against brute force: the index alone, its searches over several blocks, and the whole query."""

import random
import re
import zlib
from collections import Counter

from evidary.llm import variants


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _words(count, letters="abcéÿ", seed=3):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(count)})


def test_suffix_array_sorts_suffixes():
    import numpy as np

    rng = np.random.default_rng(1)
    for text in (rng.integers(1, 4, 200), np.ones(50, np.int64), np.array([3])):
        text = np.append(text, 0)
        want = sorted(range(len(text)), key=lambda k: text[k:].tolist())
        assert variants.suffix_array(text).tolist() == want


def test_each_search_finds_exactly_its_half():
    words = _words(500)
    index = variants.Index(words)
    found = set()
    for length in {len(w) for w in words}:
        some = [w for w in words if len(w) == length]
        who, which = index.one_edit(some, length // 2)
        found |= {(some[i], words[j]) for i, j in zip(who, which)}
    assert all(_near(a, b) for a, b in found)
    assert found == {(a, b) for a in words for b in words if _near(a, b) and b.startswith(a[: len(a) // 2])}
    assert index.one_edit(["zzzzzz", "abzabc"], 3)[0].tolist() == []  # letters that the block lacks


def test_near_words_over_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 300)
    monkeypatch.setattr(variants, "WINDOW", 1)
    words = _words(700, "ab", 5) + ["aaaaaa" + c * 40 for c in "ab"] + ["aaaaaa" + "a" * 39 + "c"]
    words = sorted(set(words))
    n = {w: 5 + k for k, w in enumerate(words)}
    got = variants.near_words(spark.createDataFrame([(w, n[w]) for w in words], "word string, n long")).collect()
    pairs = {(r["word"], r["near"], r["near_n"]) for r in got}
    assert len(pairs) == len(got)
    assert pairs == {(a, b, n[b]) for a in words for b in words if _near(a, b)}


def _expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        low = (text or "").encode().lower().decode()
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    forms, near = {}, {}
    for w in n:
        near[w] = [v for v in n if _near(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted((w, forms[w], root(w), n[w], len(near[w]), n[forms[w]] if forms[w] else None) for w in n)


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 400)
    rng = random.Random(8)
    base = ["Straße", "größere", "Übermut", "english", "englisch", "wordings", "bananas"] + _words(60, "abcdeé", 9)
    rows = []
    for doc in range(400):
        words = [rng.choice(base) if rng.random() < 0.4 else base[rng.randrange(7)] for _ in range(40)]
        rows.append((doc, " ".join(words) + rng.choice([" 12x", "-ENGLISH.", "×englis", ""])))
    chain = [("abcdefgh", 700), ("abcdefg", 100), ("abcdef", 9)]  # forms in a row
    rows += [(1000 + k, " ".join([w] * c)) for k, (w, c) in enumerate(chain)]
    rows += [(None, "english " * 5), (7, None), (8, ""), (9, "short by ein"), rows[3], rows[3], (10_000, "bananas, " * 250_000)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n long, block string")
    got = variants.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == _expected(rows)


def test_counts_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    text = "wording bananas xy " * 40
    whole = list(variants._pieces(text, re.compile("[^a-zÀ-ÿ]")))
    monkeypatch.setattr(variants, "PIECE", 10)
    pieces = list(variants._pieces(text, re.compile("[^a-zÀ-ÿ]")))
    assert len(whole) == 1 and len(pieces) > 30 and "".join(pieces) == text
    assert Counter(w for p in pieces for w in re.findall("[a-z]+", p)) == Counter(re.findall("[a-z]+", text))


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(empty).count() == 0
    assert variants.variants(spark.createDataFrame([(1, "a few words only once")], "doc_id long, text string")).count() == 0
