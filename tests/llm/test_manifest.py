"""The Merkle manifest against a plain recursion, with every awkward row."""

import hashlib
import zlib

import pytest

from evidary.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree long, at string, no int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, low=False):
    doc_id, text, lang, source, n_chars = row[:5]
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _tree(nodes):
    """The root of ``nodes`` and the siblings on the way up from each."""
    ways, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, at in enumerate(places):
            first = at // 8 * 8
            ways[k].append((level[first:at], level[at + 1 : first + 8]))
        level = [_h(*level[k : k + 8]) for k in range(0, len(level), 8)]
        places = [p // 8 for p in places]
    return level[0], ways


def _expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[g] = (members, *_tree([_leaf(r) for r in members]))
    root, upper = _tree([trees[g][1] for g in order])
    found = []
    for g, way_up in zip(order, upper):
        members, subroot, ways = trees[g]
        for row, way in zip(members, ways):
            struck = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded, proof = _leaf(row, struck), []
            for left, right in [*way, *way_up]:
                folded = _h(*left, folded, *right)
                proof += [*left, *right]
            found.append((row[0], _leaf(row), subroot, root, _h(*proof), folded, folded == root))
    return found


def _key(row):
    return tuple(str(v) for v in row)


def _check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    got = manifest.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(_key, map(tuple, got.collect()))) == sorted(map(_key, _expected(rows)))
    return got


def test_proofs_equal_the_recursion(spark, monkeypatch):
    """More than eight groups, levels above a block, nulls everywhere, ties and repeated rows."""
    monkeypatch.setattr(manifest, "BLOCK", 64)
    rows = [(i, f"Text {i} ÄB", "en", "s", i) for i in range(700)]
    rows += [(i, f"Text {i}", f"l{i % 11}", None, None) for i in range(1000, 1040)]
    rows += [(None, None, None, None, None), (None, "", None, "A", 0), (5, "other", "en", "s", 1), (5, "Text 5 ÄB", "en", "s", 5), (5, "Text 5 ÄB", "en", "s", 5)]
    rows += [(9, "Ü" * 300_000 + "A", "zz", "s", 300_001), (-3, "x", "én", "s", 1)]
    _check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(4, "One", "en", "s", 3)], [(1, "One", "en", "s", 3), (2, "Two", "de", "s", 3)], [(k, "A", None, "s", 1) for k in range(9)]])
def test_small_tables(spark, rows):
    if not rows:
        assert manifest.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    else:
        _check(spark, rows)


def test_the_row_limit_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    _check(spark, [(k, "A", "en", "s", 1) for k in range(20)])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
