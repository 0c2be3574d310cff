"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Equal vectors of a label form a class, and classes are dealt to shards of a bounded number of rows.  Each shard gets a
graph; for every two shards of a label (and each with itself) one task asks the second shard's graph for the
neighbours of the first shard's vectors.  The beam starts at ``BEAM`` and doubles until an audit is passed: of ``AUDITED``
rows the graph must find ``NEAR_RECALL`` of the ten nearest neighbours, which every row has however sparse links are, and
``RECALL`` of their links and of ``PLANTED`` copies of indexed vectors, moved away by cosines from the radius up.  Only a
pair of shards whose widest beam fails is compared exactly, in blocks.  Vectors that cannot be reached from all others in the lowest layer are
compared with every query.  A query whose whole beam is within the radius has more neighbours than the beam
holds; it is measured against the whole shard in blocks, so no group is cut short.  Links are pairs with a cosine, in double precision on the
original vectors, of at least the radius.

A task returns, for each class, how many vectors it linked and edges of a spanning forest
instead of all pairs: what leaves a task is linear in its rows.

Vectors that are null, zero or hold null or non-finite components, and those without a label, link
with nothing.  Rows with equal ids are vectors of their own; a null id is never the smallest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evidary.llm.common import durable, stored
from evidary.llm.graph import components
from evidary.llm.vectors import matrix, usable

RADIUS = 0.93
#: Neighbours of a node in a layer, and of the lowest layer; beam while building; rows of a shard.
DEGREE, LOWEST, BUILD_BEAM, SHARD = 16, 32, 48, 16384
#: First beam; rows and planted copies of an audit, nearest neighbours asked for; shares of links and of nearest neighbours to be found.
BEAM, AUDITED, PLANTED, NEAREST, RECALL, NEAR_RECALL = 32, 64, 192, 10, 0.999, 0.9
AT_ONCE = 512


class Graph:
    """The layers of one shard: node lists from the lowest layer up, and each layer's neighbours."""

    def __init__(self, vectors: np.ndarray, seed: int = 5) -> None:
        self.unit = vectors
        order = np.random.default_rng(seed).permutation(len(vectors)).astype(np.int32)
        # a layer holds about one in DEGREE of the nodes of the layer below
        sizes = [len(order)]
        while sizes[-1] > 4 * DEGREE * DEGREE:
            sizes.append(max(DEGREE, sizes[-1] // DEGREE))
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(len(sizes) - 1, -1, -1):
            self.layers.insert(0, self._grow(order[: sizes[at]], LOWEST if at == 0 else DEGREE))
        self.top = self.layers[-1][0][:DEGREE]
        self.main = self._connected(int(self.top[0]))

    def _connected(self, entry: int) -> np.ndarray:
        """Which nodes of the lowest layer are reached from ``entry`` and reach it."""
        links = self.layers[0][1]
        there = np.zeros(len(links) + 1, bool)  # the last place is for -1
        back = there.copy()
        there[entry] = back[entry] = True
        new = np.array([entry])
        while len(new):
            new = np.unique(links[new])
            new = new[(new >= 0) & ~there[new]]
            there[new] = True
        size = 0
        while size < (size := int(back.sum())):
            back[:-1] |= back[links].any(axis=1)
        return there[:-1] & back[:-1]

    def _grow(self, nodes: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
        """A layer over ``nodes``, put in by groups; neighbours are numbers of vectors, -1 for none."""
        links = np.full((len(self.unit), degree), -1, np.int32)
        first = nodes[: 4 * degree]
        self._join(links, first, np.zeros((len(first), 0), np.int32))
        done = len(first)
        while done < len(nodes):
            new = nodes[done : done + min(done, AT_ONCE)]
            starts = self._starts(self.unit[new], nodes[:1])
            found, _ = self._walk(links, self.unit[new], starts, BUILD_BEAM)
            self._join(links, new, found)
            done += len(new)
        return nodes, links

    def _join(self, links: np.ndarray, new: np.ndarray, found: np.ndarray) -> None:
        """Link new nodes with their choice among what was found and each other, both ways."""
        degree = links.shape[1]
        v = self.unit[new]
        among = v @ v.T
        np.fill_diagonal(among, -2)
        near = min(degree, len(new) - 1)
        mates = new[np.argpartition(-among, near - 1, axis=1)[:, :near]] if near > 0 else np.zeros((len(new), 0), np.int32)
        options = np.concatenate([found, mates.astype(np.int32)], axis=1)
        chosen = self._choose(v, options, degree // 2)
        links[new, : chosen.shape[1]] = chosen
        # the way back: every target takes the new ones among its own best
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        told, first, count = np.unique(target, return_index=True, return_counts=True)
        for start in range(0, len(told), AT_ONCE):
            some, n = told[start : start + AT_ONCE], count[start : start + AT_ONCE]
            width = min(int(n.max()), 2 * degree)
            offers = np.full((len(some), width), -1, np.int32)
            for i, (f, c) in enumerate(zip(first[start : start + AT_ONCE], np.minimum(n, width))):
                offers[i, :c] = source[f : f + c]
            links[some] = self._choose(self.unit[some], np.concatenate([links[some], offers], axis=1), degree, spread=False)

    def _choose(self, v: np.ndarray, options: np.ndarray, degree: int, spread: bool = True) -> np.ndarray:
        """Of each row's options the nearest, where ``spread`` holds those first that are nearer to the row than to one chosen."""
        near = np.einsum("qkd,qd->qk", self.unit[options], v)
        near[(options < 0) | _repeated(options)] = -3
        by = np.argsort(-near, axis=1)[:, : 3 * degree]
        options, near = np.take_along_axis(options, by, 1), np.take_along_axis(near, by, 1)
        options[near <= -3] = -1
        if not spread or options.shape[1] <= degree:
            out = options[:, :degree]
        else:
            w = self.unit[options]
            between = np.einsum("qid,qjd->qij", w, w)
            kept = np.zeros(options.shape, bool)
            for k in range(options.shape[1]):
                closest = np.where(kept, between[:, k, :], -3).max(axis=1)
                kept[:, k] = (options[:, k] >= 0) & (closest < near[:, k]) & (kept.sum(axis=1) < degree)
            # places left are filled with the nearest of the others
            by = np.argsort(np.where(kept, 0, 1) * options.shape[1] + np.arange(options.shape[1]), axis=1)[:, :degree]
            out = np.take_along_axis(options, by, 1)
        if out.shape[1] < degree:
            out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
        return out

    def _starts(self, q: np.ndarray, default: np.ndarray) -> np.ndarray:
        """Where to enter the layer below those that are there: the best node of a short walk down."""
        if not self.layers:
            return np.repeat(default[None, :1], len(q), axis=0)
        top = self.layers[-1][0][:DEGREE]
        at = top[(q @ self.unit[top].T).argmax(axis=1)][:, None]
        for _, links in reversed(self.layers):
            at, _ = self._walk(links, q, at[:, :1], 4)
        return at[:, :1]

    def _walk(self, links: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """A beam search for each query: the best nodes, nearest first, and their inner products."""
        n = len(q)
        ids = np.full((n, beam), -1, np.int32)
        near = np.full((n, beam), -3, np.float32)
        open_ = np.zeros((n, beam), bool)
        seen = np.zeros((n, len(self.unit) + 1), bool)  # the last place is for -1
        seen[:, -1] = True
        ids[:, : starts.shape[1]] = starts
        near[:, : starts.shape[1]] = np.einsum("qkd,qd->qk", self.unit[starts], q)
        open_[:, : starts.shape[1]] = True
        np.put_along_axis(seen, starts.astype(np.int64), True, 1)
        live = np.arange(n)
        while len(live):
            worth = np.where(open_[live], near[live], -9)
            pick = np.argpartition(-worth, min(wide, beam) - 1, axis=1)[:, :wide]
            good = np.take_along_axis(worth, pick, 1) > -9
            nodes = np.where(good, np.take_along_axis(ids[live], pick, 1), -1)
            mark = open_[live]
            np.put_along_axis(mark, pick, False, 1)
            open_[live] = mark
            next_ = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
            next_[seen[live[:, None], next_]] = -1
            next_[_repeated(next_)] = -1
            seen[live[:, None], next_] = True
            gain = np.einsum("qkd,qd->qk", self.unit[next_], q[live])
            gain[next_ < 0] = -3
            all_ids = np.concatenate([ids[live], next_], axis=1)
            all_near = np.concatenate([near[live], gain], axis=1)
            all_open = np.concatenate([open_[live], next_ >= 0], axis=1)
            best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            ids[live], near[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_near, all_open))
            live = live[open_[live].any(axis=1)]
        by = np.argsort(-near, axis=1)
        return np.take_along_axis(ids, by, 1), np.take_along_axis(near, by, 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query."""
        at = self.top[(q @ self.unit[self.top].T).argmax(axis=1)][:, None]
        for _, links in reversed(self.layers[1:]):
            at, _ = self._walk(links, q, at[:, :1], 8)
        at = np.where(self.main[at], at, self.top[0])
        return self._walk(self.layers[0][1], q, at[:, :1], min(beam, len(self.unit)))


def _repeated(rows: np.ndarray) -> np.ndarray:
    """Which entries of a row have stood before in it."""
    by = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, by, 1)
    again = np.zeros(rows.shape, bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    out = np.empty_like(again)
    np.put_along_axis(out, by, again, 1)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares do not overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _audited(a: np.ndarray, b: np.ndarray, radius: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a graph over ``b`` is tried on: some rows of ``a``, their nearest others and their links, and planted near copies of rows of ``b`` with their originals."""
    rng = np.random.default_rng(7)
    rows = np.sort(rng.permutation(len(a))[:AUDITED])
    cosine = a[rows] @ b.T
    if same:
        cosine[np.arange(len(rows)), rows] = -2
    k = min(NEAREST, len(b) - same)
    nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(rows), 0), np.int64)
    origin = rng.permutation(len(b))[:PLANTED]
    away = rng.standard_normal((len(origin), b.shape[1]))
    away -= (away * b[origin]).sum(axis=1, keepdims=True) * b[origin]
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    # cosines from the radius up to nearly one
    close = np.linspace(radius + 1e-3, 1 - 1e-3, len(origin))[:, None]
    return rows, nearest, cosine >= radius, close * b[origin] + np.sqrt(1 - close * close) * away, origin


def linked(a: np.ndarray, b: np.ndarray | None, radius: float, report: dict | None = None) -> np.ndarray:
    """Which rows of ``a`` (all unit vectors in double precision) link with which of ``b``, as packed bits; ``b`` None: with ``a`` itself.

    ``report`` takes the last ``beam``, the ``recall`` of its audit, how many rows were ``searched`` by the graph, and whether the pair was compared ``exact``-ly.
    """
    same = b is None
    b = a if same else b
    n = len(b)
    graph = Graph(b.astype(np.float32))
    found = np.zeros((len(a), -(-n // 8)), np.uint8)
    loose = radius - 1e-5
    q = a.astype(np.float32)
    stray = np.flatnonzero(~graph.main)

    def exact(at: np.ndarray) -> np.ndarray:
        bits = a[at] @ b.T >= radius
        if same:
            bits[np.arange(len(at)), at] = False
        return bits

    def rows(at: np.ndarray, beam: int) -> np.ndarray:
        """The links found for some rows of ``a``."""
        ids, near = graph.search(q[at], beam)
        bits = np.zeros((len(at), n), bool)
        full = near[:, -1] >= loose
        who, col = np.nonzero((near >= loose) & ~full[:, None] & (ids >= 0))
        what = ids[who, col]
        good = np.einsum("kd,kd->k", a[at[who]], b[what]) >= radius
        bits[who[good], what[good]] = True
        if full.any():
            bits[full] = a[at[full]] @ b.T >= radius
        bits[:, stray] = a[at] @ b[stray].T >= radius
        if same:
            bits[np.arange(len(at)), at] = False
        return bits

    tried, nearest, links, copies, origin = _audited(a, b, radius, same)

    def recall(beam: int) -> tuple[float, float]:
        """The shares of the nearest neighbours, and of links and planted copies, that the graph finds."""
        ids, _ = graph.search(q[tried], beam)
        near = sum(len(np.intersect1d(x, y)) for x, y in zip(ids, nearest)) / max(nearest.size, 1)
        hits, total = int((rows(tried, beam) & links).sum()), int(links.sum())
        ids, close = graph.search(copies.astype(np.float32), beam)
        # one whose whole beam is within the radius is measured against all, and strays are compared with all
        hits += int(((ids == origin[:, None]).any(axis=1) | (close[:, -1] >= loose) | ~graph.main[origin]).sum())
        return near if nearest.size else 1.0, hits / (total + len(origin))

    beam = min(BEAM, n)
    while not (passed := (low := recall(beam))[0] >= NEAR_RECALL and low[1] >= RECALL) and beam < n:
        beam = min(2 * beam, n)
    for start in range(0, len(a), AT_ONCE):
        at = np.arange(start, min(start + AT_ONCE, len(a)))
        found[at] = np.packbits(rows(at, beam) if passed else exact(at), axis=1)
    if report is not None:
        report |= {"beam": beam, "recall": low, "searched": len(a) if passed else 0, "exact": not passed}
    if same:  # found one way is found
        for start in range(0, n, 1024):
            block = np.unpackbits(found[:, start // 8 : (start + 1024) // 8], axis=1)[:, : n - start]
            found[start : start + 1024] |= np.packbits(block.T.astype(bool), axis=1)[: min(1024, n - start)]
    return found


def _forest(found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a two-sided link table: pairs of (row, column) that connect what its links connect."""
    row_root, col_seen = np.arange(len(found)), np.full(n, -1)
    pairs: list[tuple[int, int]] = []

    def root(r: int) -> int:
        while row_root[r] != r:
            row_root[r] = row_root[row_root[r]]
            r = row_root[r]
        return r

    for r in np.flatnonzero(found.any(axis=1)).tolist():
        cols = np.flatnonzero(np.unpackbits(found[r])[:n])
        owners = col_seen[cols]
        new = cols[owners < 0]
        pairs += [(r, c) for c in new.tolist()]
        col_seen[new] = r
        for c, o in zip(*[x.tolist() for x in np.unique(owners[owners >= 0], return_index=True)][::-1]):
            a, b = root(o), root(r)
            if a != b:
                row_root[b] = a
                pairs.append((r, int(cols[np.flatnonzero(owners == o)[0]])))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = np.array(pairs, np.int64)
    return got[:, 0], got[:, 1]


TASK = "a long, b long, n long"


def _task(radius: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Two shards' rows (side 0 and 1; one side only: with itself): link counts (a, null, n) and edges (a, b, null)."""
        out = []
        rows = rows.sort_values(["side", "cls"], kind="stable")
        for _, some in rows.groupby("dim"):
            left, right = some[some["side"] == 0], some[some["side"] == 1]
            same = key[1] == key[2]
            if not len(left) or not (same or len(right)):
                continue
            a = _unit(matrix(left["embedding"], len(left)))
            b = None if same else _unit(matrix(right["embedding"], len(right)))
            other = left if same else right
            found = linked(a, b, radius)
            copies = other["copies"].to_numpy(np.int64)
            back = np.zeros(len(other), np.int64)
            mine = left["copies"].to_numpy(np.int64)
            for start in range(0, len(left), AT_ONCE):
                bits = np.unpackbits(found[start : start + AT_ONCE], axis=1)[:, : len(other)]
                out.append(pd.DataFrame({"a": left["cls"].to_numpy()[start : start + AT_ONCE], "b": None, "n": bits @ copies}))
                back += mine[start : start + AT_ONCE] @ bits
            if not same:
                out.append(pd.DataFrame({"a": other["cls"].to_numpy(), "b": None, "n": back}))
            r, c = _forest(found, len(other))
            out.append(pd.DataFrame({"a": left["cls"].to_numpy()[r], "b": other["cls"].to_numpy()[c], "n": None}))
        got = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []})
        got = got[got["b"].notna() | (got["n"] != 0)]
        return got.astype({"a": "int64", "b": "Int64", "n": "Int64"})

    return compare


def near_duplicates(vectors: DataFrame, radius: float = RADIUS, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "label")
    rows = rows.withColumn("live", usable(F.col("embedding")) & F.col("label").isNotNull())
    # classes of equal vectors; a class is named by a number of its own, as its ids may be null
    classes = rows.where("live").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("label").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = classes.join(F.broadcast(sizes) if sizes.count() <= 1 << 16 else sizes, "label")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("cls"), F.col("shards")).cast("int"))
    # each class goes to the pairs (i, j), i <= j, that its shard is part of
    asked = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    pairs = asked.select(
        "label", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"),
        (F.col("shard") > F.col("other")).cast("int").alias("side"), F.size("embedding").alias("dim"), "cls", "embedding", "copies",
    )
    found = pairs.groupBy("label", "i", "j").applyInPandas(_task(radius), TASK)
    found = durable(found)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cls")
    rooted = classes.select("cls", "label", "embedding", "rep", "copies").join(roots, "cls", "left").join(counts, "cls", "left")
    rooted = durable(rooted.withColumn("root", F.coalesce("root", "cls")))
    least = durable(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = rooted.join(least, "root").select("label", "embedding", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    named = durable(named.withColumn("live", F.lit(True)))
    joined = rows.join(named, ["label", "embedding", "live"], "left")
    got = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return got.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
