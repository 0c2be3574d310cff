"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is taken from the centre of all vectors, scaled to unit length and rotated by a fixed random
rotation; the code is the sign of each coordinate.  With f, the inner product of the rotated vector and its
code (a point of the unit cube's corners), the inner product with a query is estimated by that of code
and query over f, and lies within ``BOUND * sqrt(1 / f^2 - 1) / sqrt(dim - 1)`` of it but for a small
chance.  The bound on the distance that follows says which vectors must be ranked anew: those whose least possible
distance is not over the tenth best distance known so far.  These are measured in double precision on the
original vectors, so scores are exact and only a failed bound can lose a neighbour.

Queries come in slices of a bounded number of rows; a slice is broadcast and every stored row is
compared with it in blocks.  Vectors of different lengths are not compared.  A row with a query's own id is
no candidate; of rows with one id that are queries the smallest vector counts.  A null id is no query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidary.llm.common import durable, stored
from evidary.llm.vectors import usable

#: Standard deviations of the estimate's error that the bound covers.
BOUND = 3.0
#: Queries in a slice, about (they are dealt by hash), and rows compared with them at once.
SLICE, ROWS = 4096, 1024
INDEX = "vec_id long, embedding array<float>, dim int, code binary, far double, fit double"
FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, dim)


def encode(vectors: DataFrame) -> DataFrame:
    """The index: every usable row of ``vectors`` (vec_id, embedding) with its code, its distance ``far`` from the centre
    of the vectors of its length, and ``fit`` (f; 1 for the centre itself)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where(usable(F.col("embedding")))
    rows = rows.withColumn("dim", F.size("embedding"))
    means = rows.select("dim", F.posexplode("embedding").alias("at", "x")).groupBy("dim", "at").agg(F.avg("x").alias("mean"))
    # One number for each place of each length of vector: as many as a vector of each length has.
    centres: dict[int, np.ndarray] = {}
    for r in means.orderBy("dim", "at").collect():
        centres.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = r["mean"]
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                x = _rows(some, dim) - shared.value[dim]
                far = np.linalg.norm(x, axis=1)
                turned = (x / np.where(far > 0, far, 1)[:, None]) @ rotation(dim).T
                fit = np.where(far > 0, np.abs(turned).sum(axis=1) / np.sqrt(dim), 1.0)
                bits = np.packbits(turned > 0, axis=1)
                codes = pa.array([b.tobytes() for b in bits], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), some.column("embedding"), some.column("dim"), codes, pa.array(far), pa.array(fit)],
                    names=["vec_id", "embedding", "dim", "code", "far", "fit"],
                )

    return stored(rows.mapInArrow(code, INDEX), "one-bit-codes"), centres


class _Best:
    """The nearest candidates so far of a slice of queries of one length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, centre: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        x = q - centre
        self.far = np.linalg.norm(x, axis=1)
        self.turned = ((x / np.where(self.far > 0, self.far, 1)[:, None]) @ rotation(q.shape[1]).T).astype(np.float32)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        self.known = [np.zeros(0, bool)] * len(ids)
        self.score = [np.zeros(0)] * len(ids)
        self.limit = np.full(len(ids), np.inf)

    def add(self, ids: np.ndarray, known: np.ndarray, x: np.ndarray, codes: np.ndarray, far: np.ndarray, fit: np.ndarray) -> None:
        """Candidates: ids (``known`` says which are not null), vectors, unpacked bits and correction scalars."""
        dim = x.shape[1]
        signs = codes.astype(np.float32) * 2 - 1
        guess = (signs @ self.turned.T) / (fit * np.sqrt(dim))[:, None]
        off = BOUND * np.sqrt(np.maximum(1 / fit**2 - 1, 0)) / np.sqrt(max(dim - 1, 1))
        squares = far[:, None] ** 2 + self.far**2
        cross = 2 * far[:, None] * self.far
        least = squares - cross * np.minimum(guess + off[:, None], 1)
        if len(ids) >= self.k:  # no more than the k-th least of the largest possible distances of candidates
            most = squares - cross * np.maximum(guess - off[:, None], -1)
            most[known[:, None] & (ids[:, None] == self.ids)] = np.inf
            bound = np.partition(most, self.k - 1, axis=0)[self.k - 1]
        else:
            bound = np.full(len(self.ids), np.inf)
        for j in range(len(self.ids)):
            limit = min(self.limit[j], bound[j])
            near = np.flatnonzero(least[:, j] <= limit + 1e-6 * (1 + abs(limit)))
            near = near[~known[near] | (ids[near] != self.ids[j])]
            if not len(near):
                continue
            score = np.sqrt(((x[near] - self.q[j]) ** 2).sum(axis=1))
            all_ids, all_known = np.concatenate([self.found[j], ids[near]]), np.concatenate([self.known[j], known[near]])
            all_scores = np.concatenate([self.score[j], score])
            first = np.lexsort((all_ids, ~all_known, all_scores))[: self.k]
            self.found[j], self.known[j], self.score[j] = all_ids[first], all_known[first], all_scores[first]
            if len(first) == self.k:
                self.limit[j] = self.score[j][-1] ** 2


def search(vectors: DataFrame, is_query: Column, k: int = 10, slice_rows: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` found for each query row."""
    spark = vectors.sparkSession
    index, centres = encode(vectors)
    queries = index.where(is_query & F.col("vec_id").isNotNull()).groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding"))
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("q")).select("vec_id", "q.dim", "q.embedding")
    queries = durable(queries)
    slices = max(1, -(-queries.count() // slice_rows))
    dealt = queries.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))
    best = None
    for at in range(slices):
        asked: dict[int, tuple[list, list]] = {}
        for r in dealt.where(F.col("slice") == at).collect():  # a slice has about slice_rows rows
            ids, rows = asked.setdefault(r["dim"], ([], []))
            ids.append(r["vec_id"])
            rows.append(r["embedding"])
        if not asked:
            continue
        packed = {d: (np.array(i, np.int64), np.array(v, np.float32).astype(np.float64), centres[d]) for d, (i, v) in asked.items()}
        shared = spark.sparkContext.broadcast(packed)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = {d: _Best(*q, k) for d, q in shared.value.items()}
            for batch in batches:
                dims = np.asarray(batch.column("dim"))
                for dim in np.unique(dims).tolist():
                    if dim not in held:
                        continue
                    some = batch.filter(pa.array(dims == dim))
                    for start in range(0, some.num_rows, ROWS):
                        part = some.slice(start, ROWS)
                        raw = b"".join(part.column("code").to_pylist())
                        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(part.num_rows, -1), axis=1)[:, :dim]
                        ids = part.column("vec_id")
                        known = np.asarray(ids.is_valid())
                        held[dim].add(
                            np.asarray(ids.fill_null(0)), known, _rows(part, dim), bits, np.asarray(part.column("far")), np.asarray(part.column("fit"))
                        )
            for b in held.values():
                n = [len(f) for f in b.found]
                if sum(n):
                    ids = pa.array(np.concatenate(b.found), mask=~np.concatenate(b.known))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, n)), ids, pa.array(np.concatenate(b.score))], names=["query_id", "vec_id", "score"])

        found = index.mapInArrow(compare, FOUND)
        order = Window.partitionBy("query_id").orderBy("score", F.col("vec_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        ranked = durable(ranked) if slices > 1 else ranked
        best = ranked if best is None else best.unionByName(ranked)
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return best
