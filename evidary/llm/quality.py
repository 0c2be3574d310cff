"""Document quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its lower-cased words, hashed to ``WORDS`` places and weighted by how few of all documents have them;
beside them pairs of neighbouring character classes (letters, capitals, digits, blanks and kinds of symbols), how often a
word repeats the one before it, what share of its words are distinct, and how many words it has.
Square roots of relative counts, less their means over the labelled sample, are projected on the sample's first
singular directions (by subspace iteration).  The sample's projected vectors with their labels are broadcast (their number
is bounded by ``PER_LABEL``); every document is compared with all of them in blocks of exact cosine products, and its
``NEIGHBOURS`` nearest vote with their similarities, each label scaled to its share among all labels.

Defined results: a null or empty text has no terms and is compared as such; without labels every score is 0.5; texts of
over a megabyte are read in pieces, which changes no count.  Of neighbours equally near those with the smaller document ids vote.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, DoubleType

from evidary.llm.common import bounded_texts, free_name, hashed_words, joined, repeated, segments

#: The sample takes at most about so many documents of each label.
PER_LABEL = 2000
DIRECTIONS, NEIGHBOURS = 32, 15
BLOCK = 2048


def _classes() -> np.ndarray:
    kinds = [" ", "\t\r\n", ".", ",", "|", "%", "*", "!", "&", "$", "#", "?", "\"'", "-_", "()[]{}", "@", "/\\", ":;", "<>", "=+~^`"]
    table = np.zeros(256, np.int64)  # lower case and all beyond ASCII
    for k, chars in enumerate(kinds):
        table[[ord(c) for c in chars]] = k + 3
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    return table


_CLASS = _classes()
KINDS = 23
TERMS = KINDS * KINDS
#: Places of hashed words; they come last in a row of terms.
WORDS = 4096
WIDTH = TERMS + 3 + WORDS
#: Edges of the shares of repeated and of distinct words, and of word counts (powers of two).
REPEATED, DISTINCT, SIZES = np.array([0.01, 0.05, 0.2]), np.linspace(0.1, 0.9, 9), 2.0 ** np.arange(2, 14)


def _counts(texts) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) of texts, each row once: class pairs, words, repeated words, distinct words, hashed words.

    Long texts come in pieces that end at white space, each with the byte before it; a row's last word and its words so far are
    carried from run to run, so the counts do not depend on where a text is cut.
    """
    at, held, going = 0, None, -1
    last, seen = None, np.zeros(0, np.uint64)
    for first, rows, pieces in segments(texts, 1, words=True):
        data, piece, row_of = joined(pieces)
        old = repeated(pieces, first, going, 1)
        on = held is not None and first == at + len(held) - 1  # the last row goes on
        going = first + pieces[-1][0]
        row = row_of[piece]
        counts = np.zeros((rows, WIDTH))
        kind = _CLASS[data]
        pair = np.flatnonzero(piece[:-1] == piece[1:])
        counts[:, :TERMS] = np.bincount(row[pair] * TERMS + kind[pair] * KINDS + kind[pair + 1], minlength=rows * TERMS).reshape(rows, TERMS)
        breaks = np.concatenate(([True], piece[1:] != piece[:-1])) if len(data) else np.zeros(0, bool)
        starts, _, words = hashed_words(data, breaks)
        low = hashed_words(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8), breaks)[2]
        new = ~old[starts]
        mine, words, low = row[starts[new]], words[new], low[new]
        counts[:, TERMS] = np.bincount(mine, minlength=rows)
        again = (words[1:] == words[:-1]) & (mine[1:] == mine[:-1])
        counts[:, TERMS + 1] = np.bincount(mine[1:][again], minlength=rows)
        by = np.lexsort((words, mine))
        once = np.ones(len(by), bool)
        once[1:] = (words[by][1:] != words[by][:-1]) | (mine[by][1:] != mine[by][:-1])
        own_rows, own = mine[by][once], words[by][once]
        counts[:, TERMS + 2] = np.bincount(own_rows, minlength=rows)
        counts[:, TERMS + 3 :] = np.bincount(mine * WORDS + (low % np.uint64(WORDS)).astype(np.int64), minlength=rows * WORDS).reshape(rows, WORDS)
        if on:
            begun = own[own_rows == 0]
            counts[0, TERMS + 2] -= np.isin(begun, seen).sum()
            counts[0, TERMS + 1] += bool(last is not None and len(mine) and mine[0] == 0 and words[0] == last)
        ending = own[own_rows == rows - 1]
        if rows > 1 or not on:
            seen, last = ending, None
        else:
            seen = np.union1d(seen, ending)
        if len(mine) and mine[-1] == rows - 1:
            last = words[-1]
        if held is not None:
            if on:
                counts[0] += held[-1]
                held = held[:-1]
            if len(held):
                yield at, held
        at, held = first, counts
    if held is not None:
        yield at, held


def features(texts) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of the terms of texts, each row once."""
    for first, counts in _counts((t or b"") + b"\n" for t in texts):
        pairs = counts[:, :TERMS]
        words = np.maximum(counts[:, TERMS], 1)
        marks = np.zeros((len(counts), len(REPEATED) + len(DISTINCT) + len(SIZES) + 3))
        offset = 0
        for values, edges, weight in (
            (counts[:, TERMS + 1] / words, REPEATED, 0.5), (counts[:, TERMS + 2] / words, DISTINCT, 0.25), (counts[:, TERMS], SIZES, 0.15)
        ):
            marks[np.arange(len(counts)), offset + np.searchsorted(edges, values, side="right")] = weight
            offset += len(edges) + 1
        yield first, np.hstack([np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)), marks, np.sqrt(counts[:, TERMS + 3 :] / words[:, None])]).astype(np.float32)


@pandas_udf(BinaryType())
def _feature_rows(texts: pd.Series) -> pd.Series:
    return pd.Series([row.tobytes() for _, x in features(texts) for row in x], dtype=object)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n): how many of a task's texts have a word of each place, and at -1 the number of texts."""
    have, texts = np.zeros(WORDS, np.int64), 0
    for batch in batches:
        texts += batch.num_rows
        for _, x in features(batch.column(0).to_pylist()):
            have += (x[:, -WORDS:] > 0).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WORDS)), pa.array(np.append(texts, have))], names=["place", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The weight of each place of words over all of ``docs``, the rarest 1."""
    found = docs.select(F.col("text").cast("binary")).mapInArrow(_document_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    n = {r["place"]: r["n"] for r in found.collect()}  # a row for each place
    texts = n.get(-1, 0)
    return np.array([np.log((1 + texts) / (1 + n.get(k, 0))) for k in range(WORDS)]) / max(np.log(1 + texts), 1e-9)


def _directions(x: np.ndarray, most: int) -> np.ndarray:
    """The first singular directions of ``x`` (columns)."""
    width = min(2 * most, *x.shape)
    q = np.random.default_rng(3).standard_normal((x.shape[1], width))
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, s, turn = np.linalg.svd(x @ q, full_matrices=False)
    return q @ turn[: min(most, int((s > 1e-9).sum()) or 1)].T


def model_of(x: np.ndarray, label: np.ndarray, true: float, inverse: np.ndarray) -> tuple:
    """The model from the sample's terms and labels; ``true`` is the share of label 1 among all."""
    mean = x.mean(axis=0)
    weigh = np.append(np.ones(x.shape[1] - WORDS), inverse)
    turn = weigh[:, None] * _directions((x - mean) * weigh, DIRECTIONS)
    weight = np.where(label == 1, true / max(label.mean(), 1e-9), (1 - true) / max(1 - label.mean(), 1e-9)).astype(np.float32)
    return mean.astype(np.float32), turn.astype(np.float32), _unit((x - mean) @ turn).astype(np.float32), label, weight


def _fit(inverse: np.ndarray):
    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        x = np.stack([np.frombuffer(f, np.float32) for f in rows["features"]]).astype(np.float64)
        model = model_of(x, rows["label"].to_numpy(np.float32), float(rows["share"].iloc[0]), inverse)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    return fitted


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> bytes | None:
    """Directions and labelled vectors from ``labels`` (doc_id, label 0 or 1); None without labels."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    share = known.agg(F.avg("label").alias("share")).first()["share"]
    if share is None:
        return None
    rows = bounded_texts(docs, known, "label", per_label)
    rows = rows.select("doc_id", "label", F.lit(float(share)).alias("share"), _feature_rows(F.col("text").cast("binary")).alias("features"))
    got = rows.groupBy().applyInPandas(_fit(inverse_frequencies(docs)), "model binary").first()
    return got["model"] if got else None


def _nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's ``k`` largest values; of equal ones the first columns."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    taken = near >= least[:, None]
    for r in np.flatnonzero(taken.sum(axis=1) > k):
        tied = np.flatnonzero(near[r] == least[r])
        taken[r, tied[len(tied) - (int(taken[r].sum()) - k) :]] = False
    return np.nonzero(taken)[1].reshape(len(near), k)


def vote(x: np.ndarray, model: tuple, k: int = NEIGHBOURS) -> np.ndarray:
    """The score of each row of terms; of neighbours equally near in six places those with the smaller ids vote."""
    mean, turn, known, label, weight = model
    k = min(k, len(known))
    near = np.round(_unit((x - mean) @ turn) @ known.T, 6)
    best = _nearest(near, k)
    voice = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** 4 * weight[best]
    return np.clip((voice * label[best]).sum(axis=1, dtype=np.float64) / voice.sum(axis=1, dtype=np.float64), 0, 1)


def score(docs: DataFrame, model: bytes | None, name: str) -> DataFrame:
    """``docs`` with a column ``name``: how likely its ``text`` is of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(DoubleType())
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = pickle.loads(shared.value) if shared.value else None
        for texts in batches:
            out = np.full(len(texts), 0.5)
            if fitted:
                for first, x in features(texts):
                    for at in range(0, len(x), BLOCK):
                        out[first + at : first + min(at + BLOCK, len(x))] = vote(x[at : at + BLOCK], fitted)
            yield pd.Series(out)

    return docs.withColumn(name, probability(F.col("text").cast("binary")))


def scores(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    name = free_name(docs, "quality_score")
    return score(docs, fit(docs, labels, per_label), name).select("doc_id", F.col(name).alias("score"))
