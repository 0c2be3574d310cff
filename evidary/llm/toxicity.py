"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, pairs of neighbours, and pairs with one or two words between
them (lower case; ASCII punctuation separates), hashed to 2^18 places.  Every coordinate has its own
learning rate, and the L1 penalty keeps the weight of a place without evidence at exactly
zero; what is broadcast are the places and weights that are left, at most 2^18 of them.
The sample may hold other shares of the labels than the labelled rows; the score is corrected
to the shares of these.

Defined results: a null or blank text has no features and gets the score of the bias alone; without any
label to learn from every score is 0; rows and labels may repeat (see ``bounded_texts``).
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, DoubleType

from evidary.llm.common import bounded_texts, free_name, word_pieces

PLACES = 1 << 18
#: The fit takes at most so many documents of each label.
PER_LABEL = 4000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 10.0, 0.1, 6

_WORDS = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))


def feature_ids(text: str | None) -> np.ndarray:
    """The sorted distinct places of a text's features."""
    found, last = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    for words in word_pieces((text or "").lower().encode("utf-8", "replace").translate(_WORDS)):
        h = np.concatenate([last, np.fromiter(map(zlib.crc32, words), np.uint32, len(words))])
        grams = [h * np.uint32(2654435761)]
        for gap in (1, 2, 3):
            grams.append((h[:-gap] * np.uint32(31 + 2 * gap) + (h[gap:] ^ np.uint32(gap))) * np.uint32(2246822519))
        found = np.union1d(found, np.concatenate(grams) >> np.uint32(14))
        last = h[-3:]
    return found.astype(np.int32)


@pandas_udf(BinaryType())
def _feature_rows(texts: pd.Series) -> pd.Series:
    return pd.Series([feature_ids(t).tobytes() for t in texts], dtype=object)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over (places, label) rows in the order given."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for ids, label in rows:
            at = np.append(ids, PLACES)
            w = weights(z[at], n[at])
            g = 1 / (1 + math.exp(-min(max(w.sum(), -35), 35))) - label
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = weights(z, n)
    return w[:-1], float(w[-1])


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["order", "doc_id"])
    label = rows["label"].to_numpy()
    w, bias = ftrl([(np.frombuffer(f, np.int32), int(y)) for f, y in zip(rows["features"], label)])
    share, true = label.mean(), rows["share"].iloc[0]
    if 0 < share < 1:
        bias += math.log(true / (1 - true)) - math.log(share / (1 - share))
    at = np.flatnonzero(w)
    return pd.DataFrame({"model": [pickle.dumps((at.astype(np.int32), w[at].astype(np.float32), bias))]})


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> bytes | None:
    """Sparse weights from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``; None without labels."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    share = known.agg(F.avg("label").alias("share")).first()["share"]
    if share is None:
        return None
    rows = bounded_texts(docs, known, "label", per_label)
    rows = rows.select("doc_id", F.xxhash64("doc_id").alias("order"), "label", F.lit(float(share)).alias("share"), _feature_rows("text").alias("features"))
    got = rows.groupBy().applyInPandas(_fit, "model binary").first()
    return got["model"] if got else None


def score(docs: DataFrame, model: bytes | None, name: str) -> DataFrame:
    """``docs`` with a column ``name``: the probability that its ``text`` is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(DoubleType())
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if shared.value is None:
            for texts in batches:
                yield pd.Series(np.zeros(len(texts)))
            return
        at, values, bias = pickle.loads(shared.value)
        w = np.zeros(PLACES)
        w[at] = values
        for texts in batches:
            sums = np.array([w[feature_ids(t)].sum() for t in texts]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))

    return docs.withColumn(name, probability("text"))


def scores(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    name = free_name(docs, "toxic_score")
    return score(docs, fit(docs, labels, per_label), name).select("doc_id", F.col(name).alias("score"))
