"""Language identification by error-correcting output codes.

Each language has a codeword of signs.  For every bit a linear classifier over hashed byte 1- to 3-grams
(letters lower-cased, all else one space; square roots of counts at unit length) learns which side
a text's language is on.  Decoding adds up, for each language, the logistic loss of
its codeword's bits, weighted by how reliable each bit was in training, and takes the least; a text
whose best two languages are closer than ``margin`` in probability is flagged ambiguous.

Up to ``EXHAUSTIVE`` languages use the exhaustive code (every split of the languages is a bit),
more use random codewords of ``32 + 8 log2 K`` bits whose least distance is the best of a few draws.

Defined results: a text that is null or has no letter is ``und`` with score 0 and flagged; with no learnable
language every text is ``und``; with one, that language; of languages with equal losses the first by name is taken.  Texts
are used whole: long ones are read in pieces, and what lies across two pieces is counted once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField, StructType

from evidary.llm.common import bounded_texts, counted, free_name

DIMS = 4096
EXHAUSTIVE = 6
#: The classifier learns from at most so many documents of each language.
PER_LANGUAGE = 1000
MARGIN = 0.1

_SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")
RESULT = StructType(
    [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
)


def _gram_keys(data: np.ndarray, piece: np.ndarray, old: np.ndarray):
    packed = data.astype(np.uint32)
    gram = packed
    for n in (1, 2, 3):
        if n > 1:
            gram = (gram[:-1] << np.uint32(8)) | packed[n - 1 :]
        if not len(gram):
            return
        key = ((gram + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20)
        # a gram counts where its last byte is new
        whole = np.flatnonzero((piece[: len(gram)] == piece[n - 1 :]) & ~old[n - 1 :])
        yield whole, key[whole].astype(np.int64)


def _features(texts) -> Iterator[tuple[int, np.ndarray]]:
    plain = ((t or "").lower().encode("utf-8", "replace").translate(_SPACES) for t in texts)
    for first, counts in counted(plain, _gram_keys, DIMS, 2):
        x = np.sqrt(counts.astype(np.float32))
        yield first, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@pandas_udf(BinaryType())
def _feature_rows(texts: pd.Series) -> pd.Series:
    return pd.Series([row.astype(np.float16).tobytes() for _, x in _features(texts) for row in x], dtype=object)


def codewords(languages: int) -> np.ndarray:
    """A row of signs for each language."""
    if languages <= EXHAUSTIVE:
        splits = range(1, 1 << (languages - 1)) if languages > 1 else []
        return np.array([[1 if (s << 1) >> k & 1 else -1 for s in splits] for k in range(languages)], np.float32).reshape(languages, -1)
    bits = 32 + int(8 * np.ceil(np.log2(languages)))
    best, least = None, -1
    for seed in range(20):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (languages, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(languages) * bits
        if apart.min() > least:
            best, least = code, apart.min()
    return best


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    langs = sorted(rows["lang"].unique())
    x = np.stack([np.frombuffer(f, np.float16) for f in rows["features"]]).astype(np.float32)
    code = codewords(len(langs))
    y = code[np.searchsorted(langs, rows["lang"].to_numpy())]
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # languages weigh the same, however many samples each has
    share = 1 / rows.groupby("lang")["lang"].transform("size").to_numpy(np.float32) / len(langs)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    step = w
    for k in range(120):
        ahead = w + step * (k / (k + 3))
        slope = x.T @ (-y / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30))) * share[:, None]) + 1e-6 * ahead
        step, w = ahead - 4 * slope - w, ahead - 4 * slope
    right = ((np.sign(x @ w) == y) * share[:, None]).sum(axis=0)
    return pd.DataFrame({"model": [pickle.dumps((langs, code, w, right.astype(np.float32)))]})


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> bytes | None:
    """A model from the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds; None if there are none.

    The sample is bounded by ``per_language`` for each language; one task fits it.
    """
    wanted = docs.where(learn).select("doc_id", "lang")
    sample = bounded_texts(docs, wanted, "lang", per_language).where(F.col("text").rlike(r"\p{L}"))
    rows = sample.select("lang", _feature_rows("text").alias("features"))
    got = rows.groupBy().applyInPandas(_fit, "model binary").first()
    return got["model"] if got else None


def identify(docs: DataFrame, model: bytes | None, name: str, margin: float = MARGIN) -> DataFrame:
    """``docs`` with a struct column ``name`` of (lang_pred, score, ambiguous) from its ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(RESULT)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, code, w, right = pickle.loads(shared.value) if shared.value else ([], np.zeros((0, 0)), None, None)
        names = np.array([*langs, "und"], dtype=object)
        for texts in batches:
            n = len(texts)
            found, score, second = np.full(n, len(langs)), np.zeros(n), np.zeros(n)
            lettered = np.fromiter((bool(t) and _LETTER.search(t) is not None for t in texts), bool, n)
            for first, x in _features(texts) if langs else ():
                margins = x @ w[:-1] + w[-1]
                weight = np.maximum(right - 0.5, 0.01)
                # loss of language k: the weighted logistic losses of its bits, computed bit by language
                loss = (np.logaddexp(0, -margins[:, None, :] * code[None]) * weight).sum(axis=2, dtype=np.float64)
                p = np.exp(loss.min(axis=1, keepdims=True) - loss)
                p /= p.sum(axis=1, keepdims=True)
                at = slice(first, first + len(x))
                found[at] = p.argmax(axis=1)
                ranked = np.sort(p, axis=1)
                score[at], second[at] = ranked[:, -1], ranked[:, -2] if len(langs) > 1 else 0
            found[~lettered], score[~lettered], second[~lettered] = len(langs), 0, 0
            yield pd.DataFrame({"lang_pred": names[found], "score": score, "ambiguous": score - second < margin})

    return docs.withColumn(name, decode("text"))


def predictions(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row of ``docs`` (doc_id, text, lang)."""
    name = free_name(docs, "language")
    return identify(docs, fit(docs, learn, per_language), name).select("doc_id", f"{name}.*")
