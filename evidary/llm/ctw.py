"""Context-tree weighting over bytes, for code lengths of texts.

A text is its bytes and one end byte (0xFF, which UTF-8 never has), and what stands before it is end bytes.  A byte
is eight binary decisions from its highest bit down; each decision (a node of the byte's binary tree) has its own
context tree, whose contexts are the last 0, 1, ... ``DEPTH`` bytes.  A context's counts give the
Krichevsky-Trofimov estimate Pe, and the weighted probability mixes all depths:
``Pw = Pe / 2 + (product of the Pw of the contexts one byte longer) / 2``, with ``Pw = Pe`` where the tree ends.
Scoring uses the trees as training left them: on the way down the contexts of a place, the estimate of each depth
counts with the share of Pw that its Pe has among the mixture.

Every context of the training texts is kept.  The grams (a context of ``DEPTH`` bytes and the byte after it) of all
texts are a table with their training counts, 0 for those of held-out texts only.  Where a context never saw a
decision its estimate and all below it are one half, so what a place needs is in the rows of its own gram's contexts.
Tasks that hold whole groups of grams with the same last ``SPLIT`` bytes weigh the contexts longer than that; the shorter
ones are one aggregate for each depth on the way up and one join on the parent context on the way down.  Grams that
hold at least ``2^-FREQUENT`` of all places (at most ``2^FREQUENT`` of them, 12 bytes each) are looked up in a broadcast table
first, and the join has the rarer ones.

The unigram baseline beside it needs the count of every training word.  Counts are joined to the documents' words
by the words' 64-bit hashes; words that hold at least ``2^-COMMON`` of all tokens, at most 2^COMMON of them, are
looked up in a broadcast table first, so that the join only has the rarer ones.

Null texts are empty ones: they have the end token and the end byte.  Without a training document every count is 0 and
every decision costs one bit.  Rows with a null id are scored, not learned from; rows may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from evidary.llm.common import durable, hashed_words, segments, stored

DEPTH, COMMON = 5, 16
#: Bytes of context that the grams of a task share; grams of 2^-FREQUENT of all places are broadcast.
SPLIT, FREQUENT = 3, 23
#: Grams that a task weighs at once, about.
GRAMS = 1 << 18
EDGE = 0xFF
#: Bytes whose contexts a task counts or scores at once, rows it takes from a batch at once, and keys it holds before it hands them on.
BLOCK, ROWS, HELD = 1 << 19, 512, 1 << 19
#: The end token's key; no word hashes to it by the rule that words have letters.
END_TOKEN = 0


def _lower_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys (signed) of the words of bytes with A-Z lower-cased."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, _, keys = hashed_words(low)
    return starts, keys.view(np.int64)


def _framed(texts, at_once: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts with ``DEPTH`` edge bytes before and one behind each: (first row, rows, data, row of each byte, whether it is coded).

    A long text's pieces begin with the bytes before them, which are not coded again.
    """
    frame = bytes([EDGE]) * DEPTH
    framed = (frame + (t or b"") + frame[:1] for t in texts)
    for first, rows, pieces in segments(framed, DEPTH, at_once, 1 << 14):
        data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
        lengths = np.fromiter((len(p) for _, p in pieces), np.int64, len(pieces))
        coded = np.ones(len(data), bool)
        heads = np.cumsum(lengths) - lengths
        for k in range(DEPTH):
            coded[heads + k] = False
        yield first, rows, data, np.repeat(np.fromiter((r for r, _ in pieces), np.int64, len(pieces)), lengths), coded


def _grams(data: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """For each coded byte, its context and itself in one number, the byte lowest."""
    at = np.flatnonzero(coded)
    gram = np.zeros(len(at), np.uint64)
    for k in range(DEPTH, -1, -1):
        gram = (gram << np.uint64(8)) | data[at - k]
    return gram


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): how often a task saw each context and byte (kind 0) and each word (kind 1) of the texts to
    learn from, and each context and byte of the others (kind 2)."""
    held: dict[int, list] = {0: [], 1: [], 2: []}

    def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held[kind]])
        n = np.concatenate([c for _, c in held[kind]])
        by = np.argsort(keys, kind="stable")
        keys, n = keys[by], n[by]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ 1))
        return keys[first], np.add.reduceat(n, first)

    def flush() -> Iterator[pa.RecordBatch]:
        for kind in held:
            if held[kind]:
                keys, n = merged(kind)
                for at in range(0, len(keys), 1 << 18):
                    some = keys[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(n[at : at + (1 << 18)])], names=["kind", "key", "n"])
                held[kind] = []

    size = 0
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            learned = np.asarray(batch.column(1))
            texts = batch.filter(batch.column(1)).column(0).to_pylist()
            for kind, some in ((0, texts), (2, batch.filter(pa.array(~learned)).column(0).to_pylist())):
                for _, _, data, _, coded in _framed(some):
                    keys, n = np.unique(_grams(data, coded).view(np.int64), return_counts=True)
                    held[kind].append((keys, n))
                    size += len(keys)
            for _, _, pieces in segments(texts, limit=BLOCK, words=True):
                _, words = _lower_words(np.frombuffer(b"\n".join(p for _, p in pieces), np.uint8))
                keys, n = np.unique(words, return_counts=True)
                held[1].append((keys, n))
                size += len(keys)
            held[1].append((np.array([END_TOKEN], np.int64), np.array([len(texts)], np.int64)))
            if size > HELD:
                held = {kind: [merged(kind)] if some else [] for kind, some in held.items()}
                size = sum(len(k) for some in held.values() for k, _ in some)
                if size > HELD // 2:
                    yield from flush()
                    size = 0
    yield from flush()


def corpus_counts(texts: DataFrame, learned: Column | None = None) -> DataFrame:
    """(kind, key, n) over all texts (a binary column ``text``): contexts with their byte, and words; ``learned``: which are learned from."""
    texts = texts.select("text", (F.lit(True) if learned is None else learned).alias("learned"))
    return texts.mapInArrow(_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    low = x < 10
    y = np.where(low, x, 1.0)
    rise = y.copy()
    for k in range(1, 10):  # G(x) = G(x + 10) / (x (x + 1) ... (x + 9))
        rise *= y + k
    z = np.where(low, x + 10, x)
    s = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / z - np.where(low, np.log(rise), 0)


def _mask(depth: int) -> int:
    return (1 << 8 * depth) - 1


def _level(key: np.ndarray, n: np.ndarray, level: int) -> tuple[list, list]:
    """The contexts of some sorted grams' decisions at one level of the byte, whole groups of ``SPLIT`` bytes at once.

    From ``DEPTH`` bytes of context down to ``SPLIT``: (id, zeros, ones, log Pe, log Pw) with id = context, then the decision's
    higher bits; and for each of them, where the row (first a gram, then a context one byte longer) stands among them.
    """
    high = (1 << level) - 1
    ids = (key >> 8 << level) | ((key & 255) >> (8 - level))
    one = (key >> (7 - level) & 1) == 1
    sums = [n * ~one, n * one, np.zeros(len(key))]
    found, places = [], []
    for d in range(DEPTH, SPLIT - 1, -1):
        if d == DEPTH:  # the rows of a longest context stand together
            first = np.ones(len(ids), bool)
            first[1:] = ids[1:] != ids[:-1]
            ids, place = ids[first], np.cumsum(first) - 1
        else:
            ids, place = np.unique((ids >> level & _mask(d)) << level | (ids & high), return_inverse=True)
        zeros, ones, below = (np.bincount(place, weights=x, minlength=len(ids)) for x in sums)
        own = _log_kt(zeros, ones)
        mixed = own if d == DEPTH else np.logaddexp(own, below) - np.log(2)
        found.append((ids, zeros, ones, own, mixed))
        places.append(place)
        sums = [zeros, ones, mixed]
    return found, places


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ``GRAMS`` rows that hold whole groups (column ``near``)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= GRAMS:
            near = np.asarray(batch.column("near"))
            cut = int(np.searchsorted(near, near[-1])) if len(near) else 0
            if cut or held[0].column("near")[0] != held[-1].column("near")[0]:
                # the last group goes on
                whole = pa.Table.from_batches(held)
                cut = int(np.searchsorted(np.asarray(whole.column("near")), near[-1]))
                yield whole.slice(0, cut)
                held = whole.slice(cut).to_batches()
                size = whole.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


NODES = "context long, node int, zeros double, ones double, own double, mixed double"


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The decisions of the contexts of ``SPLIT`` bytes."""
    for rows in _grouped(batches):
        key, n = np.asarray(rows["key"]), np.asarray(rows["n"], np.float64)
        by = np.argsort(key)
        key, n = key[by], n[by]
        for level in range(8):
            ids, zeros, ones, own, mixed = _level(key, n, level)[0][-1]
            node = ((1 << level) | (ids & ((1 << level) - 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids >> level, node, zeros, ones, own, mixed)], names=[c.split()[0] for c in NODES.split(", ")])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10 of each gram's probability (key, seen, code).  Rows without a count are the paths of the contexts of
    ``SPLIT`` bytes (``key`` is the decision): what the mixture says of a one so far, and the share that is left."""
    for rows in _grouped(batches):
        gram = np.asarray(rows["n"].is_valid())
        key, n, seen = (np.asarray(rows[c].filter(pa.array(gram))) for c in ("key", "n", "seen"))
        by = np.argsort(key)
        key, n, seen = key[by], n[by], seen[by]
        path = [np.asarray(rows[c].filter(pa.array(~gram))) for c in ("near", "key", "said", "rest")]
        code = np.zeros(len(key))
        for level in range(8):
            found, places = _level(key, n.astype(np.float64), level)
            mine = (path[1] >> level) == 1
            ids = path[0][mine] << level | (path[1][mine] & ((1 << level) - 1))
            at = np.argsort(ids)[np.searchsorted(np.sort(ids), found[-1][0])]
            said, left = path[2][mine][at], path[3][mine][at]
            for d in range(DEPTH - 1 - SPLIT, -1, -1):
                _, zeros, ones, own, mixed = found[d]
                said, left = said[places[d + 1]], left[places[d + 1]]
                stop = 1.0 if d == 0 else np.exp(own - np.log(2) - mixed)
                said = said + left * stop * (ones + 0.5) / (zeros + ones + 1)
                left = left * (1 - stop)
            p = np.clip(said[places[0]], 1e-12, 1 - 1e-12)
            code += np.log10(np.where(key >> (7 - level) & 1 == 1, p, 1 - p))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seen), pa.array(code)], names=["key", "seen", "code"])


@pandas_udf(DoubleType())
def _pe(zeros: pd.Series, ones: pd.Series) -> pd.Series:
    return pd.Series(_log_kt(zeros.to_numpy(), ones.to_numpy()))


def _parent(depth: int) -> Column:
    return F.col("context").bitwiseAND(F.lit(_mask(depth)))


def byte_codes(grams: DataFrame) -> DataFrame:
    """(key, seen, code): log10 of the probability of each of ``grams`` (key, n, seen), by the contexts of all counts n."""
    grams = grams.select(F.shiftright("key", 8).bitwiseAND(F.lit(_mask(SPLIT))).alias("near"), "key", "n", "seen")
    nodes = [stored(grams.repartition("near").sortWithinPartitions("near").mapInArrow(_up, NODES), "contexts")]
    for d in range(SPLIT - 1, -1, -1):
        sums = nodes[0].groupBy(_parent(d).alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("mixed").alias("below"))
        both = sums.withColumn("own", _pe("zeros", "ones"))
        mixed = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - F.log(F.lit(2.0))
        nodes.insert(0, durable(both.select("context", "node", "zeros", "ones", "own", mixed.alias("mixed"))))
    stop = F.exp(F.col("own") - F.log(F.lit(2.0)) - F.col("mixed"))
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    path = nodes[0].select("context", "node", (stop * one).alias("said"), (1 - stop).alias("rest"))
    for d in range(1, SPLIT + 1):
        above = path.select(F.col("context").alias("parent"), "node", F.col("said").alias("said_above"), F.col("rest").alias("rest_above"))
        path = nodes[d].withColumn("parent", _parent(d - 1)).join(above, ["parent", "node"]).select(
            "context", "node", (F.col("said_above") + F.col("rest_above") * stop * one).alias("said"), (F.col("rest_above") * (1 - stop)).alias("rest")
        )
    no = F.lit(None)
    rows = grams.withColumns({"said": no.cast("double"), "rest": no.cast("double")}).unionByName(
        path.select(F.col("context").alias("near"), F.col("node").cast("long").alias("key"), no.cast("long").alias("n"), no.cast("long").alias("seen"), "said", "rest")
    )
    return stored(rows.repartition("near").sortWithinPartitions("near").mapInArrow(_down, "key long, seen long, code double"), "byte-codes")


SCORED = "doc_id long, held_out boolean, n_tokens long, score double, common_log double, common_known long, kinds array<int>, keys array<long>, times array<int>"


def _score(model: tuple):
    """Scores of (doc_id, held_out, text) rows, and what the unigram baseline still needs of each."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, codes, common, logs, ends = model.value
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = batch.column("text").to_pylist()
            n = len(texts)
            total = np.zeros(n)
            kind_parts, key_parts, time_parts, row_parts = [], [], [], []

            def ask(kind: int, row: np.ndarray, keys: np.ndarray) -> None:
                """What the broadcast tables do not have."""
                by = np.lexsort((keys, row))
                row, keys = row[by], keys[by]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
                heads = np.flatnonzero(new)
                kind_parts.append(np.full(len(heads), kind, np.int32))
                row_parts.append(row[heads])
                key_parts.append(keys[heads])
                time_parts.append(np.diff(heads, append=len(row)).astype(np.int32))

            for first, rows, data, row, coded in _framed(texts):
                keys, place = np.unique(_grams(data, coded).view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(grams, keys), max(len(grams) - 1, 0))
                hit = grams[at] == keys if len(grams) else np.zeros(len(keys), bool)
                value = np.where(hit, codes[at], 0.0) if len(grams) else np.zeros(len(keys))
                row = row[coded]
                total[first : first + rows] += np.bincount(row, weights=value[place], minlength=rows)
                miss = ~hit[place]
                ask(0, first + row[miss], keys[place[miss]])
            tokens, known, base = np.ones(n, np.int64), np.full(n, int(ends > 0)), np.full(n, np.log10(ends + 1.0))
            for first, rows, pieces in segments(texts, 0, BLOCK, 1 << 14, words=True):
                data = np.frombuffer(b"\n".join(p for _, p in pieces), np.uint8)
                edge = np.cumsum(np.fromiter((len(p) + 1 for _, p in pieces), np.int64, len(pieces)))
                starts, words = _lower_words(data)
                row = first + np.fromiter((r for r, _ in pieces), np.int64, len(pieces))[np.searchsorted(edge, starts, side="right")]
                tokens += np.bincount(row, minlength=n)
                at = np.minimum(np.searchsorted(common, words), max(len(common) - 1, 0))
                hit = common[at] == words if len(common) else np.zeros(len(words), bool)
                known += np.bincount(row[hit], minlength=n)
                base += np.bincount(row[hit], weights=logs[at[hit]], minlength=n) if hit.any() else 0
                ask(1, row[~hit], words[~hit])
            row = np.concatenate(row_parts) if row_parts else np.zeros(0, np.int64)
            by = np.argsort(row, kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
            kinds, keys, times = (
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x)[by] if x else np.zeros(0, kind)))
                for x, kind in ((kind_parts, np.int32), (key_parts, np.int64), (time_parts, np.int32))
            )
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens), pa.array(total), pa.array(base), pa.array(known), kinds, keys, times]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    return score


def language_model(texts: DataFrame) -> tuple[tuple, DataFrame, int, int]:
    """From texts (text, learned): the broadcast tables, (kind, key, value) of the rarer grams (kind 0: log10 of the
    probability) and words (kind 1: log10 of the count and one), and the numbers of tokens and of distinct ones."""
    counts = stored(corpus_counts(texts, F.col("learned")), "corpus-counts")
    words = counts.where("kind = 1 AND n > 0")
    grams = counts.where("kind <> 1").groupBy("key").agg(F.sum(F.expr("IF(kind = 0, n, 0L)")).alias("n"), F.sum("n").alias("seen"))
    codes = byte_codes(grams)
    places = int(codes.agg(F.sum("seen").alias("n")).first()["n"] or 0)
    frequent = F.col("seen") * (1 << FREQUENT) >= F.lit(places)
    first = codes.where(frequent).select("key", F.col("code").cast("float").alias("code")).toArrow()  # at most 2^FREQUENT
    by = np.argsort(first["key"].to_numpy())
    top_grams, top_codes = (first[c].to_numpy()[by] for c in ("key", "code"))
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.expr(f"IF(key = {END_TOKEN}, n, 0)")).alias("ends")).first()
    tokens, distinct, ends = int(sums["n"] or 0), int(sums["v"] or 0), int(sums["ends"] or 0)
    often = (F.col("n") * (1 << COMMON) >= F.lit(tokens)) | (F.col("key") == END_TOKEN)
    top = sorted((r["key"], r["n"]) for r in words.where(often).where(F.col("key") != END_TOKEN).collect())  # at most 2^COMMON
    common = np.array([k for k, _ in top], np.int64)
    logs = np.log10(np.array([n for _, n in top], np.float64) + 1)
    rare = codes.where(~frequent).select(F.lit(0).alias("kind"), "key", F.col("code").alias("value")).unionByName(
        words.where(~often).select(F.lit(1).alias("kind"), "key", F.log10(F.col("n") + F.lit(1.0)).alias("value"))
    )
    return (top_grams, top_codes, common, logs, ends), rare, tokens, distinct


def score_all(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    The model learns from the rows with an id that are not held out.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    learned = ~F.col("held_out") & F.col("doc_id").isNotNull()
    tables, rare, tokens, distinct = language_model(rows.select("text", learned.alias("learned")))
    shared = spark.sparkContext.broadcast(tables)
    scored = rows.mapInArrow(_score(shared), SCORED).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "scored-texts")
    asked = scored.select("row", F.explode(F.arrays_zip("kinds", "keys", "times")).alias("w")).select("row", F.col("w.kinds").alias("kind"), F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    value, word = F.col("times") * F.col("value"), F.col("kind") == 1
    found = asked.join(rare, ["kind", "key"]).groupBy("row").agg(
        F.sum(F.when(word, value)).alias("rare_log"), F.sum(F.when(word, F.col("times"))).alias("rare_known"), F.sum(F.when(~word, value)).alias("rare_code")
    )
    joined = scored.drop("kinds", "keys", "times").join(found, "row", "left")
    norm = float(np.log10(tokens + distinct + 1))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("common_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_code", F.lit(0.0))).alias("score"),
    )
