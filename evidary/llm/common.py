"""What the operators share: tables, stored intermediates, bounded label samples, byte arrays of texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidary.session import durable, stored

__all__ = ["bounded_texts", "durable", "free_name", "held_out", "read", "segments", "stored"]

#: Bytes of text that a task turns into arrays at once.
CHUNK = 1 << 20
_WHITE = re.compile(rb"[\t-\r ]")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document is kept from learning; a null id is learned from by nobody and is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def bounded_texts(docs: DataFrame, wanted: DataFrame, label: str, per_label: int) -> DataFrame:
    """Texts of at most about ``per_label`` documents of each label: (doc_id, label, text).

    ``wanted`` has (doc_id, label).  Documents are taken by a hash of their id below a share that follows from
    the label's row count, four standard deviations short of ``per_label``: the sample is the same at every run, no
    label's rows meet in one task, and what is broadcast to find the texts is a few bytes for each
    document taken.  A document named twice counts once, with the label that it has more often among those
    taken (ties: the larger), and with its smallest text.
    """
    rows = wanted.select("doc_id", F.col(label).alias("_label")).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    sizes = rows.groupBy("_label").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return docs.select("doc_id", F.lit(None).cast(wanted.schema[label].dataType).alias(label), "text").limit(0)
    few = max(1.0, per_label - 4 * per_label**0.5)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["_label"]), F.lit(few / r["n"]))])
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) / (1 << 40)
    votes = rows.where(place < share[F.col("_label")]).groupBy("doc_id", "_label").agg(F.count("*").alias("_n"))
    picked = votes.groupBy("doc_id").agg(F.max(F.struct("_n", "_label"))["_label"].alias("_label"))
    picked = durable(picked.withColumnRenamed("doc_id", "_id"))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    return texts.groupBy("doc_id", "_label").agg(F.min("text").alias("text")).withColumnRenamed("_label", label)


def segments(texts: Iterable[bytes | None], overlap: int = 0, limit: int = CHUNK, rows: int = 256, words: bool = False) -> Iterator[tuple[int, int, list[tuple[int, bytes]]]]:
    """Runs of texts of about ``limit`` bytes: (first row, rows, [(row within the run, bytes)]).

    A text longer than a quarter of ``limit`` comes as several pieces, each of which repeats the last
    ``overlap`` bytes of the one before, so a task holds a bounded array whatever a text's length.
    Every row is in exactly one run, except that a very long text may fill several runs
    with the same first row; callers add up what the runs of a row give.  With ``words`` a piece goes on to the
    next white space, so no word is cut.
    """
    step = max(1, limit // 4)
    first, held, size, row = 0, [], 0, -1
    for row, text in enumerate(texts):
        text = text or b""
        if row - first >= rows or (held and size + min(len(text), step) > limit):
            yield first, row - first, held
            first, held, size = row, [], 0
        at = 0
        while True:
            end = at + step
            if words and end < len(text):
                space = _WHITE.search(text, end)
                end = space.start() if space else len(text)
            piece = text[max(0, at - overlap) : end]
            if held and size + len(piece) > limit:
                yield first, row - first + 1, held
                first, held, size = row, [], 0
            held.append((row - first, piece))
            size += len(piece)
            at = end
            if at >= len(text):
                break
    if row >= first and row >= 0:
        yield first, row - first + 1, held


def joined(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces in one array, each byte's piece, and each piece's row."""
    data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    lengths = np.fromiter((len(p) for _, p in pieces), np.int64, len(pieces))
    return data, np.repeat(np.arange(len(pieces)), lengths), np.fromiter((r for r, _ in pieces), np.int64, len(pieces))


def counted(texts: Iterable[bytes | None], keys, dims: int, overlap: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Counts of keys by row: (first row, float array of rows x ``dims``), each row once.

    ``keys(data, piece, old)`` yields (positions, keys below ``dims``) for the bytes of a run; positions
    say which row a key belongs to.  A text's further pieces begin with the ``overlap`` bytes before them, which ``old`` marks.
    """
    at, held, going = 0, None, -1
    for first, rows, pieces in segments(texts, overlap):
        data, piece, row_of = joined(pieces)
        old = repeated(pieces, first, going, overlap)
        going = first + pieces[-1][0]
        counts = np.zeros(rows * dims)
        for where, key in keys(data, piece, old):
            counts += np.bincount(row_of[piece[where]] * dims + key, minlength=rows * dims)
        counts = counts.reshape(rows, dims)
        if held is not None:
            if first == at + len(held) - 1:  # the last row goes on
                counts[0] += held[-1]
                held = held[:-1]
            if len(held):
                yield at, held
        at, held = first, counts
    if held is not None:
        yield at, held


def repeated(pieces: list[tuple[int, bytes]], first: int, going: int, overlap: int) -> np.ndarray:
    """Which bytes of a run's pieces repeat those of the piece before; ``going`` is the row of the piece before the run."""
    old = np.zeros(sum(len(p) for _, p in pieces), bool)
    head = 0
    for row, piece in pieces:
        if first + row == going:
            old[head : head + overlap] = True
        going = first + row
        head += len(piece)
    return old


def word_pieces(raw: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The ASCII-white-space words of a text in order, in lists of about ``limit`` bytes of text."""
    at = 0
    while at < len(raw):
        end = at + limit
        if end < len(raw):
            cut = raw.find(b" ", end)
            end = len(raw) if cut < 0 else cut
        yield raw[at:end].split()
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LANES = np.random.default_rng(64).integers(0, 1 << 64, 64 * 256, dtype=np.uint64)


def hashed_words(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 64-bit hash of each word of a byte array.

    A word is a run of bytes other than ASCII white space; ``breaks`` marks bytes where a new one begins besides.
    The hash adds up random numbers for each (place in the word, byte); the places go round after 64 with another
    odd factor.  Among V words two are taken for one with a chance of about V^2 / 2^65.
    """
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] if breaks is None else ~inside[:-1] | breaks[1:]
    starts, at = np.flatnonzero(begin), np.flatnonzero(inside)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    firsts = np.cumsum(inside)[starts] - 1
    lengths = np.diff(firsts, append=len(at))
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    lane = _LANES[(place & 63) * 256 + data[at]]
    if lengths.max() > 64:
        lane = lane * (2 * (place >> 6) + 1).astype(np.uint64)
    return starts, lengths, np.add.reduceat(lane, firsts)


class Places:
    """Numbers 0, 1, 2, ... for 64-bit keys in the order they come: a hash table of arrays that grows."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.count = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        slot = self._slots(keys)
        value = self.values[slot]
        open_ = np.flatnonzero((value >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            value[open_] = self.values[slot[open_]]
            open_ = open_[(value[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return value

    def add(self, keys: np.ndarray) -> None:
        """Number distinct keys that are not there yet."""
        if 2 * (self.count + len(keys)) > 1 << self.bits:
            used = self.values >= 0
            old = np.empty(self.count, np.uint64)
            old[self.values[used]] = self.keys[used]
            while 2 * (self.count + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
            self._put(old, np.arange(self.count))
        self._put(keys, np.arange(self.count, self.count + len(keys)))
        self.count += len(keys)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.values[slot[left]] < 0]
            self.values[slot[free]] = values[free]  # of several keys for a slot the last one wins
            self.keys[slot[free]] = keys[free]
            left = left[self.values[slot[left]] != values[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
