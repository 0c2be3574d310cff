"""Packing along a space-filling curve.

A document's token counts are its hashed vector (a token id is its place); a fixed random projection
takes the relative counts to three dimensions, squashed to whole coordinates, and the Hilbert
key of these puts similar documents next to each other.  Documents are range-partitioned and
sorted by that key (ties: by a row number, so that any number of copies spread over partitions), and each
partition's ids are cut every ``LENGTH`` tokens.  Only a partition's rest is shorter; it is cut into
sequences whose lengths are powers of two, which need no padding.

A null text is an empty one; every document has at least the end id.  Rows may repeat; each is packed.
The ids of a document are held whole by one task, as its text is.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from evidary.llm.common import Places, hashed_words, stored

LENGTH = 2048
END = 1
DIMS, BITS, SPREAD = 3, 20, 6.0
#: A worker starts anew with the parts it remembers when they are more than this.
REMEMBERED = 400_000
#: What a byte is: 1 an ASCII letter, 2 a digit, 3 an ASCII symbol other than the apostrophe, 0 anything else.
_KIND = np.array([0 if c < 33 or c > 126 or c == 39 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.int8)

ENCODED = StructType([StructField("ids", BinaryType()), StructField("key", LongType())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts, part by part.

    Before it merges anything, the tokenizer drops white space and splits runs of letters, single digits and runs of
    symbols.  So texts are cut at blanks, between ASCII letters, digits and symbols, and between digits
    (an apostrophe may begin an ending, and bytes beyond ASCII may combine: no cut beside these); the
    ids of a text are those of its parts in order, and a part is encoded once and found again by its hash.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = max(self.tokenizer.get_vocab_size(), END + 1)
        last = np.zeros(self.size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            last[number] = token.endswith("</w>")
        self.last = last  # ids that end a run of letters
        self.forget()

    def forget(self) -> None:
        self.places = Places()
        self.flat = np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts and how many each has; letter runs are encoded in lists and told apart by their last ids."""
        lists = [" ".join(parts[k : k + 100]) for k in range(0, len(parts), 100)]
        got = [np.asarray(e.ids, self.flat.dtype) for e in self.tokenizer.encode_batch_fast(lists, add_special_tokens=False)]
        ids = np.concatenate(got)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            got = [np.asarray(e.ids, self.flat.dtype) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            return np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
        return ids, np.diff(ends, prepend=0)

    def learn(self, keys: np.ndarray, parts: list[str]) -> None:
        plain = np.fromiter((p.isalpha() for p in parts), bool, len(parts))
        rest = [p for p, letters in zip(parts, plain) if not letters]
        ids, lengths = [], []
        for some, whole in (([p for p, letters in zip(parts, plain) if letters], True), (rest, False)):
            if some and whole:
                got, n = self._ids(some)
            elif some:
                each = [np.asarray(e.ids, self.flat.dtype) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                got, n = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
            else:
                continue
            ids.append(got)
            lengths.append(n)
        n = np.concatenate(lengths)
        self.places.add(np.concatenate([keys[plain], keys[~plain]]))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n.astype(np.int32)])
        self.flat = np.concatenate([self.flat, *ids])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, the end id after each, and the number of ids of each text."""
        raw = b"\n".join(texts).lower()
        data = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        kind = _KIND[data]
        breaks = np.zeros(len(data), bool)
        breaks[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        starts, spans, keys = hashed_words(data, breaks)
        if self.places.count > REMEMBERED:
            self.forget()
        at = self.places.find(keys)
        if len(missing := np.flatnonzero(at < 0)):
            new, first = np.unique(keys[missing], return_index=True)
            where = missing[first]
            self.learn(new, [raw[s : s + n].decode() for s, n in zip(starts[where].tolist(), spans[where].tolist())])
            at[missing] = self.places.find(keys[missing])
        lengths = self.length[at]
        owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
        counts = np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64) if len(at) else np.zeros(len(texts), np.int64)
        # the ids of a word go behind all earlier ids and one end id for each earlier text
        before = np.cumsum(lengths) - lengths
        inner = np.arange(int(lengths.sum()))
        out = np.full(int(counts.sum()) + len(texts), END, self.flat.dtype)
        out[inner + np.repeat(owner, lengths)] = self.flat[inner + np.repeat(self.start[at] - before, lengths)]
        return out, counts + 1


def hilbert(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve for rows of whole coordinates below 2^bits."""
    x = [coordinates[:, k].astype(np.int64) for k in range(coordinates.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for k in range(len(x)):
            on = (x[k] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> level & 1)
    return key


_encoders: dict[str, Encoder] = {}


def encoded(path: str):
    """A function of text columns: ids (little-endian, two bytes each if they fit, else four) and Hilbert key."""

    @pandas_udf(ENCODED)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _encoders.get(path)
        if coder is None:
            coder = _encoders[path] = Encoder(path)
        directions = np.random.default_rng(8).standard_normal((coder.size, DIMS)).astype(np.float32)
        kind = "<u2" if coder.size <= 1 << 16 else "<u4"
        for texts in batches:
            rows, keys, at = [], [], 0
            values = [t or b"" for t in texts]
            while at < len(values):
                to, held = at, 0
                while to < len(values) and (to == at or held + len(values[to]) <= 1 << 20):
                    held += len(values[to])
                    to += 1
                ids, counts = coder.encode(values[at:to])
                ends = np.cumsum(counts)
                means = np.add.reduceat(directions[ids], ends - counts, axis=0, dtype=np.float64) / counts[:, None]
                grid = np.minimum((np.tanh(means * SPREAD) * 0.5 + 0.5) * (1 << BITS), (1 << BITS) - 1)
                keys.append(hilbert(grid.astype(np.int64), BITS))
                raw = ids.astype(kind, copy=False).tobytes()
                width = int(kind[-1])
                rows += [raw[(e - c) * width : e * width] for e, c in zip(ends.tolist(), counts.tolist())]
                at = to
            yield pd.DataFrame({"ids": pd.Series(rows, dtype=object), "key": np.concatenate(keys) if keys else np.zeros(0, np.int64)})

    return encode


def _rest(total: int) -> list[int]:
    """Powers of two that add up to ``total``, largest first."""
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def _cut(batches: Iterator[pd.DataFrame], length: int, width: int) -> Iterator[pd.DataFrame]:
    """Pieces of the sequences that the rows fill in order."""
    base = TaskContext.get().partitionId() << 32
    made, out = 0, []
    filling: list[tuple] = []  # (doc_id, start, raw ids, tokens of the document)
    filled = 0

    def emit(pieces: list[tuple]) -> None:
        nonlocal made
        at = 0
        for doc, start, raw, total in pieces:
            n = len(raw) // width
            crc = zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
            out.append((doc, start, n, crc, total, base + made, at))
            at += n
        made += 1

    def frame() -> pd.DataFrame:
        cols = list(zip(*out)) or [()] * 7
        names = [c.split()[0] for c in PIECES.split(", ")]
        got = pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in zip(names, cols)})
        out.clear()
        return got

    for batch in batches:
        for doc, raw in zip(batch["doc_id"], batch["ids"]):
            total, at = len(raw) // width, 0
            doc = None if pd.isna(doc) else int(doc)
            while at < total:
                n = min(total - at, length - filled)
                filling.append((doc, at, raw[at * width : (at + n) * width], total))
                at, filled = at + n, filled + n
                if filled == length:
                    emit(filling)
                    filling, filled = [], 0
        yield frame()
    for size in _rest(filled):
        some, held = [], 0
        while held < size:
            doc, start, raw, total = filling.pop(0)
            n = min(len(raw) // width, size - held)
            some.append((doc, start, raw[: n * width], total))
            if n * width < len(raw):
                filling.insert(0, (doc, start + n, raw[n * width :], total))
            held += n
        emit(some)
    yield frame()


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) in sequences of at most ``length`` tokens.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor has.
    """
    if length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    spread = docs.select("doc_id", encoded(tokenizer)(F.col("text").cast("binary")).alias("e")).select("doc_id", "e.ids", "e.key")
    held = stored(spread.withColumn("row", F.monotonically_increasing_id()), "tokens")
    ordered = held.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("doc_id", "ids")
    return ordered.mapInPandas(lambda batches: _cut(batches, length, width), PIECES)
