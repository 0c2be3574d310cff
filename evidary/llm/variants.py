"""Spelling variants: words that differ by one edit, found by bidirectional FM-index search schemes.

The vocabulary is cut into blocks that are consecutive in the order of the words, and once more in the order of the
reversed words.  Each block is written out with a delimiter around each word and gets an index of its suffixes
and one of the suffixes of its reversal, whose intervals are kept in step while a pattern grows at either end.

A word is looked for by two searches.  Either matches one half exactly, from the middle to the delimiter at its end, then
turns round and extends across the other half and the delimiter behind it, allowing one inserted, deleted or
replaced letter.  An edit lies in one half or between the two, so one of the searches keeps its half whole and finds the
pair.  The first search runs in the blocks of the words, the second in those of the reversed words,
where it is the same search: words that begin with the same half lie in neighbouring blocks, so a
word visits the one or few blocks whose range its half touches, not the whole vocabulary.

Bounds: a block holds ``BLOCK`` code points of words (or one longer word), a task one block and the queries of ``WINDOW`` blocks.  What
Python counts in a task is flushed at ``HELD`` words.  Nothing is dropped or capped: a popular half fills more blocks, each of which is searched.

Texts: A-Z are lower-cased; words are maximal runs of letters A to z and U+00C0 to U+00FF.  Null texts have no words, a null id is the
empty string in the checksum, repeated rows count again, and an empty table has no words.  Columns other than those named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidary.llm.common import durable, stored
from evidary.operators.common import running_sums

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Code points of words in a block; blocks whose words search another block together.
BLOCK, WINDOW = 1 << 17, 4
#: Different words that a task counts before it hands them on; code points of text cut into words at once.
HELD, PIECE = 1 << 18, 1 << 20
#: Patterns that are extended side by side.
ABREAST = 4096
_RUN = "[a-zÀ-ÿ]"


def struck(doc_id: str, word: str) -> str:
    """``word`` without one letter where 199 divides the checksum of document and word: the damage of the contract."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{doc_id}:".encode()))
    at = h % len(word)
    return word if h % 199 else word[:at] + word[at + 1 :]


def _pieces(text: str, other: re.Pattern) -> Iterator[str]:
    """A text cut where no word is."""
    at = 0
    while at < len(text):
        gap = other.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def word_counts(docs: DataFrame, change: Callable[[str, str], str] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with at least ``least_length`` letters and ``least_count`` occurrences.

    ``change`` takes a document's id and a word and gives what counts instead; it must not lengthen words.
    """
    run, other = re.compile(f"{_RUN}{{{least_length},}}"), re.compile(f"[^{_RUN[1:]}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                low = (text.as_py() or b"").lower().decode("utf-8", "replace")
                own: Counter[str] = Counter()
                for piece in _pieces(low, other):
                    own.update(run.findall(piece))
                for word, n in own.items():
                    got = change(doc_id or "", word) if change else word
                    if len(got) >= least_length:
                        held[got] += n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held.keys()), "n": list(held.values())})
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- the index of a block -----------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``text`` in order, by doubling the compared length."""
    n, width = len(text), 1
    rank = text.astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (max(n, int(rank.max()) + 1) + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        width *= 2
        if rank[order[-1]] == n - 1 or width >= 2 * n:
            return order


def _ranks(text: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and how often each symbol occurs in the first k letters before the sorted suffixes."""
    order = suffix_array(text)
    before = text[order - 1]  # the letter before the first is the end mark
    table = np.zeros((len(text) + 1, kinds), np.int32)
    table[np.arange(1, len(text) + 1), before] = 1
    return order, np.cumsum(table, axis=0, out=table)


class Index:
    """A bidirectional FM-index of words, each with a delimiter before and after it."""

    END, DELIMITER, LETTER = 0, 1, 2

    def __init__(self, words: list[str]) -> None:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.symbols, codes = np.unique(letters, return_inverse=True)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # of the delimiters
        text = np.full(int(starts[-1]) + 2, self.DELIMITER, np.int64)
        inside = np.ones(len(text), bool)
        inside[starts], inside[-1] = False, False
        text[inside] = codes + self.LETTER
        text[-1] = self.END
        kinds = len(self.symbols) + self.LETTER
        _, self.left = _ranks(text, kinds)
        order, self.right = _ranks(np.concatenate((text[-2::-1], [self.END])), kinds)
        # a suffix of the reversal that begins with a word's last delimiter: which word it is
        place = len(text) - 2 - order
        self.word_at = np.searchsorted(starts, place) - 1
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=kinds))))[:-1]

    def coded(self, patterns: list[str]) -> np.ndarray:
        """Patterns of one length as rows of symbols; -1 for a letter that the block lacks."""
        raw = np.frombuffer("".join(patterns).encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.symbols, raw), len(self.symbols) - 1)
        return np.where(self.symbols[at] == raw, at + self.LETTER, -1).reshape(len(patterns), -1)

    def _grow_left(self, lo, lo_r, size, symbol):
        """Intervals of the pattern with ``symbol`` put in front, in both indexes."""
        here = self.left[lo]
        held = self.left[lo + size] - here
        row = np.arange(len(lo))
        known = np.maximum(symbol, 0)
        skipped = np.where(np.arange(held.shape[1]) < known[:, None], held, 0).sum(axis=1)
        return self.less[known] + here[row, known], lo_r + skipped, np.where(symbol < 0, 0, held[row, known])

    def _grow_right(self, lo_r, size, symbol):
        """Intervals in the reversal's index of the pattern with ``symbol`` put behind."""
        known = np.maximum(symbol, 0)
        first = self.right[lo_r, known]
        return self.less[known] + first, np.where(symbol < 0, 0, self.right[lo_r + size, known] - first)

    def one_edit(self, patterns: list[str], exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) numbers of the words that begin with the first ``exact`` letters of a pattern and are one edit away."""
        coded = self.coded(patterns)
        count, length = coded.shape
        last = np.full(count, self.DELIMITER)
        # the exact half, from the middle to the front and the delimiter before it
        who = np.arange(count)
        lo, lo_r, size = np.zeros(count, np.int64), np.zeros(count, np.int64), np.full(count, len(self.left) - 1)
        for i in range(exact - 1, -2, -1):
            lo, lo_r, size = self._grow_left(lo, lo_r, size, coded[who, i] if i >= 0 else last[who])
            who, lo, lo_r, size = (x[size > 0] for x in (who, lo, lo_r, size))
        # then the other way: ``whole`` without an edit yet, ``edited`` with one
        edited = [np.zeros(0, np.int64)] * 3
        for i in range(exact, length + 1):
            symbol = coded[:, i] if i < length else last
            here = self.right[lo_r]
            held = self.right[lo_r + size] - here
            # another letter stands here, in place of the pattern's or before it
            held_other = held.copy()
            held_other[np.arange(len(who)), np.maximum(symbol[who], 0)] = 0
            held_other[:, : self.LETTER] = 0
            row, letter = np.nonzero(held_other)
            other = who[row], self.less[letter] + here[row, letter], held_other[row, letter]
            skipped = who, lo_r, size
            edited = [np.concatenate(pair) for pair in zip(edited, other)]  # inserted before the pattern's letter
            e_lo, e_size = self._grow_right(edited[1], edited[2], symbol[edited[0]])
            edited = [x[e_size > 0] for x in (edited[0], e_lo, e_size)]
            if i < length:
                edited = [np.concatenate(three) for three in zip(edited, other, skipped)]  # replaced, deleted
            lo_r, size = self._grow_right(lo_r, size, symbol[who])
            who, lo_r, size = (x[size > 0] for x in (who, lo_r, size))
            if not len(who) and not len(edited[0]):
                break
        else:
            return edited[0], self.word_at[edited[1]]
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _halves(side: int, length: int) -> int:
    """Letters of a word's key that a search keeps: the first half of the word, or of the reversed word the second."""
    return length // 2 if side == 0 else length - length // 2


def _search(side: int):
    def search(block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        keys, way = block["indexed"].tolist(), slice(None, None, 1 if side == 0 else -1)
        index, n = Index(keys), block["indexed_n"].to_numpy()
        asked = asking["key"].tolist()
        lengths = np.fromiter(map(len, asked), np.int64, len(asked))
        words, near, near_n = [], [], [np.zeros(0, np.int64)]
        for length in np.unique(lengths):
            some = [asked[k] for k in np.flatnonzero(lengths == length)]
            for at in range(0, len(some), ABREAST):
                part = some[at : at + ABREAST]
                who, which = index.one_edit(part, _halves(side, int(length)))
                pairs = np.unique(who * len(keys) + which)
                words += [part[k][way] for k in pairs // len(keys)]
                near += [keys[k][way] for k in pairs % len(keys)]
                near_n.append(n[pairs % len(keys)])
        return pd.DataFrame({"word": pd.Series(words, dtype=object), "near": pd.Series(near, dtype=object), "near_n": np.concatenate(near_n)})

    return search


def _side(words: DataFrame, side: int) -> DataFrame:
    """(word, near, near_n) by the search that keeps the half of ``side`` exact."""
    key = F.col("word") if side == 0 else F.reverse("word")
    keyed = words.select(key.alias("key"), "n")
    lined = running_sums(keyed, ["key"], {"_sum": F.char_length("key").cast("long")})
    blocks = stored(lined.select("key", "n", F.floor((F.col("_sum") - 1) / BLOCK).cast("long").alias("block")), "variants-blocks")
    length = F.char_length("key")

    def half(of):
        return F.floor(of / 2) if side == 0 else of - F.floor(of / 2)

    # The blocks that a half touches, by the words that a pattern with this half may find.
    heads = F.array_distinct(F.transform(F.array(length - 1, length, length + 1), lambda of: F.left("key", half(of).cast("int"))))
    touched = blocks.select(F.explode(heads).alias("head"), "block").groupBy("head").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    asking = blocks.select("key", F.left("key", half(length).cast("int")).alias("head"), F.floor(F.col("block") / WINDOW).alias("window"))
    asking = asking.join(touched, "head").select("key", "window", F.explode(F.sequence("first", "last")).alias("block"))
    asking = durable(asking)
    visits = asking.select(F.col("block").alias("_block"), F.col("window").alias("_window")).distinct()
    searched = visits.join(blocks, F.col("_block") == F.col("block")).select("_block", "_window", F.col("key").alias("indexed"), F.col("n").alias("indexed_n"))
    pairs = searched.groupBy("_block", "_window").cogroup(asking.groupBy("block", "window"))
    return pairs.applyInPandas(_search(side), "word string, near string, near_n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs of ``words`` (word, n) that are one edit apart, each in both directions and once."""
    return _side(words, 0).unionByName(_side(words, 1)).distinct()


def followed(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root): where the links of ``forms`` (word, form) end.

    Counts grow by ``ratio`` from link to link and end at ``most``, which bounds the links in a row; each round doubles the links followed.
    """
    reach, bound = 1, 1
    while ratio**bound <= most:
        bound += 1
    roots = durable(forms.select("word", F.col("form").alias("root")))
    while reach < bound:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = durable(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return roots


def groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), which must be distinct.

    A word's form is its near word of largest count (ties: the smallest) if that is ``ratio`` times its own or more; its
    root is where the forms end.
    """
    words = stored(words, "variants-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    seen = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(seen, "word", "left")
    form_n = -F.col("best.minus")
    formed = form_n >= ratio * F.col("n")
    named = stored(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, form_n).alias("form_n")),
        "variants-forms",
    )
    most = words.agg(F.max("n").alias("n")).first()["n"] or 0
    roots = followed(named.where(F.col("form").isNotNull()), int(most), ratio)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of ``docs`` (doc_id, text) after the contract's damage."""
    return groups(word_counts(docs, struck))


#: The same by deleting each letter of each word: two words are near if they share what is left, or one is what is left of the other.
SQL = """
WITH RECURSIVE poly AS (
  SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS t FROM range(256) r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), own AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
), summed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)),
      lambda k: CAST('0x' || substr(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM own, poly
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
  SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n,
    CASE WHEN top >= 5 * w.n THEN (SELECT min(m.near) FROM near m WHERE m.word = w.word AND m.near_n = b.top) END AS form
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root, 0 AS d FROM forms
  UNION ALL
  SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, max_by(root, d) AS root FROM chain GROUP BY word) r ON f.word = r.word
"""
