"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits within a radius are found by bit masks that are built so that any two
fingerprints within the radius agree under some mask.  Each bit position gets a nonzero vector
of radius + 1 bits; a mask belongs to each nonzero vector v and holds the positions whose
vector has an odd inner product with v.  The vectors of up to ``radius`` differing positions span at
most ``radius`` dimensions, so some v is orthogonal to all of them, and its mask holds
none of the positions: the two fingerprints collide there.

Texts: A-Z are lower-cased, words are runs of bytes other than ASCII white space, shingles are three
words (a shorter text is one shingle).  A null, empty or blank text has fingerprint zero and
is linked like any other.  Rows with the same text have the same fingerprint; rows
with a null id are grouped like others, but a group's id is the smallest id that is not null.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from evidary.llm.common import durable, word_pieces
from evidary.llm.graph import components

#: Buckets with more fingerprints than this are linked through neighbourhoods instead of pairs.
PAIR_LIMIT = 256
BLOCK = 1 << 15

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text's word shingles."""
    counts, total, last = np.zeros(64, np.int64), 0, []
    for words in word_pieces((text or b"").lower()):
        words = last + words
        if len(words) >= width:
            n = len(words) - width + 1
            hashes = np.fromiter(map(_hash, map(b" ".join, zip(*[words[k:] for k in range(width)]))), np.uint64, n)
            counts += _set_bits(hashes)
            total += n
        last = words[max(0, len(words) - width + 1) :]
    if not total and last:
        counts, total = _set_bits(np.array([_hash(b" ".join(last))], np.uint64)), 1
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    found = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        some = hashes[at : at + BLOCK]
        found += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return found


@pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprint_of(text: Column) -> Column:
    return _fingerprints(text.cast("binary"))


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed 64-bit numbers."""
    kinds = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, kinds + 1):
        m = sum(1 << i for i in range(bits) if bin((i % kinds + 1) & v).count("1") % 2)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    return masks


def _ball(bits: list[int], radius: int) -> list[int]:
    """All ways to flip at most ``radius`` of the given bits, as signed numbers to XOR with."""
    flips = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(bits, r)]
    return [f - (1 << 64) if f >= 1 << 63 else f for f in flips]


def links(prints: DataFrame, radius: int = 3, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of ``prints`` (fp) within ``radius`` bits.

    Every edge is within the radius.  Buckets of up to ``pair_limit`` fingerprints are
    compared pair by pair.  In larger ones each fingerprint names its neighbourhood: the values z within
    one and within two flips of the bits the mask leaves free (for radius 3).  Two fingerprints within three flips
    share a z that is within one flip of the first and two of the second, so linking
    all fingerprints of a z to the smallest one within one flip connects
    exactly what the pairs connect, with work linear in the bucket.
    """
    masks = covering_masks(radius)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sizes = durable(
        keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    twos = sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(near)
    shared = durable(keyed.join(sizes.where("n > 2").select("t", "key", "n"), ["t", "key"]))
    some = shared.where(F.col("n") <= pair_limit)
    left, right = some.select("t", "key", F.col("fp").alias("a")), some.select("t", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    far, close = (radius + 1) // 2, radius // 2
    many = shared.where(F.col("n") > pair_limit)
    full = (1 << 64) - 1

    def around(r: int) -> DataFrame:
        flips = F.array(*[F.array(*[F.lit(f) for f in _ball([i for i in range(64) if not (m & full) >> i & 1], r)]) for m in masks])
        return many.select("t", "fp", F.explode(F.transform(F.element_at(flips, F.col("t") + 1), lambda f: F.col("fp").bitwiseXOR(f))).alias("z"))

    heads = around(close).groupBy("t", "z").agg(F.min("fp").alias("b"))
    stars = around(far).withColumnRenamed("fp", "a").join(heads, ["t", "z"]).where("a <> b").select("a", "b")
    return twos.unionByName(pairs).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs`` (doc_id, text)."""
    prints = durable(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp")))
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = durable(components(links(classes.select("fp"), radius, pair_limit)))
    rooted = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = durable(rooted.select("fp", "rep", "root"))
    least = durable(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = durable(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id, nulls last.

    Rows with the same id differ by a hash of all columns; of rows equal throughout one stays.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sig = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    # nulls last: a group's first row is the least by (id is null, id, hash)
    keyed = docs.select(row.alias("row"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), sig.alias("sig"))
    key = ["no_id", "id", "sig"]
    prints = durable(keyed.select(*key, fingerprint_of(F.col("row.text")).alias("fp")))
    classes = durable(prints.groupBy("fp").agg(F.min(F.struct(*key)).alias("first")))
    groups = durable(components(links(classes.select("fp"), radius)))
    rooted = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    sizes = prints.groupBy(*key).agg(F.count("*").alias("copies"))
    kept = durable(kept.join(sizes, key))
    alone = keyed.join(kept.where("copies = 1"), key, "left_semi").select("row.*")
    # Only rows that occur more than once are grouped whole.
    again = keyed.join(kept.where("copies > 1"), key, "left_semi").select("row.*").distinct()
    return alone.unionByName(again)
