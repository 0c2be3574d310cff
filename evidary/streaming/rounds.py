"""Incremental search rounds: sightings merge into candidates kept per paper, in a table or in the state store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

from evidary.operators.merge import FILLED_FIELDS
from evidary.functions.text import text_or_empty
from evidary.streaming.running import KeyedTable, by_keys

#: Fields that are an empty string where no sighting has them.
_NEVER_NULL = ("abstract", "journal", "title")


def _plain(value, whole: bool):
    """A pandas cell as the state store takes it."""
    if isinstance(value, (list, np.ndarray)):
        return [str(v) for v in value]
    if value is None or pd.isna(value):
        return None
    if isinstance(value, np.generic):
        value = value.item()
    return int(value) if whole else value


class CandidateMerge(StatefulProcessor):
    """Keeps one candidate per paper, as all rounds so far have made it, and says it whenever a sighting comes.

    Within a batch sightings count in the order of ``order``; earlier batches come first.  Terms keep the order in which they were
    first seen, the rank is the best, an empty field takes the first value that comes, and other fields stay what they
    were first.  A paper's sightings are read one after another, so any number of them fits.
    """

    def __init__(self, schema: StructType, order: str) -> None:
        self.columns = [f.name for f in schema if f.name not in ("pmid", order)]
        self.whole = {f.name for f in schema if isinstance(f.dataType, IntegralType)}
        self.state_schema = StructType([f for f in schema if f.name in self.columns])
        self.filled = [c for c in FILLED_FIELDS if c in self.columns]
        self.rest = [c for c in self.columns if c not in (*self.filled, "found_by", "best_rank")]
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("candidate", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = dict(zip(self.columns, self.kept.get())) if self.kept.exists() else None
        terms: dict[str, tuple] = {}
        first: dict[str, tuple] = {}
        rank = None
        for frame in rows:
            for row in frame.to_dict("records"):
                at = row[self.order]
                for place, term in enumerate(_plain(row["found_by"], False) or []):
                    terms[term] = min(terms.get(term, (at, place)), (at, place))
                best = _plain(row["best_rank"], True)
                rank = best if rank is None or best is not None and best < rank else rank
                for name in (*self.filled, *self.rest):
                    value = _plain(row[name], name in self.whole)
                    if (name in self.rest or value not in (None, "")) and (name not in first or at < first[name][0]):
                        first[name] = at, value
        merged = {name: first.get(name, (None, None))[1] for name in (*self.filled, *self.rest)}
        ordered = sorted(terms, key=terms.get)
        if now is not None:
            for name in self.rest:
                merged[name] = now[name]
            for name in self.filled:
                merged[name] = now[name] if now[name] not in (None, "") else merged[name]
            had = list(now["found_by"] or [])
            ordered = had + [t for t in ordered if t not in set(had)]
            rank = now["best_rank"] if rank is None or now["best_rank"] is not None and now["best_rank"] < rank else rank
        for name in _NEVER_NULL:
            if name in merged and merged[name] is None:
                merged[name] = ""
        merged |= {"found_by": ordered, "best_rank": rank}
        self.kept.update(tuple(merged[c] for c in self.columns))
        out = {"pmid": [key[0]], **{c: [merged[c]] for c in self.columns}}
        yield pd.DataFrame(out).astype({c: "Int64" for c in self.columns if c in self.whole})


def merged_candidates(sightings: DataFrame, order: str = "seq") -> DataFrame:
    """A stream of the candidates that a batch of ``sightings`` (pmid, found_by, best_rank, ``order``, any other fields) touches, merged with all before."""
    merge = CandidateMerge(sightings.schema, order)
    kept = [f for f in sightings.schema if f.name != order]
    out = StructType([f for f in kept if f.name == "pmid"] + [f for f in kept if f.name != "pmid"])
    return by_keys(sightings, "pmid").transformWithStateInPandas(merge, out, "Update", "None")


def folded(sightings: DataFrame, order: str = "seq") -> DataFrame:
    """One candidate for each paper of a batch: its sightings in the order of ``order``, under the rules of ``CandidateMerge``.

    Terms are counted once before they are gathered, so a paper of any number of sightings is as long as its distinct terms.
    """
    columns = [c for c in sightings.columns if c not in ("pmid", order)]
    said = {c: F.col(c).isNotNull() & (F.col(c) != "") for c in FILLED_FIELDS if c in columns}
    first = [
        F.min_by(c, F.when(said[c], F.col(order)) if c in said else F.col(order)).alias(c) for c in columns if c not in ("found_by", "best_rank")
    ]
    papers = sightings.groupBy("pmid").agg(*first, F.min("best_rank").alias("best_rank"))
    terms = sightings.select(F.col("pmid").alias("_pmid"), F.col(order).alias("_at"), F.posexplode("found_by").alias("_place", "_term"))
    seen = terms.groupBy("_pmid", "_term").agg(F.min(F.struct("_at", "_place")).alias("_first"))
    gathered = seen.groupBy("_pmid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_term"))), lambda t: t["_term"]).alias("found_by"))
    return papers.join(gathered, papers["pmid"].eqNullSafe(gathered["_pmid"]), "left").select(
        "pmid", *[F.coalesce("found_by", F.array().cast("array<string>")).alias(c) if c == "found_by" else F.col(c) for c in columns]
    )


def merging(kept: KeyedTable, order: str = "seq") -> Callable[[DataFrame, int], None]:
    """What a stream of sightings does with each batch: candidates of ``kept`` come before those of the batch.

    The same candidates as of ``merged_candidates``, by joins alone; the table is what is known, so the stream needs no state.
    """

    def merge(sightings: DataFrame, batch_id: int) -> None:
        fresh, now = folded(sightings, order), kept.read()
        if now is not None:
            # A batch that comes again after it was put in place finds what it has staged, and this is not computed.
            had = now.select(F.col("pmid").alias("_pmid"), F.lit(True).alias("_had"), *[F.col(c).alias(f"_{c}") for c in now.columns if c != "pmid"])
            both = fresh.join(had, fresh["pmid"].eqNullSafe(had["_pmid"]), "left")

            def merged(c: str):
                if c == "found_by":
                    return F.array_union(F.coalesce("_found_by", F.array().cast("array<string>")), "found_by")
                if c == "best_rank":
                    return F.least("_best_rank", "best_rank")
                if c in FILLED_FIELDS:
                    return F.when(text_or_empty(f"_{c}") != "", F.col(f"_{c}")).otherwise(F.col(c))
                return F.when(F.col("_had"), F.col(f"_{c}")).otherwise(F.col(c))

            fresh = both.select("pmid", *[merged(c).alias(c) for c in fresh.columns if c != "pmid"])
        kept.upsert(fresh.withColumns({c: text_or_empty(c) for c in _NEVER_NULL if c in fresh.columns}), batch_id)

    return merge


def to_screen(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The candidates that no round has screened: a paper seen again is never screened again."""
    return candidates.join(verdicts.select("pmid"), "pmid", "left_anti")
