"""The search plan as tables, and the reading cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidary import fixed
from evidary.functions.text import inline, keyphrases, strip, text_or_empty


def plan_queries(planned: DataFrame, max_queries: int) -> DataFrame:
    """The plan without blanks and repeats, first one kept, cut to size (H7): ``(ord, term, topic)``."""
    firsts = (
        planned.filter(strip(text_or_empty("term")) != "")
        .groupBy("term")
        .agg(F.min(F.struct("ord", "topic")).alias("f"))
        .select(F.col("f.ord").alias("ord"), "term", F.col("f.topic").alias("topic"))
    )
    return firsts.orderBy("ord").limit(max_queries)


def any_of(terms: Column) -> Column:
    """Phrases as one title-or-abstract clause, '' when none is left."""
    kept = F.array_distinct(F.filter(F.transform(terms, strip), lambda t: t != ""))
    clauses = F.transform(kept, lambda t: F.concat(F.lit('"'), inline(t), F.lit('"[tiab]')))
    joined = F.array_join(clauses, " OR ")
    return F.when(F.size(clauses) > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined)


def gap_queries(
    gaps: DataFrame, topics: DataFrame, executed: DataFrame, base: str = "", max_queries: int = 12
) -> DataFrame:
    """Queries for topics that came up short, those already run left out.

    ``gaps`` is ``(ord, topic, shortfall, missing)``, ``executed`` is ``(term)``.
    """
    seeds = topics.select(F.col("slug").alias("topic"), "seed_terms")
    facets = (
        gaps.filter(F.col("shortfall") > 0)
        .join(seeds, "topic", "left")
        .withColumn("seed_terms", F.coalesce("seed_terms", F.array().cast("array<string>")))
        .withColumn(
            "facet",
            any_of(F.slice(F.concat(keyphrases(text_or_empty("missing")), F.col("seed_terms")), 1, fixed.MAX_GAP_TERMS)),
        )
        .filter(F.col("facet") != "")
    )
    term = F.concat(F.lit(f"{base} AND "), F.col("facet")) if base else F.col("facet")
    fresh = facets.withColumn("term", term).join(executed.select("term"), "term", "left_anti")
    return plan_queries(fresh.select("ord", "term", "topic"), max_queries)


def readings_to_make(requests: DataFrame, readings: DataFrame) -> DataFrame:
    """Requests without a usable cached reading (E19); a blank cached one is a miss.

    ``requests`` is ``(pmid, fingerprint, …)``; ``readings`` adds ``blank``.
    """
    usable = readings.filter(~F.col("blank")).select("pmid", "fingerprint")
    return requests.join(usable, ["pmid", "fingerprint"], "left_anti")


def readings_reused(requests: DataFrame, readings: DataFrame) -> DataFrame:
    """Requests that a usable cached reading answers, with it."""
    return requests.join(readings.filter(~F.col("blank")), ["pmid", "fingerprint"])


def append_readings(made: DataFrame, path: str) -> None:
    """Keep what was read (E19): readings are added, none is changed, and failed ones are not kept.

    ``made`` is ``(pmid, fingerprint, blank, failed)``; a paper read twice keeps both, of which any usable one counts.
    """
    made.filter(~F.coalesce("failed", F.lit(False))).drop("failed").write.mode("append").parquet(path)
