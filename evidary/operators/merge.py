"""From search hits and records to one row per study.

Every step is a combinable aggregate or a join on a unique key, so a title or a paper
that holds a large share of all rows is reduced before anything is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidary import fixed
from evidary.functions.text import normalized_title, strip, text_or_empty

# Fields a stronger sighting takes over from a weaker one when its own are empty.
FILLED_FIELDS = ("abstract", "doi", "pmcid", "journal", "title")


def _filled(field: str) -> Column:
    return F.coalesce(F.col(field), F.lit("")) != ""


def first_filled(field: str, order: Column) -> Column:
    """The non-empty value of a field that comes first; a combinable aggregate."""
    return F.min(F.when(_filled(field), F.struct(order.alias("o"), F.col(field).alias("v"))))["v"]


def _ordered_terms(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Distinct ``found_by`` terms per key, in the order their sightings come.

    At most one row per query term reaches the final collection.
    """
    terms = df.select(*key, order.alias("_o"), F.posexplode("found_by").alias("_p", "_t"))
    firsts = terms.groupBy(*key, "_t").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", "_t")))
    return firsts.groupBy(*key).agg(F.transform(listed, lambda s: s["_t"]).alias("found_by"))


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hit edges ``(pmid, term, term_ord, rank)`` to ``found_by`` and ``best_rank`` (F1)."""
    listed = F.array_sort(F.collect_set(F.struct("term_ord", "term")))
    return hits.groupBy("pmid").agg(
        F.array_distinct(F.transform(listed, lambda s: s["term"])).alias("found_by"),
        F.min("rank").alias("best_rank"),
    )


def attach_hits(records: DataFrame, hits: DataFrame) -> DataFrame:
    """Records with their search provenance, from the record side."""
    return (
        records.join(merge_hits(hits), "pmid", "left")
        .withColumn("found_by", F.coalesce("found_by", F.array().cast("array<string>")))
        .withColumn("best_rank", F.coalesce("best_rank", F.lit(0)))
    )


def merge_rounds(prior: DataFrame, found: DataFrame) -> DataFrame:
    """Two rounds' candidates; a repeat sighting folds into the first."""
    both = prior.withColumn("_round", F.lit(0)).unionByName(found.withColumn("_round", F.lit(1)))
    order = F.col("_round")
    rest = [c for c in prior.columns if c not in (*FILLED_FIELDS, "pmid", "found_by", "best_rank")]
    present = [c for c in FILLED_FIELDS if c in prior.columns]
    merged = both.groupBy("pmid").agg(
        F.min_by(F.struct(*rest), order).alias("_first") if rest else F.min("_round").alias("_first"),
        *[first_filled(c, order).alias(c) for c in present],
        F.min("best_rank").alias("best_rank"),
    )
    keeps_type = {c: F.coalesce(c, F.lit("")) for c in ("abstract", "journal", "title") if c in present}
    out = merged.join(_ordered_terms(both, ["pmid"], order), "pmid", "left").withColumn(
        "found_by", F.coalesce("found_by", F.array().cast("array<string>"))
    )
    for name, value in keeps_type.items():
        out = out.withColumn(name, value)
    return out.select(
        *[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in prior.columns]
    )


def drop_reason() -> Column:
    """Why a candidate is dropped before titles are compared; null when it stays."""
    return F.when(F.col("is_retracted"), F.lit("retracted")).when(
        strip(text_or_empty("abstract")) == "", F.lit("no abstract")
    )


def screenable(candidates: DataFrame) -> DataFrame:
    return candidates.filter(drop_reason().isNull())


# --- near-duplicate titles (F2) -----------------------------------------------------


def _winners(keyed: DataFrame, seq: str) -> DataFrame:
    """Which sightings of a title took the lead, and in what turn: ``(seq, turn)``.

    Sightings are folded in order, and the leader takes in every sighting it meets.  So
    its strength before a sighting is known from three prefixes: how many query terms
    were seen, the best rank seen, whether a full-text id was seen.  A sighting leads
    when its own strength is greater.  Of equal strengths only the first can lead, so one
    row per distinct strength and one per distinct term is all the fold has to read.
    """
    strengths = (
        keyed.groupBy(
            "_key",
            F.size("found_by").alias("n"),
            F.col("best_rank").alias("rank"),
            F.col("pmcid").isNotNull().alias("pmc"),
        )
        .agg(F.min(seq).alias("seq"))
        .groupBy("_key")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "n", "rank", "pmc"))).alias("_s"))
        .filter(F.size("_s") > 0)
    )
    terms = (
        keyed.select("_key", F.col(seq).alias("seq"), F.explode("found_by").alias("term"))
        .groupBy("_key", "term")
        .agg(F.min("seq").alias("seq"))
        .groupBy("_key")
        .agg(F.collect_list("seq").alias("_t"))
    )
    first = F.get("_s", F.lit(0))
    state = F.struct(
        first["rank"].alias("rank"),
        first["pmc"].alias("pmc"),
        F.array(first["seq"]).alias("wins"),
    )

    def step(s: Column, c: Column) -> Column:
        seen = F.size(F.filter(F.coalesce(F.col("_t"), F.array().cast("array<bigint>")), lambda t: t < c["seq"]))
        leads = F.struct(c["n"], -c["rank"], c["pmc"]) > F.struct(seen, -s["rank"], s["pmc"])
        return F.struct(
            F.least(s["rank"], c["rank"]).alias("rank"),
            (s["pmc"] | c["pmc"]).alias("pmc"),
            F.when(leads, F.array_append(s["wins"], c["seq"])).otherwise(s["wins"]).alias("wins"),
        )

    folded = strengths.join(terms, "_key", "left").select(
        F.aggregate(F.slice("_s", F.lit(2), F.size("_s")), state, step, lambda s: s["wins"]).alias("w")
    )
    return folded.select(F.posexplode("w").alias("turn", "seq"))


def merge_titles(candidates: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per normalized title; the leader keeps its identity and takes in the rest (F2).

    ``seq`` is the candidates' unique order.  Candidates without a title pass through.
    """
    keyed = candidates.withColumn("_key", normalized_title(text_or_empty("title")))
    untitled = keyed.filter(F.col("_key") == "").drop("_key").withColumn("absorbed", F.lit(0).cast("long"))
    titled = keyed.filter(F.col("_key") != "")
    winners = _winners(titled, seq).withColumnRenamed("seq", "_seq")
    # Priority: the last leader, the leaders before it, then everyone else in order.
    ranked = titled.join(winners, titled[seq] == F.col("_seq"), "left").withColumn(
        "_o",
        F.struct(
            F.col("turn").isNull().alias("rest"),
            F.coalesce(-F.col("turn"), F.lit(0)).alias("turn"),
            F.col(seq).cast("long").alias("seq"),
        ),
    )
    order = F.col("_o")
    rest = [c for c in candidates.columns if c not in (*FILLED_FIELDS, "found_by", "best_rank")]
    present = [c for c in FILLED_FIELDS if c in candidates.columns]
    merged = ranked.groupBy("_key").agg(
        F.min_by(F.struct(*rest), order).alias("_lead"),
        *[first_filled(c, order).alias(c) for c in present],
        F.min("best_rank").alias("best_rank"),
        (F.count("*") - 1).alias("absorbed"),
    )
    out = merged.join(_ordered_terms(ranked, ["_key"], order), "_key", "left")
    out = out.withColumn("found_by", F.coalesce("found_by", F.array().cast("array<string>")))
    for name in ("abstract", "journal", "title"):
        if name in present:
            out = out.withColumn(name, text_or_empty(name))
    out = out.select(
        *[F.col(f"_lead.{c}").alias(c) if c in rest else F.col(c) for c in candidates.columns],
        "absorbed",
    )
    return out.unionByName(untitled)


def drop_counts(candidates: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: what was dropped for which reason, and whether it was over a third."""
    reasons = candidates.agg(
        F.count("*").alias("candidates"),
        F.count_if(drop_reason() == "retracted").alias("retracted"),
        F.count_if(drop_reason() == "no abstract").alias("no_abstract"),
    )
    doubles = merged.agg(F.coalesce(F.sum("absorbed"), F.lit(0)).alias("duplicate_title"))
    # Two one-row tables side by side.
    one = reasons.withColumn("_k", F.lit(1)).join(doubles.withColumn("_k", F.lit(1)), "_k").drop("_k")
    lost = F.col("retracted") + F.col("no_abstract") + F.col("duplicate_title")
    return one.withColumn("lost", lost).withColumn(
        "over_a_third", F.col("lost") > F.floor(F.col("candidates") / 3)
    )


# --- enrichment and missing ids -------------------------------------------------------


def attach_metrics(candidates: DataFrame, metrics: DataFrame) -> DataFrame:
    """Citation metrics; a miss leaves ``metrics_known`` false."""
    m = metrics.select(
        "pmid",
        F.col("citation_count").cast("long").alias("citation_count"),
        F.col("relative_citation_ratio").alias("rcr"),
        "is_research_article",
        F.lit(True).alias("metrics_known"),
    )
    return (
        candidates.join(m, "pmid", "left")
        .withColumn("metrics_known", F.coalesce("metrics_known", F.lit(False)))
        .withColumn("citation_count", F.coalesce("citation_count", F.lit(0).cast("long")))
        .withColumn("is_research_article", F.coalesce("is_research_article", F.lit(True)))
    )


def attach_metrics_or_counts(candidates: DataFrame, metrics: DataFrame, cited_by: DataFrame) -> DataFrame:
    """The fallback counts serve only when there are no primary metrics at all."""
    if not metrics.isEmpty():
        return attach_metrics(candidates, metrics)
    return (
        candidates.join(
            cited_by.select("pmid", F.col("cited_by").cast("long").alias("citation_count")), "pmid", "left"
        )
        .withColumn("metrics_known", F.col("citation_count").isNotNull())
        .withColumn("citation_count", F.coalesce("citation_count", F.lit(0).cast("long")))
        .withColumn("rcr", F.lit(None).cast("double"))
        .withColumn("is_research_article", F.lit(True))
    )


def missing_ids(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Requested ids that did not come back."""
    return requested.select("pmid").distinct().join(returned.select("pmid"), "pmid", "left_anti")


def types_overlap(types: str) -> Column:
    """Whether any publication type marks the paper as not research (I4)."""
    return F.arrays_overlap(F.col(types), F.array(*[F.lit(t) for t in fixed.NON_RESEARCH_TYPES]))
