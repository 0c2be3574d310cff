"""From screening verdicts to papers per topic within floor, ceiling and target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidary import fixed
from evidary.functions.labels import borderline, shortfall
from evidary.functions.text import alnum_lower, strip, text_or_empty, text_tokens
from evidary.operators.common import top_rows
from evidary.session import durable

@dataclass(frozen=True)
class Bounds:
    """How many papers a topic and the whole selection may hold."""

    floor: int
    ceiling: int
    target: int


# --- assignment (E6, E7, C47, D8) ------------------------------------------------------


def nearest_topics(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """``(pmid, nearest)``: the topic whose words a paper shares most; the earlier wins a tie.

    ``papers`` is ``(pmid, tokens)``.  Papers and topics meet on shared words only, so a paper
    that shares none has no row.
    """
    words = text_tokens(F.concat_ws(" ", F.col("title"), F.col("scope"), F.array_join("seed_terms", " ")))
    sides = topics.select("ord", "slug", words.alias("_w")).select("ord", "slug", F.size("_w").alias("_n"), F.explode("_w").alias("word"))
    asked = papers.select("pmid", F.size("tokens").alias("_m"), F.explode("tokens").alias("word"))
    shared = asked.join(sides, "word").groupBy("pmid", "_m", "ord", "slug", "_n").agg(F.count("*").alias("_both"))
    overlap = F.col("_both") / (F.col("_m") + F.col("_n") - F.col("_both"))
    best = shared.groupBy("pmid").agg(F.max(F.struct(overlap.alias("overlap"), (-F.col("ord")).alias("earlier"), "slug"))["slug"].alias("nearest"))
    return best


def recover_topics(df: DataFrame, named: str, topics: DataFrame, out: str = "recovered") -> DataFrame:
    """Adds ``out``: the taxonomy's slug for the topic name written in ``named``, or null.

    Exact after folding, else the first listed part that matches.  Only the distinct names are looked up.
    """
    slugs = topics.groupBy(alnum_lower(F.col("slug")).alias("_key")).agg(F.max_by("slug", "ord").alias("_slug"))
    names = df.select(F.col(named).alias("_name")).where(F.col(named).isNotNull()).distinct()
    parts = F.concat(F.array(F.col("_name")), F.split("_name", r"[,;/|\n]", -1))  # the whole name stands first
    listed = names.select("_name", F.posexplode(parts).alias("_at", "_part")).withColumn("_key", alnum_lower("_part"))
    found = listed.join(slugs, "_key").groupBy("_name").agg(F.min(F.struct("_at", "_slug"))["_slug"].alias(out))
    return df.join(found, F.col(named) == F.col("_name"), "left").drop("_name")


def _known(df: DataFrame, column: str, topics: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the value of ``column`` where the taxonomy has it, else null."""
    slugs = topics.select(F.col("slug").alias(out)).distinct()
    return df.join(slugs, F.col(column) == F.col(out), "left")


def blank_unknown_topics(df: DataFrame, topics: DataFrame, column: str = "topic") -> DataFrame:
    """Topics the taxonomy does not have become '' and are named in ``unknown_topic``."""
    known = _known(df, column, topics, "_known")
    return (
        known.withColumn("unknown_topic", F.when((F.col(column) != "") & F.col("_known").isNull(), F.col(column)))
        .withColumn(column, F.coalesce("_known", F.lit("")))
        .drop("_known")
    )


def assign_topics(verdicts: DataFrame, candidates: DataFrame, topics: DataFrame) -> DataFrame:
    """The screener's hint, else the finding query's topic, else the nearest topic.

    ``candidates`` needs ``pmid``, ``topic`` (affinity) and ``tokens``.  Screened papers
    without a candidate, and papers no source can place, are left out.
    """
    joined = verdicts.withColumnRenamed("topic", "hint").join(
        candidates.select("pmid", F.col("topic").alias("affinity"), "tokens"), "pmid"
    )
    both = _known(_known(joined, "hint", topics, "_hint"), "affinity", topics, "_affinity")
    near = nearest_topics(candidates.select("pmid", "tokens").dropDuplicates(["pmid"]), topics)
    placed = both.join(near, "pmid", "left").withColumn("topic", F.coalesce("_hint", "_affinity", "nearest"))
    return placed.filter(F.col("topic").isNotNull()).drop("tokens", "hint", "affinity", "_hint", "_affinity", "nearest")


def curation_order(verdicts: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds ``order``: relevance, then pool position (unpooled after the pool), then pmid.

    A sortable key instead of a dense rank: nothing downstream needs the numbers between.
    """
    last = F.lit(2**62)
    return verdicts.join(pool.select("pmid", "position"), "pmid", "left").withColumn(
        "order",
        F.struct(
            (-F.col("relevance")).alias("relevance"),
            F.coalesce("position", last).alias("position"),
            F.col("pmid").alias("pmid"),
        ),
    )


# --- offers, decisions, reserve (H5, E8, H6) ----------------------------------------------


def offers(assigned: DataFrame, ceiling: int) -> DataFrame:
    """Included papers per topic, best first, at most three ceilings (H5)."""
    cap = max(1, ceiling * fixed.OFFER_MULTIPLE)
    return top_rows(assigned.filter("include"), ["topic"], ["order"], cap, ["pmid"], "offer")


def reconcile_decisions(offered: DataFrame, answered: DataFrame, failed_topics: DataFrame | None = None) -> DataFrame:
    """A decision per offered paper and only per offered paper.

    No answer is no; an invented id is dropped; a topic whose call failed keeps all.
    """
    reply = answered.select("topic", "pmid", F.col("keep").alias("said"), F.col("rationale").alias("why"))
    joined = offered.join(reply, ["topic", "pmid"], "left")
    if failed_topics is None:
        joined = joined.withColumn("failed", F.lit(None).cast("boolean"))
    else:
        joined = joined.join(
            failed_topics.select("topic").distinct().withColumn("failed", F.lit(True)),
            "topic",
            "left",
        )
    return (
        joined.withColumn("keep", F.coalesce("failed", "said", F.lit(False)))
        .withColumn(
            "rationale",
            F.when(F.col("failed"), F.lit("curation unavailable")).otherwise(
                F.coalesce("why", F.lit("the curator did not answer"))
            ),
        )
        .drop("said", "why", "failed")
    )


def reserve(assigned: DataFrame, decisions: DataFrame) -> DataFrame:
    """What a topic can still take: overflow, then borderline, then rejected (H6)."""
    judged = decisions.select("pmid", F.col("topic").alias("judged_by"), "keep")
    per_paper = judged.groupBy("pmid").agg(
        F.collect_set(F.when(~F.col("keep"), F.col("judged_by"))).alias("refused_by")
    )
    tier = (
        F.when(F.array_contains("refused_by", F.col("topic")), F.lit(2))
        .when(F.col("refused_by").isNotNull(), F.lit(None))
        .when(F.col("include"), F.lit(0))
        .when(borderline("include", "relevance", "confidence"), F.lit(1))
    )
    return (
        assigned.join(per_paper, "pmid", "left")
        .withColumn("tier", tier)
        .filter(F.col("tier").isNotNull())
        .withColumn("seq", F.struct("tier", "order"))
        .select("topic", "pmid", "tier", "order", "seq")
    )


# --- bounds (G3 to G6) ---------------------------------------------------------------------


def first_claim(kept: DataFrame, topics: DataFrame) -> DataFrame:
    """A paper kept by several topics stays on the first in taxonomy order.

    ``claims`` counts how many known topics kept it; where ``kept`` has such a column, a row stands for so many.
    """
    order = topics.select(F.col("slug").alias("topic"), "ord")
    claims = F.sum("claims") if "claims" in kept.columns else F.count("*")
    return (
        kept.join(order, "topic")
        .groupBy("pmid")
        .agg(F.min(F.struct("ord", "topic")).alias("_c"), claims.alias("claims"))
        .select("pmid", F.col("_c.topic").alias("topic"), "claims")
    )


def under_ceiling(placed: DataFrame, ceiling: int) -> DataFrame:
    """The best ``ceiling`` papers of every topic; adds ``position`` from 1."""
    return top_rows(placed, ["topic"], ["order", "pmid"], ceiling, ["pmid"], "position")


def _backfill(placed: DataFrame, queue: DataFrame, needs: DataFrame, floor: int) -> DataFrame:
    free = queue.join(placed.select("pmid"), "pmid", "left_anti").join(needs, "topic")
    # no topic needs more than the floor
    return top_rows(free, ["topic"], ["seq", "pmid"], max(1, floor), ["pmid"], "turn").filter(F.col("turn") <= F.col("need"))


@dataclass(frozen=True)
class Placed:
    """Papers in their places, and one row that accounts for the others."""

    papers: DataFrame
    account: DataFrame


def place(
    kept: DataFrame,
    order: DataFrame,
    topics: DataFrame,
    bounds: Bounds,
    queue: DataFrame | None = None,
) -> DataFrame:
    """The papers of ``place_in_bounds``."""
    return place_in_bounds(kept, order, topics, bounds, queue).papers


def place_in_bounds(
    kept: DataFrame,
    order: DataFrame,
    topics: DataFrame,
    bounds: Bounds,
    queue: DataFrame | None = None,
) -> Placed:
    """Fit the kept papers inside the bounds.

    ``kept`` is ``(topic, pmid)``, ``order`` is ``(pmid, order)`` with any sortable
    ``order``, ``queue`` is ``(topic, pmid, seq)``.  Papers are ``(topic, pmid, position,
    backfilled)`` in final order; those missing from ``order`` sort last.  The account counts
    what named an unknown topic, further claims on a paper, papers over a ceiling, backfilled and
    cut to the target, papers placed, and how far the floors keep these above the target or the supply below it.
    """
    ranked = order.select("pmid", F.struct(F.lit(0).alias("known"), F.col("order")).alias("order"))
    claimed = durable(first_claim(kept, topics))
    placed = claimed.select("pmid", "topic").join(ranked, "pmid", "left")
    # A null struct sorts first; swap in a marker that sorts last.
    placed = placed.withColumn("order", F.struct(F.col("order").isNull().alias("last"), "order"))
    held = durable(under_ceiling(placed, bounds.ceiling).withColumn("backfilled", F.lit(False)))
    below = held
    slugs = topics.select(F.col("slug").alias("topic"), "ord")

    if queue is not None:
        counts = held.groupBy("topic").agg(F.count("*").alias("have"), F.max("position").alias("top"))
        short = (
            slugs.join(counts, "topic", "left")
            .select(
                "topic",
                "ord",
                F.coalesce("top", F.lit(0)).alias("top"),
                (F.lit(bounds.floor) - F.coalesce("have", F.lit(0))).cast("int").alias("need"),
            )
            .filter(F.col("need") > 0)
        )
        # One row per topic and paper, the first place it has in the queue.
        tickets = queue.groupBy("topic", "pmid").agg(F.min("seq").alias("seq"))
        shared = not tickets.groupBy("pmid").count().filter("count > 1").isEmpty()
        # With every paper in one queue only, all topics fill at once; otherwise topics
        # take turns in taxonomy order, since an earlier one may take a later one's paper.
        turns = (
            [short.drop("ord")]
            if not shared
            else [
                short.filter(F.col("topic") == r["topic"]).drop("ord")
                for r in short.orderBy("ord").collect()
            ]
        )
        for needs in turns:
            extra = _backfill(held, tickets, needs, bounds.floor).join(
                ranked, "pmid", "left"
            ).withColumn("order", F.struct(F.col("order").isNull().alias("last"), "order"))
            held = durable(
                held.unionByName(
                    extra.select(
                        "pmid",
                        "topic",
                        "order",
                        (F.col("top") + F.col("turn")).cast("int").alias("position"),
                        F.lit(True).alias("backfilled"),
                    )
                )
            )

    filled = held
    excess = held.count() - bounds.target
    if excess > 0:
        # Popping the widest topic again and again removes, in all, the deepest positions
        # above the floor, the greater slug first among equals.
        removed = (
            held.filter(F.col("position") > bounds.floor)
            .orderBy(F.desc("position"), F.desc("topic"))
            .limit(excess)
            .select("pmid")
        )
        held = held.join(removed, "pmid", "left_anti")
    final = Window.partitionBy("topic").orderBy("order", "pmid")
    papers = held.select("topic", "pmid", F.row_number().over(final).alias("position"), "backfilled")
    return Placed(papers, _account(kept, claimed, below, filled, held, bounds.target))


def _account(kept: DataFrame, claimed: DataFrame, below: DataFrame, filled: DataFrame, held: DataFrame, target: int) -> DataFrame:
    """One row of what became of the kept papers; every count is an aggregate of its own table."""
    rows = lambda df, name: df.agg(F.count("*").alias(name))
    claims = claimed.agg(F.coalesce(F.sum("claims"), F.lit(0)).alias("_claims"), F.count("*").alias("_claimed"))
    tables = [claims, rows(kept, "_kept"), rows(below, "_below"), rows(filled, "_filled"), rows(held, "placed")]
    one = tables[0]
    for t in tables[1:]:
        one = one.join(t)  # tables of one row each
    return one.select(
        (F.col("_kept") - F.col("_claims")).alias("unknown_topic"),
        (F.col("_claims") - F.col("_claimed")).alias("duplicates"),
        (F.col("_claimed") - F.col("_below")).alias("over_ceiling"),
        (F.col("_filled") - F.col("_below")).alias("backfilled"),
        (F.col("_filled") - F.col("placed")).alias("over_target"),
        "placed",
        F.greatest(F.col("placed") - target, F.lit(0)).alias("above_target"),
        F.greatest(target - F.col("placed"), F.lit(0)).alias("below_target"),
    )


def gaps(placed: DataFrame, topics: DataFrame, floor: int, missing: DataFrame | None = None) -> DataFrame:
    """Topics still under their floor, and what they lack."""
    counts = placed.groupBy("topic").agg(F.count("*").alias("kept"))
    out = topics.select("ord", F.col("slug").alias("topic")).join(counts, "topic", "left").withColumn(
        "kept", F.coalesce("kept", F.lit(0).cast("long"))
    )
    if missing is not None:
        out = out.join(missing.select("topic", "missing"), "topic", "left")
    else:
        out = out.withColumn("missing", F.lit(""))
    return (
        out.withColumn("missing", text_or_empty("missing"))
        .withColumn("shortfall", shortfall("kept", floor))
        .filter(F.col("kept") < floor)
    )


def taxonomy_capacity(topics: DataFrame, bounds: Bounds, max_topics: int) -> DataFrame:
    """One row: floor and ceiling the taxonomy implies, and what is wrong with it (F16)."""
    n = F.col("topics")
    one = topics.agg(F.count("*").alias("topics"))
    low, high = n * bounds.floor, n * bounds.ceiling
    notes = F.array_compact(
        F.array(
            F.when(n == 0, F.lit("no topics")),
            F.when(n > max_topics, F.lit("too many topics")),
            F.when((n > 0) & (F.lit(bounds.target) > high), F.lit("target above capacity")),
            F.when((n > 0) & (F.lit(bounds.target) < low), F.lit("target below floor")),
        )
    )
    return one.withColumn("floor", low).withColumn("ceiling", high).withColumn("problems", notes)


def included(verdicts: DataFrame) -> DataFrame:
    """Included verdicts with their borderline flag."""
    flagged = verdicts.withColumn("borderline", borderline("include", "relevance", "confidence"))
    return flagged.filter("include")


def nonblank(readings: DataFrame) -> DataFrame:
    """Readings that say anything at all."""
    return readings.filter(
        (strip(text_or_empty("description")) != "")
        | (strip(text_or_empty("bottom_line")) != "")
        | (F.size("predictors") > 0)
    )
