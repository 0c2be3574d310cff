"""Scores, total order, diversified selection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from evidary import fixed
from evidary.functions.scoring import relevance_parts, total_of
from evidary.functions.text import paper_tokens, text_or_empty, strip
from evidary.operators.common import numbered, top_rows
from evidary.session import durable


def score(candidates: DataFrame, now_year: int, min_year: int | None = None, weights=None) -> DataFrame:
    """Adds ``components`` and ``score``."""
    return candidates.withColumn("components", relevance_parts(now_year, min_year, weights)).withColumn(
        "score", total_of("components")
    )


def in_order(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "pmid")


def with_positions(scored: DataFrame) -> DataFrame:
    """0-based position in the total order ``(-score, pmid)`` (G1)."""
    return numbered(scored, [F.desc("score"), "pmid"], "position")


def pure_top(scored: DataFrame, pool_size: int) -> DataFrame:
    """The best ``pool_size`` by score alone (H1)."""
    return in_order(scored).limit(pool_size)


# --- topic affinity (E4) -------------------------------------------------------------

def topic_affinity(candidates: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``topic``: of the topics whose queries found a paper, the first in plan order.

    ``plan`` is ``(ord, term, topic)``; a term planned twice counts for both of its topics.
    """
    firsts = plan.filter(F.col("topic") != "").groupBy("topic").agg(F.min("ord").alias("topic_ord"))
    mapped = plan.join(firsts, "topic").groupBy("term").agg(F.min(F.struct("topic_ord", "topic")).alias("first"))
    found = candidates.select("pmid", F.explode("found_by").alias("term")).join(mapped, "term")
    best = found.groupBy("pmid").agg(F.min("first")["topic"].alias("topic"))
    return candidates.join(best, "pmid", "left").withColumn("topic", F.coalesce("topic", F.lit("")))


def with_tokens(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("tokens", paper_tokens("title", "mesh_terms", "keywords"))


# --- diversified order (H2) -------------------------------------------------------------

# How many of a group's best candidates one task looks at in one round.
BATCH = 32_768


def _greedy(pdf: pd.DataFrame, lambda_: float) -> pd.DataFrame:
    """Exact picks from one group's leading candidates.

    Rows come with their marginal value as of now.  Values only fall as more is picked,
    so a pick is certain while it is at least as good as the best row left outside, which
    is the last row here when ``cut`` is set.  That row itself is never picked.
    """
    pdf = pdf.sort_values(["value", "score", "pmid"], ascending=[False, False, True], ignore_index=True)
    n, want = len(pdf), int(pdf["want"].iloc[0])
    cut = bool(pdf["cut"].iloc[0])
    inside = n - 1 if cut else n
    score = pdf["score"].to_numpy()
    closest = pdf["closest"].to_numpy().copy()
    sizes = np.array([len(t) for t in pdf["tokens"]], dtype=np.int64)
    holders: dict[str, list[int]] = {}
    for i, tokens in enumerate(pdf["tokens"]):
        for token in tokens:
            holders.setdefault(token, []).append(i)
    postings = {token: np.array(rows) for token, rows in holders.items()}
    # Rows are unique in (score, pmid); this is their place in the pure order.
    pure = np.empty(n, dtype=np.int64)
    pure[pdf.sort_values(["score", "pmid"], ascending=[False, True]).index.to_numpy()] = np.arange(n)
    open_rows = np.ones(n, dtype=bool)
    open_rows[inside:] = False
    outside = (pdf["value"].iloc[-1], -pure[n - 1]) if cut else None
    picked: list[int] = []
    while len(picked) < want and open_rows.any():
        value = np.where(open_rows, lambda_ * score - (1.0 - lambda_) * closest, -np.inf)
        ties = np.flatnonzero(value == value.max())
        best = ties[np.argmin(pure[ties])]
        if outside is not None and (value[best], -pure[best]) < outside:
            break
        picked.append(best)
        open_rows[best] = False
        if sizes[best]:
            shared = np.zeros(n)
            for token in pdf["tokens"].iloc[best]:
                shared[postings[token]] += 1
            with np.errstate(invalid="ignore", divide="ignore"):
                overlap = np.where(sizes > 0, shared / (sizes + sizes[best] - shared), 0.0)
            closest = np.maximum(closest, overlap)
    out = pdf.iloc[picked][["grp", "pmid", "score", "tokens"]].copy()
    out["pick"] = int(pdf["done"].iloc[0]) + np.arange(len(picked))
    return out


def mmr_order(
    scored: DataFrame,
    limit: int,
    lambda_: float = fixed.DEFAULT_LAMBDA,
    group: str | None = None,
    batch: int = BATCH,
) -> DataFrame:
    """Maximal marginal relevance: ``(group, pmid, pick)`` for the first ``limit`` of each group.

    ``scored`` needs ``pmid``, ``score`` and ``tokens``.  Exact at any size: candidates that
    can never be picked are dropped by their score, then rounds of (1) a cut of each group's best
    ``batch`` by their value as of now, (2) a bounded greedy walk per group that stops where an
    unseen candidate might be better, and (3) a join on tokens that brings the greatest similarity of
    the remaining candidates up to date, which only picks with a token in common can change.  A group of at most
    ``batch`` candidates takes one round.
    """
    name = group or "grp"
    rows = scored.select(
        (F.col(group) if group else F.lit("")).alias("grp"), "pmid", "score", "tokens"
    )
    best = top_rows(
        rows.select("grp", "pmid", "score"), ["grp"], ["-score", "pmid"], limit, ["pmid"]
    )
    if lambda_ >= 1.0:
        return best.select(F.col("grp").alias(name), "pmid", (F.col("rn") - 1).alias("pick"))
    groups = durable(best.groupBy("grp").agg(F.count("*").alias("want"), F.min("score").alias("kth")))
    # Similarity is at most 1, so anything this far under the k-th best never wins a pick.
    reach = (1.0 - lambda_) / lambda_ if lambda_ > 0 else float("inf")
    pool = durable(
        rows.join(groups, "grp")
        .filter((F.col("want") < limit) | (F.col("score") >= F.col("kth") - F.lit(reach)))
        .drop("kth")
        .withColumn("closest", F.lit(0.0))
        .withColumn("done", F.lit(0))
    )
    picks: DataFrame | None = None
    while True:
        value = F.lit(lambda_) * F.col("score") - F.lit(1.0 - lambda_) * F.col("closest")
        # Only what orders the candidates goes through the windows; their tokens join after the cut.
        lead = top_rows(
            pool.select("grp", "pmid", "score", "closest", value.alias("value"), (F.col("want") - F.col("done")).alias("want"), "done"),
            ["grp"], ["-value", "-score", "pmid"], batch + 1, ["pmid"],
        ).withColumn("cut", F.max("rn").over(Window.partitionBy("grp")) > batch)
        fresh = durable(
            lead.join(pool.select("grp", "pmid", "tokens"), ["grp", "pmid"]).groupBy("grp").applyInPandas(
                lambda pdf: _greedy(pdf, lambda_),
                "grp string, pmid string, score double, tokens array<string>, pick int",
            )
        )
        picks = fresh if picks is None else picks.unionByName(fresh)
        # Groups that have all they want, or no candidate left, are done with.
        more = fresh.groupBy("grp").agg(F.count("*").cast("int").alias("more"))
        left = durable(
            pool.join(more, "grp").withColumn("done", F.col("done") + F.col("more")).filter(F.col("done") < F.col("want"))
            .join(fresh.select("grp", "pmid"), ["grp", "pmid"], "left_anti").select(*pool.columns)
        )
        if left.isEmpty():
            return picks.select(F.col("grp").alias(name), "pmid", "pick")
        pool = durable(_brought_up_to_date(left, fresh))


def _brought_up_to_date(left: DataFrame, picked: DataFrame) -> DataFrame:
    """``left`` with each candidate's greatest similarity to any pick.

    Only a pick that shares a token can raise it, so the candidates that picks reach are found by their tokens: what
    is counted are shared tokens of pairs that have some, and no group's picks are gathered.
    """
    held = picked.select("grp", F.col("pmid").alias("_pick"), F.size("tokens").alias("_m"), F.explode("tokens").alias("_t"))
    wanted = left.select("grp", "pmid", F.size("tokens").alias("_n"), F.explode("tokens").alias("_t"))
    shared = wanted.join(held, ["grp", "_t"]).groupBy("grp", "pmid", "_pick", "_n", "_m").agg(F.count("*").alias("_both"))
    near = shared.groupBy("grp", "pmid").agg(F.max(F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))).alias("_near"))
    nearest = F.greatest("closest", F.coalesce("_near", F.lit(0.0)))
    return left.join(near, ["grp", "pmid"], "left").withColumn("closest", nearest).select(*left.columns)


# --- quota (H3) --------------------------------------------------------------------------


def quota_select(
    scored: DataFrame, pool_size: int, lambda_: float = fixed.DEFAULT_LAMBDA, batch: int = BATCH
) -> DataFrame:
    """Fill the pool topic by topic, top it up from the rest, cut to size.

    ``scored`` needs ``topic`` (possibly empty) and ``tokens``.
    """
    groups = scored.select("topic").distinct().count()
    if pool_size <= 0 or groups == 0:
        return in_order(scored.limit(0))
    quota = max(1, math.ceil(pool_size / groups))
    taken = durable(mmr_order(scored, quota, lambda_, "topic", batch).select("pmid"))
    short = pool_size - taken.count()
    if short > 0:
        leftovers = scored.join(taken, "pmid", "left_anti")
        taken = taken.unionByName(mmr_order(leftovers, short, lambda_, None, batch).select("pmid"))
    return in_order(scored.join(taken, "pmid", "left_semi")).limit(pool_size)


# --- comparing selections (I1, F4) ----------------------------------------------------------


def compare_selections(pure: DataFrame, diversified: DataFrame) -> DataFrame:
    """``(pmid, topic, score, side)``: side is ``both``, ``added`` or ``dropped``."""
    a = pure.select("pmid", "topic", "score").withColumn("in_pure", F.lit(True))
    b = diversified.select("pmid", "topic", "score").withColumn("in_div", F.lit(True))
    joined = a.join(b, ["pmid", "topic", "score"], "full_outer")
    side = (
        F.when(F.col("in_pure") & F.col("in_div"), F.lit("both"))
        .when(F.col("in_div"), F.lit("added"))
        .otherwise(F.lit("dropped"))
    )
    return joined.select("pmid", "topic", "score", side.alias("side"))


def selection_by_topic(comparison: DataFrame) -> DataFrame:
    """Pool counts per topic under both selections, and whether the topic gained."""
    label = F.when(F.col("topic") == "", F.lit(fixed.UNASSIGNED)).otherwise(F.col("topic"))
    return (
        comparison.groupBy(label.alias("topic"))
        .agg(
            F.count_if(F.col("side") != "added").alias("pure"),
            F.count_if(F.col("side") != "dropped").alias("diversified"),
            F.count_if(F.col("side") == "added").alias("added"),
            F.count_if(F.col("side") == "dropped").alias("dropped"),
        )
        .withColumn("helped", F.col("diversified") > F.col("pure"))
    )


# --- basis policy (D2), screening queue (E5, H4) ------------------------------------------------


def apply_basis(scored: DataFrame, policy: str, pool_size: int, availability: DataFrame | None = None) -> DataFrame:
    """Narrow the ranked papers to what a run is willing to read.

    ``availability`` is ``(pmid, available)``; a null or missing answer keeps the paper,
    because a failed check is no answer.
    """
    if policy == "any":
        return scored
    if policy == "abstract":
        return scored.filter(strip(text_or_empty("abstract")) != "")
    if policy != "full-text":
        raise ValueError(f"unknown basis policy {policy!r}")
    checked = in_order(scored.filter(F.col("pmcid").isNotNull())).limit(pool_size)
    return (
        checked.join(availability.select("pmid", "available"), "pmid", "left")
        .filter(F.coalesce("available", F.lit(True)))
        .drop("available")
    )


def screening_queue(pool: DataFrame, verdicts: DataFrame, budget: int) -> DataFrame:
    """Pooled papers not screened yet, best first, within the budget of all rounds (E5, H4)."""
    done = verdicts.select("pmid").distinct().count()
    pending = pool.join(verdicts.select("pmid"), "pmid", "left_anti")
    return in_order(pending).limit(max(0, budget - done))
