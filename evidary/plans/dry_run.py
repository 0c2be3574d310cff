"""Plan, rank and compare without any judgment: hits and records to a diversified pool."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from evidary import fixed
from evidary.operators import merge, ranking
from evidary.operators.spend import SpendPlan, project_spend
from evidary.session import durable


@dataclass(frozen=True)
class DryRun:
    scored: DataFrame
    pool: DataFrame
    comparison: DataFrame
    spend: DataFrame | None = None


def dry_run(
    records: DataFrame,
    hits: DataFrame,
    metrics: DataFrame,
    plan: DataFrame,
    pool_size: int,
    now_year: int,
    min_year: int | None = None,
    lambda_: float = fixed.DEFAULT_LAMBDA,
    basis: str = "any",
    availability: DataFrame | None = None,
    spend: SpendPlan | None = None,
) -> DryRun:
    """With ``spend`` the pool is priced as well.  ``records`` needs the bibliographic columns and a unique ``seq``.

    The scored table is cut once: the selection reads it several times.
    """
    found = merge.attach_hits(records, hits)
    unique = merge.merge_titles(merge.screenable(found)).drop("absorbed")
    known = merge.attach_metrics(unique, metrics)
    scored = ranking.topic_affinity(ranking.with_tokens(ranking.score(known, now_year, min_year)), plan)
    scored = durable(scored.select("pmid", "title", "abstract", "pmcid", "score", "components", "topic", "tokens"))
    scored = ranking.apply_basis(scored, basis, pool_size, availability)
    pool = ranking.quota_select(scored, pool_size, lambda_)
    comparison = ranking.selection_by_topic(
        ranking.compare_selections(ranking.pure_top(scored, pool_size), pool)
    )
    return DryRun(scored, pool, comparison, None if spend is None else project_spend(pool, spend))
