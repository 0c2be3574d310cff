"""What a run would still cost, measured on its ranked pool."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from evidary import fixed
from evidary.functions.labels import prompt_tokens
from evidary.functions.text import screening_text
from evidary.operators.ranking import with_positions


@dataclass(frozen=True)
class SpendPlan:
    """The parameters of a projection; the fixed prompt sizes come from the user's own prompts."""

    screen_budget: int
    target: int
    topics: int
    floor: int
    screen_prefix: int = 0
    curate_prefix: int = 0
    extract_prefix: int = 0
    basis: str = "any"
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    thinking: dict[str, int] = field(default_factory=dict)


def project_spend(pool: DataFrame, plan: SpendPlan) -> DataFrame:
    """``(ord, node, role, calls, prompt_tokens, completion_tokens, usd)`` for the paid stages.

    One aggregate over the pool by position; all that follows are columns of its one row.
    """
    topics = max(1, plan.topics)
    kept = max(plan.target, topics * plan.floor)
    place = F.col("position")
    over = lambda limit, tokens: F.coalesce(F.sum(F.when(place < limit, tokens)), F.lit(0))
    sums = with_positions(pool).agg(
        F.count("*").alias("size"),
        over(plan.screen_budget, prompt_tokens(screening_text("title", "abstract"))).alias("screening"),
        over(plan.screen_budget, prompt_tokens("title")).alias("titles"),
        over(kept, prompt_tokens("abstract")).alias("abstracts"),
        F.count_if((place < kept) & F.col("pmcid").isNotNull()).alias("linked"),
    )
    share = {"abstract": "0D", "full-text": "1D"}.get(
        plan.basis, f"IF(sampled > 0, linked / sampled * {fixed.OPEN_ACCESS_RATE}D, 0D)"
    )
    sized = sums.selectExpr(
        "*", f"least({plan.screen_budget}L, size) AS screened", f"IF(size > 0, least({kept}L, size), {kept}L) AS retained", f"least({kept}L, size) AS sampled"
    )
    each = sized.selectExpr(
        "*",
        f"IF(screened > 0, titles div screened, {fixed.DEFAULT_TITLE_TOKENS}) AS title",
        f"greatest(1L, least(screened, {kept * 2}L) div {topics}) AS per_topic",
        f"IF(sampled > 0, abstracts div sampled, {fixed.DEFAULT_ABSTRACT_TOKENS}) AS abstract",
        f"{share} AS share",
    )
    capped = f"least(CAST(abstract * {fixed.FULL_TEXT_MULTIPLE} AS DOUBLE), {fixed.MAX_SOURCE_CHARS / 4.0}D)"
    source = each.selectExpr("*", f"CAST(floor(abstract * (1 - share) + {capped} * share) AS BIGINT) AS source")
    stages = (
        ("screen", "fast", "screened", f"screening + {plan.screen_prefix} * screened", f"{fixed.SCREEN_COMPLETION_TOKENS} * screened"),
        (
            "curate", "balanced", f"{topics}L",
            f"{topics} * ({plan.curate_prefix} + per_topic * (title + {fixed.CURATE_OVERHEAD_TOKENS}))",
            f"{topics} * per_topic * {fixed.CURATE_COMPLETION_TOKENS}",
        ),
        ("extract", "balanced", "retained", f"retained * ({plan.extract_prefix} + source)", f"retained * {fixed.EXTRACT_COMPLETION_TOKENS}"),
    )
    rows = []
    for i, (node, role, calls, tokens_in, tokens_out) in enumerate(stages):
        price = plan.prices.get(role)
        paid = f"({tokens_out} + {calls} * {plan.thinking.get(role, 0)})"
        usd = f"CAST(({tokens_in}) / 1e6D * {price[0]}D + {paid} / 1e6D * {price[1]}D AS DOUBLE)" if price else "CAST(NULL AS DOUBLE)"
        rows.append(
            f"struct({i} AS ord, '{node}' AS node, '{role}' AS role, CAST({calls} AS BIGINT) AS calls, CAST({tokens_in} AS BIGINT) AS prompt_tokens, "
            f"CAST({paid} AS BIGINT) AS completion_tokens, {usd} AS usd)"
        )
    return source.selectExpr(f"inline(array({', '.join(rows)}))").where("calls > 0")
