"""Relevance and strength signals as expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidary import fixed
from evidary.functions.text import code_array_map, col, strings


def clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


# --- relevance -------------------------------------------------------------------


def agreement(found_by_count: Column | str) -> Column:
    """Convergence of independent queries (C4)."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0), col(found_by_count) - 1) / F.lit(2.0))


def position(best_rank: Column | str) -> Column:
    """Best rank, decayed."""
    return F.lit(1.0) / (F.lit(1.0) + col(best_rank) / F.lit(10.0))


def recency(year: Column | str, now_year: int, min_year: int | None = None) -> Column:
    """Publication year between a floor and now; unknown is the middle."""
    floor = min_year if min_year is not None else now_year - fixed.RECENCY_SPAN_YEARS
    y = col(year)
    if now_year <= floor:
        known = F.lit(1.0)
    else:
        known = clamp((y - floor) / F.lit(float(now_year - floor)))
    return F.when(y.isNull(), F.lit(fixed.UNMEASURED)).otherwise(known)


def citation_signal(
    metrics_known: Column | str,
    rcr: Column | str,
    year: Column | str,
    citations: Column | str,
    now_year: int,
) -> Column:
    """How much a paper was read; unmeasured is the middle, never the floor."""
    ceiling = F.log1p(F.lit(fixed.CITATION_CEILING))
    return (
        F.when(~F.coalesce(col(metrics_known), F.lit(False)), F.lit(fixed.UNMEASURED))
        .when(col(rcr).isNotNull(), clamp(col(rcr) / fixed.RCR_CEILING))
        .when(
            col(year).isNotNull() & (F.lit(now_year) - col(year) <= fixed.TOO_NEW_YEARS),
            F.lit(fixed.UNMEASURED),
        )
        .otherwise(F.least(F.lit(1.0), F.log1p(col(citations).cast("double")) / ceiling))
    )


def article_signal(
    publication_types: Column | str, source_type: Column | str, is_research: Column | str
) -> Column:
    """Whether the paper is primary literature."""
    return (
        F.when(
            F.arrays_overlap(col(publication_types), strings(fixed.NON_RESEARCH_TYPES)), F.lit(0.0)
        )
        .when(col(source_type) != "journal", F.lit(0.3))
        .when(F.coalesce(col(is_research), F.lit(True)), F.lit(1.0))
        .otherwise(F.lit(0.7))
    )


def relevance_parts(now_year: int, min_year: int | None = None, weights=None) -> Column:
    """The six weighted parts over the candidate columns."""
    w = weights or fixed.RELEVANCE_WEIGHTS
    has_abstract = F.when(F.trim(F.coalesce(F.col("abstract"), F.lit(""))) != "", 1.0).otherwise(0.0)
    return F.struct(
        (F.lit(w["agreement"]) * agreement(F.size("found_by"))).alias("agreement"),
        (F.lit(w["position"]) * position("best_rank")).alias("position"),
        (F.lit(w["recency"]) * recency("year", now_year, min_year)).alias("recency"),
        (
            F.lit(w["citation"])
            * citation_signal("metrics_known", "rcr", "year", "citation_count", now_year)
        ).alias("citation"),
        (F.lit(w["abstract"]) * has_abstract).alias("abstract"),
        (
            F.lit(w["article"])
            * article_signal("publication_types", "source_type", "is_research_article")
        ).alias("article"),
    )


def total_of(parts: Column | str) -> Column:
    """The parts added in their fixed order, so reruns agree to the last bit."""
    p = col(parts)
    return (
        p["agreement"]
        + p["position"]
        + p["recency"]
        + p["citation"]
        + p["abstract"]
        + p["article"]
    )


# --- strength --------------------------------------------------------------------


def design_signal(design: Column | str) -> Column:
    """The evidence hierarchy; unclear is unmeasured."""
    return F.element_at(code_array_map(fixed.DESIGN_SCORES), col(design))


def size_signal(n: Column | str, typical: int | None, large: int | None) -> Column:
    """Sample size on a log scale between two anchors."""
    if typical is None or large is None or large <= typical:
        return F.lit(None).cast("double")
    low = F.log(F.lit(float(typical)))
    span = F.log(F.lit(float(large))) - low
    value = clamp(F.lit(0.5) + F.lit(0.5) * ((F.log(col(n).cast("double")) - low) / span))
    return F.when(col(n) > 0, value)


def adjustment_signal(adjusted_share: Column | str, covariates: Column | str) -> Column:
    """Share of adjusted rows, or .75 when only covariates are listed."""
    return F.coalesce(col(adjusted_share), F.when(F.size(col(covariates)) > 0, F.lit(0.75)))


def basis_signal(basis: Column | str) -> Column:
    return F.when(col(basis) == "full_text", F.lit(1.0)).otherwise(F.lit(0.4))


RATIO_PATTERN = r"(?i)\b(" + "|".join(fixed.RATIO_NAMES) + r")\b"


def precision_signal(
    effect: Column | str, measure: Column | str, low: Column | str, high: Column | str
) -> Column:
    """Interval width: log10 span for ratios, relative width otherwise."""
    e, lo, hi = col(effect), col(low), col(high)
    usable = lo.isNotNull() & hi.isNotNull() & (hi >= lo)
    ratio = F.coalesce(col(measure), F.lit("")).rlike(RATIO_PATTERN) & (lo > 0)
    spread = clamp(F.lit(1.0) - F.log10(hi / lo) / fixed.RATIO_SPAN_CEILING)
    relative = clamp(F.lit(1.0) - ((hi - lo) / F.abs(e)) / fixed.ABSOLUTE_SPAN_CEILING)
    return F.when(usable & ratio, spread).when(usable & ~ratio & e.isNotNull() & (e != 0), relative)


def row_adjusted_signal(adjusted: Column | str) -> Column:
    return F.when(col(adjusted).isNotNull(), F.when(col(adjusted), 1.0).otherwise(0.2))


def combine(signals: list[tuple[str, Column, float]]) -> Column:
    """Weighted sum with unmeasured parts held at the middle.

    Returns ``struct<score, parts, unmeasured>``; the signals should be plain columns.
    """
    contributions = [
        (name, F.lit(weight) * F.coalesce(value, F.lit(fixed.UNMEASURED)))
        for name, value, weight in signals
    ]
    total = F.lit(0.0)
    for _, part in contributions:
        total = total + part
    return F.struct(
        clamp(total).alias("score"),
        F.struct(*[F.round(part, 4).alias(name) for name, part in contributions]).alias("parts"),
        F.filter(
            F.array(*[F.when(value.isNull(), F.lit(name)) for name, value, _ in signals]),
            lambda name: name.isNotNull(),
        ).alias("unmeasured"),
    )


def grade_for(score: Column | str, measured: Column | None = None) -> Column:
    """Band a score, or decline to."""
    s = col(score)
    banded = (
        F.when(s >= fixed.STRONG_AT, F.lit("strong"))
        .when(s >= fixed.MODERATE_AT, F.lit("moderate"))
        .otherwise(F.lit("limited"))
    )
    if measured is None:
        return banded
    return F.when(~measured, F.lit("ungraded")).otherwise(banded)
