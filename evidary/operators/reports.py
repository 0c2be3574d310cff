"""Counts and index pages over the whole corpus.

Pages come as ordered lines, ``(page, order, line)``, so a page over a large corpus is a
sorted table and is never gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidary import fixed
from evidary.functions.labels import expansion_is_mechanical, format_cost, is_export_safe, strength_cell
from evidary.functions.text import (
    document_filename,
    inline,

    strip,
    table_row,
    text_or_empty,
    thousands,
)
from evidary.operators.budgets import is_sentinel
from evidary.operators.recurrence import direction_line, site_order


# --- topic pages (B7, F6) ------------------------------------------------------------------


def topic_index(records: DataFrame, findings: DataFrame) -> DataFrame:
    """The browse table: one line per paper, in its topic's page."""
    counts = findings.groupBy("pmid").agg(F.count("*").alias("total"))
    # Only the first names are shown, so only those and the count travel.
    shown = (
        findings.filter(F.col("row") <= fixed.TOPIC_PREDICTORS)
        .groupBy("pmid")
        .agg(F.array_sort(F.collect_list(F.struct("row", "predictor"))).alias("_p"))
    )
    names = F.transform("_p", lambda p: p["predictor"])
    line = F.array_join(names, ", ")
    more = F.col("total") - F.size(names)
    key = F.when(F.coalesce(F.size("_p"), F.lit(0)) <= 0, F.lit(fixed.NONE_CELL)).otherwise(
        F.when(more > 0, F.concat(line, F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(line)
    )
    joined = records.join(counts, "pmid", "left").join(shown, "pmid", "left")
    link = F.concat(
        F.lit("["), text_or_empty("title"), F.lit("](./"), document_filename("pmid", "authors"), F.lit(")")
    )
    return joined.select(
        F.col("domain").alias("page"),
        F.col("pmid").alias("order"),
        table_row(
            "pmid",
            link,
            "study_design",
            F.when(F.col("n").isNotNull(), thousands("n")).otherwise(F.lit(fixed.NONE_CELL)),
            strength_cell("grade", "score"),
            key,
        ).alias("line"),
    )


def topic_summary(records: DataFrame, topics: DataFrame) -> DataFrame:
    """Papers per topic by what was read; an empty topic keeps its row."""
    counts = records.groupBy(F.col("domain").alias("slug")).agg(
        F.count("*").alias("papers"), F.count_if(F.col("basis") == "full_text").alias("full_text")
    )
    joined = topics.select("ord", "slug", "title", "scope").join(counts, "slug", "full_outer")
    zero = F.lit(0).cast("long")
    return joined.select(
        "ord",
        "slug",
        text_or_empty("title").alias("title"),
        text_or_empty("scope").alias("scope"),
        F.coalesce("papers", zero).alias("papers"),
        F.coalesce("full_text", zero).alias("full_text"),
        (F.coalesce("papers", zero) - F.coalesce("full_text", zero)).alias("abstract_only"),
    )


# --- root page (B8, F5) -------------------------------------------------------------------------

FUNNEL = ("found", "unique", "screened", "included", "curated", "full text fetched", "extracted", "emitted")


def funnel(
    queries: DataFrame, unique: DataFrame, verdicts: DataFrame, placed: DataFrame, texts: DataFrame, readings: DataFrame, records: DataFrame
) -> DataFrame:
    """``(ord, stage, papers)``: how many papers every stage held."""
    counts = [
        queries.agg(F.coalesce(F.sum("retrieved"), F.lit(0)).alias("papers")),
        unique.agg(F.count("*").alias("papers")),
        verdicts.agg(F.count("*").alias("papers")),
        verdicts.agg(F.count_if("include").alias("papers")),
        placed.agg(F.count("*").alias("papers")),
        texts.agg(F.count_if(F.col("basis") == "full_text").alias("papers")),
        readings.agg(F.count("*").alias("papers")),
        records.agg(F.count("*").alias("papers")),
    ]
    out = None
    for i, (stage, count) in enumerate(zip(FUNNEL, counts)):
        row = count.select(F.lit(i).alias("ord"), F.lit(stage).alias("stage"), F.col("papers").cast("long").alias("papers"))
        out = row if out is None else out.unionByName(row)
    return out


def root_index(summary: DataFrame, stages: DataFrame, ledger: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Topics, funnel, cost and warnings as one page's lines.

    ``ledger`` is the grand total of the cost ledger.
    """
    topics = summary.select(
        F.lit(1).alias("part"),
        F.struct(F.coalesce("ord", F.lit(2**31 - 1)).cast("long").alias("o"), F.col("slug").alias("s")).alias("order"),
        table_row(
            F.concat(F.lit("["), F.col("slug"), F.lit("]("), F.col("slug"), F.lit(f"/{fixed.INDEX_FILENAME})")),
            "title",
            F.col("papers").cast("string"),
            F.col("full_text").cast("string"),
            F.col("abstract_only").cast("string"),
            "scope",
        ).alias("line"),
    )
    corpus = stages.select(
        F.lit(2).alias("part"),
        F.struct(F.col("ord").cast("long").alias("o"), F.lit("").alias("s")).alias("order"),
        table_row("stage", thousands("papers")).alias("line"),
    )
    out = topics.unionByName(corpus).unionByName(cost_lines(ledger))
    if warnings is not None:
        out = out.unionByName(
            warnings.select(
                F.lit(4).alias("part"),
                F.struct(F.col("seq").cast("long").alias("o"), F.lit("").alias("s")).alias("order"),
                F.concat(F.lit("- "), inline("message")).alias("line"),
            )
        )
    return out.select(F.lit(fixed.INDEX_FILENAME).alias("page"), "part", "order", "line")


def cost_lines(ledger: DataFrame) -> DataFrame:
    """Model calls, tokens and spend of a ledger's total."""
    tokens = F.concat(
        thousands(F.col("prompt_tokens") + F.col("completion_tokens")),
        F.lit(" ("),
        thousands("prompt_tokens"),
        F.lit(" in / "),
        thousands("completion_tokens"),
        F.lit(" out)"),
    )
    facts = F.array(
        F.struct(F.lit(0).cast("long").alias("o"), F.concat(F.lit("- **Model calls** — "), thousands("calls")).alias("line")),
        F.struct(F.lit(1).cast("long").alias("o"), F.concat(F.lit("- **Tokens** — "), tokens).alias("line")),
        F.struct(
            F.lit(2).cast("long").alias("o"),
            F.concat(F.lit("- **Spend** — "), format_cost("usd", "calls", "unpriced_calls")).alias("line"),
        ),
    )
    return ledger.select(F.inline(facts)).select(
        F.lit(3).alias("part"), F.struct("o", F.lit("").alias("s")).alias("order"), "line"
    )


# --- predictor page (B9) ----------------------------------------------------------------------------


def predictor_index(groups: DataFrame, outcomes: DataFrame, sites: DataFrame) -> DataFrame:
    """The cross-topic page as lines: predictor, outcome, and one line per site.

    ``sites`` carries ``group`` and ``outcome_label``.  Nothing is gathered: the three
    levels are unioned and ordered by their shared keys.
    """
    g = groups.select("group", F.col("order").alias("g_order"))
    o = outcomes.select("group", "outcome_label", F.col("order").alias("o_order"))
    topics = F.when(
        F.size("topics") > 0,
        F.concat(F.size("topics").cast("string"), F.lit(" topic(s): "), F.array_join("topics", ", ")),
    ).otherwise(F.lit("no topic"))
    summary = F.concat_ws(
        " · ",
        F.concat(F.col("papers").cast("string"), F.lit(" paper(s)")),
        F.concat(F.col("rows").cast("string"), F.lit(" row(s)")),
        topics,
    )
    counted = F.when(
        F.size("surface_forms") > 1,
        F.concat(
            F.lit("Counted as one: "),
            F.array_join(F.transform("surface_forms", lambda f: F.concat(F.lit("*"), f, F.lit("*"))), " · "),
        ),
    )
    no_outcome = outcomes.limit(0).select(F.col("order").alias("o_order"))
    blank_o = F.lit(None).cast(no_outcome.schema["o_order"].dataType)
    blank_s = F.lit(None).cast("struct<y:int,p:string,r:int>")
    heads = groups.select(
        "group",
        F.col("order").alias("g_order"),
        blank_o.alias("o_order"),
        blank_s.alias("s_order"),
        F.posexplode(
            F.array_compact(F.array(F.concat(F.lit("## "), inline("group")), summary, counted))
        ).alias("part", "line"),
    )
    marks = F.when(F.col("contested"), F.lit(f"  {fixed.CONTESTED_MARK}")).otherwise("")
    tally = F.concat(F.col("papers").cast("string"), F.lit(" paper(s) — "), direction_line(), marks)
    heading = F.when(F.col("outcome_label") == "", F.lit("outcome not recorded")).otherwise(F.col("outcome_label"))
    mids = (
        outcomes.select(
            "group",
            F.col("order").alias("o_order"),
            blank_s.alias("s_order"),
            F.posexplode(F.array(F.concat(F.lit("### → "), inline(heading)), tally)).alias("part", "line"),
        )
        .join(g, "group")
        .select("group", "g_order", "o_order", "s_order", "part", "line")
    )
    measured = F.when(
        strip(text_or_empty("operationalization")) != "",
        F.concat(F.col("predictor"), F.lit(" — "), F.col("operationalization")),
    ).otherwise(F.col("predictor"))
    name = F.regexp_replace(F.substring_index("file", "/", -1), r"\.md$", "")
    order = site_order()
    rows = (
        sites.join(g, "group")
        .join(o, ["group", "outcome_label"])
        .select(
            "group",
            "g_order",
            "o_order",
            F.struct(
                order["y"].cast("int").alias("y"), order["p"].alias("p"), order["r"].cast("int").alias("r")
            ).alias("s_order"),
            F.lit(0).alias("part"),
            table_row(
                F.concat(F.lit("["), name, F.lit("]("), F.col("file"), F.lit(")")),
                F.col("row").cast("string"),
                "domain",
                measured,
                "direction",
                "effect",
                strength_cell("row_grade", "row_score"),
            ).alias("line"),
        )
    )
    return heads.unionByName(mids).unionByName(rows)


def page_text(lines: DataFrame) -> DataFrame:
    """The lines in page order, ready for a text sink; a range sort, not a gathering."""
    return lines.orderBy("g_order", "o_order", "s_order", "part").select("line")


# --- search report and log (B10, B11) ---------------------------------------------------------------


def search_report(queries: DataFrame, retmax: int) -> DataFrame:
    """One row per query: what was asked, what the service ran, what came back."""
    held = F.col("count") - F.col("retrieved")
    cap = F.lit(fixed.SEARCH_CAP.format(retmax) if retmax else "")
    every = F.concat(thousands("count"), F.lit(fixed.ALL_MATCHED), thousands("retrieved"), F.lit(fixed.ALL_RETRIEVED))
    other, unseen = (F.lit(x) for x in fixed.NEVER_SEEN)
    some = F.concat(thousands("count"), F.lit(fixed.SOME_MATCHED), thousands("retrieved"), F.lit(fixed.SOME_RETRIEVED), cap, other, thousands(held), unseen)
    result = F.when(F.col("count") == 0, F.lit(fixed.NOTHING_MATCHED)).when(F.col("retrieved") >= F.col("count"), every).otherwise(some)
    return queries.select(
        "*",
        result.alias("result"),
        expansion_is_mechanical("term", "translation", "suspect").alias("mechanical"),
        (F.col("count") > retmax).alias("capped") if retmax else F.lit(False).alias("capped"),
    )


def search_totals(report: DataFrame) -> DataFrame:
    """Exact against capped queries, hits and flags."""
    return report.agg(
        F.count("*").alias("queries"),
        F.sum("count").alias("matched"),
        F.sum("retrieved").alias("retrieved"),
        F.count_if("capped").alias("capped"),
        F.count_if(~F.col("capped")).alias("exact"),
        F.count_if("suspect").alias("suspect"),
        F.count_if(F.col("count") == 0).alias("empty"),
    )


def build_log(queries: DataFrame, stages: DataFrame, ledger: DataFrame, warnings: DataFrame) -> DataFrame:
    """Queries, stages, cost and warnings as one page's lines."""
    note = F.when(
        F.col("suspect"),
        F.when(text_or_empty("note") != "", F.concat(F.lit("suspect — "), F.col("note"))).otherwise(
            F.lit("suspect: the service rewrote the term")
        ),
    ).otherwise(text_or_empty("note"))
    asked = queries.select(
        F.lit(1).alias("part"),
        F.struct(F.col("ord").cast("long").alias("o"), F.lit("").alias("s")).alias("order"),
        table_row(
            (F.col("ord") + 1).cast("string"), "term", thousands("count"), F.col("retrieved").cast("string"), note
        ).alias("line"),
    )
    rows = stages.select(
        F.lit(2).alias("part"),
        F.struct(F.col("ord").cast("long").alias("o"), F.lit("").alias("s")).alias("order"),
        table_row("stage", thousands("papers")).alias("line"),
    )
    notes = warnings.select(
        F.lit(4).alias("part"),
        F.struct(F.col("seq").cast("long").alias("o"), F.lit("").alias("s")).alias("order"),
        F.concat(F.lit("- "), inline("message")).alias("line"),
    )
    return (
        asked.unionByName(rows)
        .unionByName(cost_lines(ledger))
        .unionByName(notes)
        .select(F.lit("log.md").alias("page"), "part", "order", "line")
    )


def empty_query_report(queries: DataFrame) -> DataFrame:
    """How many searches found nothing, and whether that was all of them."""
    return queries.agg(
        F.count("*").alias("queries"), F.count_if(F.col("count") == 0).alias("empty")
    ).withColumn(
        "state",
        F.when((F.col("empty") == 0) | (F.col("queries") == 0), F.lit("none empty"))
        .when(F.col("empty") == F.col("queries"), F.lit("all empty"))
        .otherwise(F.lit("some empty")),
    )


# --- corpus statistics (F22) ----------------------------------------------------------------------------


def corpus_statistics(records: DataFrame, findings: DataFrame, nulls: DataFrame) -> DataFrame:
    """Documents, finding rows, papers that report a null, permissive licences."""
    one = F.lit(1)
    docs = records.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("basis") == "full_text").alias("full_text"),
        F.count_if(is_export_safe("license")).alias("permissive"),
    ).withColumn("_k", one)
    rows = findings.agg(F.count("*").alias("rows")).withColumn("_k", one)
    reported = nulls.filter(~is_sentinel("predictor")).agg(F.count_distinct("pmid").alias("with_nulls")).withColumn("_k", one)
    return docs.join(rows, "_k").join(reported, "_k").drop("_k")


__all__ = [
    "build_log",
    "corpus_statistics",
    "cost_lines",
    "empty_query_report",
    "funnel",

    "page_text",
    "predictor_index",
    "root_index",
    "search_report",
    "search_totals",
    "topic_index",
    "topic_summary",
]
