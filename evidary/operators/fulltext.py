"""The exact text a paper is read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidary import fixed
from evidary.functions.text import col, strings, strip, text_or_empty
from evidary.operators.common import top_rows


def content_sections(sections: DataFrame) -> DataFrame:
    """Sections without references, funding, and the like (D3)."""
    return sections.filter(~F.col("section_type").isin(*fixed.NON_CONTENT_SECTIONS))


def section_priority(section_type: Column | str, passage_type: Column | str) -> Column:
    """Where the evidence is, best first; a caption counts by its passage type."""
    names = fixed.SECTION_PRIORITY
    kind, passage = F.upper(text_or_empty(section_type)), F.lower(text_or_empty(passage_type))
    by_kind = F.array_position(strings(names), kind).cast("int") - 1
    by_passage = F.lit(len(names))
    for i in range(len(names) - 1, -1, -1):
        by_passage = F.when(F.contains(passage, F.lit(names[i].lower())), F.lit(i)).otherwise(by_passage)
    return F.when(by_kind >= 0, by_kind).otherwise(by_passage)


def section_cost(section_type: Column | str, text: Column | str) -> Column:
    return F.length(col(text)) + F.length(text_or_empty(section_type)) + fixed.SECTION_OVERHEAD


def select_sections(sections: DataFrame, budget: int = fixed.MAX_SOURCE_CHARS) -> DataFrame:
    """Fit each document's sections into the budget by priority.

    A section that does not fit is skipped and the walk goes on.  Returns the kept
    sections with ``truncated``, true when any section of the document was skipped.

    Exact pruning first: when a section is kept, every earlier section of at most its
    cost was kept too.  So of the sections of one cost only the first ``budget / cost``
    can be kept, and what a document's walk has to look at is bounded by the budget,
    however many sections the document has.
    """
    sized = sections.filter(text_or_empty("text") != "").select(
        "pmcid",
        "seq",
        section_priority("section_type", "passage_type").alias("priority"),
        section_cost("section_type", "text").alias("cost"),
    )
    smallest = 1 + fixed.SECTION_OVERHEAD
    fitting = top_rows(
        sized.filter(F.col("cost") <= budget),
        ["pmcid", "cost"],
        ["priority", "seq"],
        max(1, budget // smallest),
        ["pmcid", "seq"],
    ).filter(F.col("rn") * F.col("cost") <= budget)
    order = F.array_sort(F.collect_list(F.struct("priority", "seq", "cost")))
    start = F.struct(F.lit(0).alias("spent"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, c: Column) -> Column:
        fits = s["spent"] + c["cost"] <= budget
        return F.struct(
            F.when(fits, s["spent"] + c["cost"]).otherwise(s["spent"]).alias("spent"),
            F.when(fits, F.array_append(s["kept"], c["seq"].cast("int"))).otherwise(s["kept"]).alias("kept"),
        )

    kept = (
        fitting.groupBy("pmcid")
        .agg(order.alias("_w"))
        .select("pmcid", F.explode(F.aggregate("_w", start, step, lambda s: s["kept"])).alias("seq"))
    )
    totals = sized.groupBy("pmcid").agg(F.count("*").alias("_all"))
    counts = kept.groupBy("pmcid").agg(F.count("*").alias("_kept"))
    flags = totals.join(counts, "pmcid").select("pmcid", (F.col("_kept") < F.col("_all")).alias("truncated"))
    return sections.join(kept, ["pmcid", "seq"], "left_semi").join(flags, "pmcid")


def header(title: Column | str, venue: Column | str, year: Column | str, basis: str, license_: Column) -> Column:
    """The lines that open every text: title, place, and what was read."""
    where = F.array_join(
        F.filter(
            F.array(text_or_empty(venue), F.coalesce(F.nullif(col(year), F.lit(0)).cast("string"), F.lit(""))),
            lambda p: p != "",
        ),
        " ",
    )
    lines = F.array(
        F.concat(F.lit("Title: "), F.coalesce(F.nullif(text_or_empty(title), F.lit("")), F.lit("(untitled)"))),
        F.when(where != "", F.concat(F.lit("Published in: "), where)),
        F.concat(
            F.lit(f"Read from: {basis}"),
            F.when(license_ != "", F.concat(F.lit(", license "), license_)).otherwise(""),
        ),
    )
    return F.array_join(F.array_compact(lines), "\n")


def section_block(section_type: Column | str, text: Column | str) -> Column:
    kind = F.coalesce(F.nullif(text_or_empty(section_type), F.lit("")), F.lit("TEXT"))
    return F.concat(F.lit("## "), kind, F.lit("\n"), col(text))


def paper_texts(papers: DataFrame, sections: DataFrame, budget: int = fixed.MAX_SOURCE_CHARS) -> DataFrame:
    """What each paper is read from: its full text, or its abstract.

    ``papers`` needs ``pmid``, ``title``, ``venue``, ``year``, ``abstract``, ``pmcid``.  The
    text kept per paper is bounded by the budget before it is gathered.
    """
    content = content_sections(sections)
    chosen = select_sections(content, budget)
    blocks = F.array_sort(
        F.collect_list(
            F.struct(
                "seq",
                section_block("section_type", "text").alias("block"),
                F.coalesce(F.nullif(F.col("section_type"), F.lit("")), F.lit("TEXT")).alias("kind"),
            )
        )
    )
    documents = chosen.groupBy("pmcid").agg(
        blocks.alias("_b"), F.max("license").alias("license"), F.max("truncated").alias("truncated")
    )
    chars = content.groupBy("pmcid").agg(F.sum(F.length("text")).alias("doc_chars"))
    full = documents.join(chars, "pmcid").select(
        "pmcid",
        F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n").alias("body"),
        F.transform("_b", lambda b: b["kind"]).alias("sections"),
        "license",
        "truncated",
        "doc_chars",
    )
    abstract = strip(text_or_empty("abstract"))
    abstract = F.when(abstract == "", F.lit("(no abstract available)")).otherwise(abstract)
    has = F.col("body").isNotNull()
    license_ = text_or_empty("license")
    text = F.when(
        has,
        F.concat(header("title", "venue", "year", "full text (PMC)", license_), F.lit("\n\n"), F.col("body")),
    ).otherwise(
        F.concat(
            header("title", "venue", "year", "abstract only", F.lit("")), F.lit("\n\n## ABSTRACT\n"), abstract
        )
    )
    # Papers without a full-text id get a key of their own, so they spread over the join.
    keyed = papers.withColumn("_k", F.coalesce("pmcid", F.concat(F.lit("#"), F.col("pmid"))))
    return keyed.join(full.withColumnRenamed("pmcid", "_k"), "_k", "left").select(
        "pmid",
        text_or_empty("pmcid").alias("pmcid"),
        F.when(has, F.lit("full_text")).otherwise(F.lit("abstract")).alias("basis"),
        F.when(has, license_).otherwise(F.lit("")).alias("license"),
        text.alias("text"),
        F.coalesce("sections", F.array().cast("array<string>")).alias("sections"),
        F.coalesce("doc_chars", F.length(abstract).cast("long")).alias("source_chars"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )




__all__ = [
    "content_sections",
    "header",
    "paper_texts",
    "section_block",
    "section_cost",
    "section_priority",
    "select_sections",
]
