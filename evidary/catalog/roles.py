"""The given tables in the roles the operators work on.

Each role is a projection of whole tables; ``roles_sql`` states the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evidary.functions.text import code_array_map, slugify
from evidary.operators.placement import Bounds

PAIRS = ("AF", "AO", "NF", "NO", "RF", "RO")
TERMS = ("AF1", "AO2", "NF3", "NO4", "RF5")
NOW_YEAR = 2026
POOL_SIZE = 60
BOUNDS = Bounds(floor=20, ceiling=60, target=150)
SAMPLE_SCALE = (500, 4000)
DESIGNS = {
    "1-URGENT": "randomized_trial",
    "2-HIGH": "prospective_cohort",
    "3-MEDIUM": "case_control",
    "4-NOT SPECIFIED": "unclear",
    "5-LOW": "cross_sectional",
}
LICENSES = {"F": "CC BY", "O": "cc-by-nc", "P": ""}
MEASURES = {"A": "OR", "N": "HR", "R": "mean difference"}
CONFIDENCE = {"A": "high", "N": "medium", "R": "low"}
EVIDENCE = {
    "A": "observational_association",
    "N": "randomized_intervention",
    "R": "outcome_definition",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, read in the splits that the scan's settings make at every size."""
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def pick(pairs: dict[str, str], key: str) -> Column:
    return F.element_at(code_array_map(pairs), F.col(key))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as topics."""
    return table(spark, sf, "region").select(
        F.col("r_regionkey").alias("ord"),
        slugify("r_name").alias("slug"),
        F.col("r_name").alias("title"),
        F.concat(F.lit("papers about "), F.lower("r_name")).alias("scope"),
        F.array(F.lower("r_name"), F.lit("small"), F.lit("medium")).alias("seed_terms"),
    )


def plan(spark: SparkSession, sf: str) -> DataFrame:
    """One search per region."""
    names = F.array(*[F.lit(t) for t in TERMS])
    return topics(spark, sf).select(
        "ord", F.get(names, F.col("ord")).alias("term"), F.col("slug").alias("topic")
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as search hits on parts: which search found a part, at which rank."""
    pair = F.concat("l_returnflag", "l_linestatus")
    place = F.array_position(F.array(*[F.lit(t) for t in PAIRS]), pair) - 1
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("pmid"),
        F.concat(pair, F.col("l_linenumber").cast("string")).alias("term"),
        (place * 7 + F.col("l_linenumber")).cast("int").alias("term_ord"),
        F.col("l_quantity").cast("int").alias("rank"),
    )


def part_records(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as bibliographic records."""
    promo = F.col("p_type") == "PROMO"
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("pmid"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand").alias("title"),
        F.when(F.col("p_size") == 2, F.lit("")).otherwise(F.col("p_name")).alias("abstract"),
        F.col("p_brand").alias("journal"),
        (F.col("p_size") + 1976).cast("int").alias("year"),
        F.when(F.col("p_type").isin("LARGE", "PROMO"), F.concat(F.lit("PMC"), F.col("p_partkey").cast("string"))).alias("pmcid"),
        F.lit(None).cast("string").alias("doi"),
        F.when(promo, F.array(F.lit("Editorial"))).otherwise(F.array(F.lit("Journal Article"))).alias("publication_types"),
        F.array(F.lower("p_type")).alias("mesh_terms"),
        F.array("p_brand").alias("keywords"),
        F.when(F.col("p_type") == "SMALL", F.lit("book")).otherwise(F.lit("journal")).alias("source_type"),
        ((F.col("p_type") == "ECONOMY") & (F.col("p_size") == 1)).alias("is_retracted"),
        F.col("p_partkey").alias("seq"),
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Citation metrics of the parts that sold dearly; no ratio where a line had no discount."""
    cents = F.round(F.col("l_discount") * 100).cast("long")
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("pmid"))
        .agg(
            F.count("*").alias("citation_count"),
            F.sum(cents).alias("_cents"),
            F.min(cents).alias("_low"),
            F.max("l_extendedprice").alias("_dear"),
            F.count_if(F.col("l_returnflag") == "R").alias("_returned"),
        )
        .filter(F.col("_dear") > 90000)
        .select(
            "pmid",
            "citation_count",
            F.when(F.col("_low") > 0, F.col("_cents") * 0.3 / F.col("citation_count")).alias("relative_citation_ratio"),
            (F.col("_returned") < 10).alias("is_research_article"),
        )
    )


def document_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as papers, with labels as retractions."""
    toxic = table(spark, sf, "labels").select("doc_id", F.col("toxic"))
    size = F.col("n_chars")
    found = F.array_compact(
        F.array(F.col("source"), F.when(size > 400, F.col("lang")), F.when(size > 800, F.lit("long")))
    )
    return (
        table(spark, sf, "documents")
        .join(toxic, "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("pmid"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("abstract"),
            F.col("source").alias("journal"),
            (F.lit(1990) + size % 36).cast("int").alias("year"),
            F.when(F.col("lang") == "en", F.concat(F.lit("PMC"), F.col("doc_id").cast("string"))).alias("pmcid"),
            F.lit(None).cast("string").alias("doi"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_retracted"),
            found.alias("found_by"),
            (size % 50).cast("int").alias("best_rank"),
            F.col("doc_id").alias("seq"),
            "lang",
        )
    )


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as findings of a paper (the order)."""
    # Rows are numbered by the paper's key as it is given on, so that later groups by it find them together.
    w = Window.partitionBy("pmid").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    q = F.col("l_quantity").cast("int")
    d = F.round(F.col("l_discount") * 100).cast("int")
    t = F.round(F.col("l_tax") * 100).cast("int")
    stated = F.col("t") < 8
    direction = (
        F.when(F.col("l_linestatus") == "F", "increases")
        .when(F.col("l_returnflag") == "R", "decreases")
        .when(F.col("l_returnflag") == "N", "none")
        .otherwise("unclear")
    )
    lo, hi = (F.col("q") - F.col("d")) / 10.0, (F.col("q") + F.col("d") + F.col("t")) / 10.0
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    printed = F.when(F.col("l_linestatus") == "F", F.col("q")).otherwise(F.col("q") + 1) / 10.0
    return (
        table(spark, sf, "lineitem")
        .withColumn("pmid", F.col("l_orderkey").cast("string"))
        .withColumn("row", F.row_number().over(w))
        .withColumn("q", q)
        .withColumn("d", d)
        .withColumn("t", t)
        .join(names, "l_partkey")
        .repartition("pmid")
        .select(
            "pmid",
            "row",
            F.col("p_name").alias("predictor"),
            F.when(F.col("t") == 0, F.lit("")).otherwise(F.concat(F.lower("p_type"), F.lit(" outcome"))).alias("outcome"),
            F.lower("p_type").alias("operationalization"),
            F.concat(F.lit("wave "), F.col("l_linenumber").cast("string")).alias("timing"),
            pick(EVIDENCE, "l_returnflag").alias("evidence_type"),
            F.when(stated, F.col("q") / 10.0).alias("effect"),
            pick(MEASURES, "l_returnflag").alias("effect_measure"),
            F.when(
                stated,
                F.format_string("%.1f (95%% CI %.1f to %.1f)", F.col("q") / 10.0, lo, hi),
            ).otherwise("").alias("effect_raw"),
            F.when(stated, lo).alias("ci_low"),
            F.when(stated, hi).alias("ci_high"),
            F.concat(F.lit("0.0"), F.col("d").cast("string")).alias("p_value"),
            direction.alias("direction"),
            pick(CONFIDENCE, "l_returnflag").alias("confidence"),
            F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False).alias("adjusted"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Nobody wrote of "), F.col("p_name")))
            .otherwise(F.format_string("In wave %d row %d the %s", "l_linenumber", "row", "p_name"))
            .alias("quote"),
            F.format_string(
                "In wave %d row %d the %s effect was %.1f (95%% CI %.1f to %.1f; p = 0.0%d).",
                "l_linenumber",
                "row",
                "p_name",
                printed,
                lo,
                hi,
                "d",
            ).alias("sentence"),
            "d",
        )
    )


def source_texts(rows: DataFrame) -> DataFrame:
    """A paper's text from its findings' sentences, one line each after a heading."""
    lines = F.array_sort(F.collect_list(F.struct("row", "sentence")))
    return rows.groupBy("pmid").agg(
        F.concat(F.lit("## RESULTS\n"), F.array_join(F.transform(lines, lambda s: s["sentence"]), "\n")).alias("text")
    )


def order_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as papers, filed under their customer's region."""
    place = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), "c_name", slugify("r_name").alias("domain"))
    )
    key = F.col("o_orderkey").cast("string")
    return (
        table(spark, sf, "orders")
        .join(place, "o_custkey")
        .select(
            key.alias("pmid"),
            F.concat(F.lit("Study | of order "), key).alias("title"),
            F.concat(F.lit('A "short" note on order '), key).alias("description"),
            F.lit("Orders Weekly").alias("journal"),
            F.lit("").alias("journal_abbrev"),
            F.year("o_orderdate").alias("year"),
            F.array(F.concat("c_name", F.lit(" AB")), F.lit("Li C")).alias("authors"),
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("PMC"), key)).alias("pmcid"),
            F.lit("").alias("doi"),
            "domain",
            pick(DESIGNS, "o_orderpriority").alias("design"),
            F.lower("o_orderpriority").alias("study_design"),
            F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 100).cast("int")).alias("n"),
            F.when(F.col("o_orderstatus") == "F", F.lit("full_text")).otherwise(F.lit("abstract")).alias("basis"),
            pick(LICENSES, "o_orderstatus").alias("license"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>"))
            .otherwise(F.array(F.lit("age")))
            .alias("adjusted_for"),
            F.array(F.lower("o_orderstatus"), F.lit("orders")).alias("tags"),
            F.concat(F.lit("Order "), key, F.lit(" was placed. It shipped.")).alias("bottom_line"),
            F.lit("customers").alias("population"),
            F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.lit("delivery")).alias("outcome_definition"),
            F.when(F.col("o_orderstatus") == "O", F.lit("Small sample.")).otherwise(F.lit("")).alias("caveats"),
            F.concat(F.lit("# Aim: order.\n\nMethods: "), F.lower("o_orderpriority")).alias("abstract"),
            F.lit("evidary").alias("generated_by"),
            F.col("o_orderdate").alias("generated_at"),
        )
    )


def interactions(rows: DataFrame, *more: str) -> DataFrame:
    """Each finding states a relation to the paper's next finding; ``more`` are columns of the finding to keep."""
    w = Window.partitionBy("pmid").orderBy("row")
    kinds = F.array(
        *[F.lit(k) for k in ("correlated", "modifies", "confounds", "mediates", "derived_from", "mutually_exclusive")]
    )
    return (
        rows.withColumn("feature", F.lead("predictor").over(w))
        .filter(F.col("feature").isNotNull())
        .select(
            "pmid",
            "row",
            F.lit(1).alias("seq"),
            "feature",
            F.get(kinds, F.least(F.col("d"), F.lit(5))).alias("kind"),
            F.when(F.col("d") > 0, F.lit("Pearson r")).otherwise("").alias("measure"),
            F.when(F.col("d") > 0, F.col("d") / 10.0).alias("value"),
            F.when(F.col("d") > 0, F.format_string("r = %.1f", F.col("d") / 10.0)).otherwise("").alias("measure_raw"),
            F.lit(False).alias("mirrored"),
            *more,
        )
    )


def null_findings(rows: DataFrame) -> DataFrame:
    """Findings of no direction as null findings; a sentinel for every other first row."""
    null = F.col("direction") == "none"
    return rows.filter(null | (F.col("row") == 1)).select(
        "pmid",
        F.col("row").alias("seq"),
        F.when(null, F.col("predictor")).otherwise("None reported ").alias("predictor"),
        F.when(null, F.col("outcome")).otherwise("").alias("outcome"),
        F.when(null, F.col("timing")).otherwise("").alias("detail"),
        F.when(null, F.col("quote")).otherwise("").alias("quote"),
    )


def codes(rows: DataFrame) -> DataFrame:
    """Vocabulary codes: the printed effect as a code of the finding's variable."""
    return rows.filter(F.col("effect").isNotNull()).select(
        "pmid",
        F.col("row").alias("seq"),
        F.col("predictor").alias("concept"),
        F.lit("ICD-10").alias("system"),
        F.format_string("%.1f", "effect").alias("code"),
    )


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as screened papers: segment decides inclusion, balance the relevance."""
    place = (
        table(spark, sf, "nation")
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("c_nationkey"), slugify("r_name").alias("slug"))
    )
    balance = F.col("c_acctbal")
    relevance = F.when(balance > 7500, 3).when(balance > 4500, 2).when(balance > 1500, 1).otherwise(0)
    segment = F.col("c_mktsegment")
    return (
        table(spark, sf, "customer")
        .join(F.broadcast(place), "c_nationkey")
        .select(
            F.col("c_custkey").cast("string").alias("pmid"),
            (segment != "MACHINERY").alias("include"),
            relevance.alias("relevance"),
            F.when(segment == "AUTOMOBILE", F.lit("not a topic")).otherwise(F.col("slug")).alias("topic"),
            F.when(segment == "HOUSEHOLD", F.lit("low")).otherwise(F.lit("medium")).alias("confidence"),
            F.col("c_acctbal").alias("score"),
            F.col("c_name").alias("name"),
            segment.alias("segment"),
            F.col("slug").alias("region"),
        )
    )


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as model calls: errors stand for calls nobody could price."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("role"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("usd"),
        k.alias("prompt_tokens"),
        (k * 2).alias("completion_tokens"),
        F.col("ts").alias("at"),
    )
