"""What recurs across papers: phrase clusters and two-level groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidary import fixed
from evidary.functions.text import inline, number_set, strings, surface_key, without_thresholds
from evidary.session import durable

SEP = "\u0001"


def _rank_of(form: str = "form") -> Column:
    """Commonest, then shortest, then alphabetical."""
    return F.struct(
        (-F.col("n")).alias("n"), F.length(form).alias("len"), F.col(form).alias("form")
    )


def _label_parts() -> list[Column]:
    """Combinable aggregates from which a cluster's label follows."""
    rank = _rank_of()
    return [
        F.min(rank)["form"].alias("_first"),
        F.min(F.when(F.col("numbers") == "", rank))["form"].alias("_bare"),
        F.min("numbers").alias("_low"),
        F.max("numbers").alias("_high"),
    ]


def _label() -> Column:
    """The first form, unless the forms disagree on a number: then one without, or none printed."""
    return F.when(F.col("_low") == F.col("_high"), F.col("_first")).otherwise(
        F.coalesce("_bare", without_thresholds("_first"))
    )


def surface_forms(df: DataFrame, text: str, scope: list[str], ord: str) -> DataFrame:
    """Distinct written forms with their counts, keys and first place.

    Rows are counted by the text as it is, and only distinct texts are brought into their form.
    """
    texts = df.groupBy(*scope, F.col(text).alias("_text")).agg(F.count("*").alias("_n"), F.min(ord).alias("_ord"))
    return (
        texts.withColumn("form", inline("_text"))
        .filter(F.col("form") != "")
        .groupBy(*scope, "form")
        .agg(F.sum("_n").alias("n"), F.min("_ord").alias("first"))
        .withColumn("tokens", surface_key("form"))
        .withColumn("key", F.array_join("tokens", SEP))
        # A phrase whose words all fold away stands for itself alone.
        .withColumn("seed", F.when(F.col("key") == "", F.lower("form")).otherwise(F.col("key")))
        .withColumn("numbers", number_set("form"))
    )


def absorption_edges(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs of keys that differ by exactly one harmless word (E14): ``(scope, small, large)``.

    Each key minus one word is looked up among the keys: an equi-join, at most one match
    per removed word, never a comparison of all pairs.
    """
    refused = strings(fixed.POLARITY_WORDS + fixed.INTERVENTION_WORDS)
    keyed = nodes.filter(F.col("key") != "")
    shorter = (
        keyed.filter(F.size("tokens") > 1)
        .select(*scope, F.col("seed").alias("large"), "tokens", F.explode("tokens").alias("word"))
        .filter((F.length("word") > 2) & ~F.array_contains(refused, F.col("word")))
        .select(*scope, "large", F.array_join(F.array_remove("tokens", F.col("word")), SEP).alias("key"))
    )
    return shorter.join(keyed.select(*scope, "key", F.col("seed").alias("small")), [*scope, "key"]).select(
        *scope, "small", "large"
    )


def cluster_phrases(df: DataFrame, text: str, ord: str, scope: list[str] = ()) -> DataFrame:
    """``(scope, form, n, first, label, cluster)`` for every written form (H9).

    Clusters are walked commonest first and each is taken in by the first accepted
    neighbour, never through a chain.  Set-wise: a cluster is accepted once every earlier
    neighbour is known not to be; it is taken in once any earlier neighbour is accepted.
    Every round decides at least the earliest open cluster.
    """
    scope = list(scope)
    forms = durable(surface_forms(df, text, scope, ord))
    nodes = durable(
        forms.groupBy(*scope, "seed")
        .agg(
            F.sum("n").alias("total"),
            F.min("first").alias("first"),
            F.min_by(F.struct("key", "tokens"), "first").alias("_k"),
            *_label_parts(),
        )
        .withColumn("key", F.col("_k.key"))
        .withColumn("tokens", F.col("_k.tokens"))
        .withColumn("order", F.struct((-F.col("total")).alias("t"), _label().alias("l"), F.col("first").alias("f")))
        .select(*scope, "seed", "key", "tokens", "order")
    )
    pairs = absorption_edges(nodes, scope)
    small = nodes.select(*scope, F.col("seed").alias("small"), F.col("order").alias("small_order"))
    large = nodes.select(*scope, F.col("seed").alias("large"), F.col("order").alias("large_order"))
    ranked = pairs.join(small, [*scope, "small"]).join(large, [*scope, "large"])
    small_first = F.col("small_order") < F.col("large_order")
    edges = durable(
        ranked.select(
            *scope,
            F.when(small_first, F.col("large")).otherwise(F.col("small")).alias("seed"),
            F.when(small_first, F.col("small")).otherwise(F.col("large")).alias("host"),
            F.when(small_first, F.col("small_order")).otherwise(F.col("large_order")).alias("host_order"),
        )
    )
    hosts = edges.select(*scope, F.col("host").alias("seed")).distinct()
    decided = durable(
        hosts.join(edges.select(*scope, "seed"), [*scope, "seed"], "left_anti").withColumn("accepted", F.lit(True))
    )
    # Decisions are appended: a round writes what it decides and rewrites nothing.
    while True:
        known = decided.withColumnRenamed("seed", "host")
        fresh = durable(
            edges.join(decided.select(*scope, "seed"), [*scope, "seed"], "left_anti")
            .join(known, [*scope, "host"], "left")
            .groupBy(*scope, "seed")
            .agg(
                F.bool_or(F.coalesce("accepted", F.lit(False))).alias("taken"),
                F.bool_and(F.col("accepted").isNotNull()).alias("settled"),
            )
            .filter("taken or settled")
            .select(*scope, "seed", (~F.col("taken")).alias("accepted"))
        )
        if fresh.isEmpty():
            break
        decided = decided.unionByName(fresh)
    accepted_hosts = decided.filter("accepted").select(*scope, F.col("seed").alias("host"))
    taken_in = (
        edges.join(accepted_hosts, [*scope, "host"])
        .join(decided.filter("not accepted").select(*scope, "seed"), [*scope, "seed"])
        .groupBy(*scope, "seed")
        .agg(F.min_by("host", "host_order").alias("host"))
    )
    members = forms.join(taken_in, [*scope, "seed"], "left").withColumn(
        "cluster", F.coalesce("host", "seed")
    )
    labels = (
        members.groupBy(*scope, "cluster")
        .agg(*_label_parts())
        .select(*scope, "cluster", _label().alias("label"))
    )
    return members.join(labels, [*scope, "cluster"]).select(*scope, "form", "n", "first", "label", "cluster")


def _forms_of(clusters: DataFrame, scope: list[str]) -> DataFrame:
    """The forms shown under a label: those of its first cluster, commonest first.

    Two clusters that end up with one label are one group, and the first one's forms stand
    for it.
    """
    lead = clusters.groupBy(*scope, "label").agg(F.min_by("cluster", "first").alias("cluster"))
    shown = clusters.join(lead, [*scope, "label", "cluster"])
    return shown.groupBy(*scope, "label").agg(
        F.transform(F.array_sort(F.collect_list(_rank_of())), lambda f: f["form"]).alias("surface_forms")
    )


def label_sites(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites with their predictor label, and the clusters behind the labels."""
    clusters = durable(cluster_phrases(sites, "predictor", "ord"))
    named = _labelled(sites, "predictor", clusters, [], "group", "inner")
    return named, clusters


def _labelled(sites: DataFrame, text: str, clusters: DataFrame, scope: list[str], name: str, how: str) -> DataFrame:
    """``sites`` with the label of their form as ``name``; each distinct text is brought into its form once."""
    forms = clusters.select(*scope, F.col("form").alias("_form"), F.col("label").alias(name))
    texts = sites.select(*scope, F.col(text).alias("_text")).distinct().withColumn("_form", inline("_text"))
    known = durable(texts.join(forms, [*scope, "_form"]).drop("_form"))
    return sites.withColumn("_text", F.col(text)).join(known, [*scope, "_text"], how).drop("_text")


def predictor_groups(named: DataFrame, clusters: DataFrame, min_papers: int = fixed.MIN_RECURRING_PAPERS) -> DataFrame:
    """One row per recurring predictor (F12, D9): papers, rows, topics in corpus order, forms."""
    counts = (
        named.groupBy("group")
        .agg(F.count_distinct("pmid").alias("papers"), F.count("*").alias("rows"))
        .filter(F.col("papers") >= min_papers)
    )
    topics = (
        named.filter(F.coalesce("domain", F.lit("")) != "")
        .groupBy("group", "domain")
        .agg(F.min("ord").alias("first"))
        .groupBy("group")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "domain"))), lambda t: t["domain"]).alias("topics"))
    )
    forms = _forms_of(clusters, []).withColumnRenamed("label", "group")
    return (
        counts.join(topics, "group", "left")
        .join(forms, "group", "left")
        .withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
        .withColumn("order", F.struct((-F.col("papers")).alias("p"), (-F.col("rows")).alias("r"), F.col("group").alias("g")))
    )


def outcome_groups(named: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes within each recurring predictor, and the sites with their outcome label.

    Clustered inside the predictor; an unnamed outcome is its own bucket (F12).
    """
    recurring = named.join(groups.select("group"), "group", "left_semi")
    has_outcome = inline(F.coalesce("outcome", F.lit(""))) != ""
    clusters = durable(cluster_phrases(recurring.filter(has_outcome), "outcome", "ord", ["group"]))
    labelled = _labelled(recurring, "outcome", clusters, ["group"], "outcome_label", "left")
    labelled = labelled.withColumn("outcome_label", F.coalesce("outcome_label", F.lit("")))
    histogram = [F.count_if(F.col("direction") == d).alias(f"n_{d}") for d in fixed.DIRECTIONS]
    outcomes = labelled.groupBy("group", "outcome_label").agg(
        F.count_distinct("pmid").alias("papers"), F.count("*").alias("rows"), *histogram
    )
    forms = _forms_of(clusters, ["group"]).withColumnRenamed("label", "outcome_label")
    outcomes = (
        outcomes.join(forms, ["group", "outcome_label"], "left")
        .withColumn("contested", (F.col("n_increases") > 0) & (F.col("n_decreases") > 0))
        .withColumn(
            "order",
            F.struct(
                (-F.col("papers")).alias("p"),
                (-F.col("rows")).alias("r"),
                (F.col("outcome_label") == "").alias("unnamed"),
                F.col("outcome_label").alias("o"),
            ),
        )
    )
    return outcomes, labelled


def site_order() -> Column:
    """Newest first, then paper, then row (H8)."""
    return F.struct(
        (-F.coalesce("year", F.lit(0))).alias("y"), F.col("pmid").alias("p"), F.col("row").alias("r")
    )


def direction_line() -> Column:
    """``increases (3) · decreases (1)``, commonest first, ties in the fixed order."""
    entries = F.array(
        *[
            F.struct((-F.col(f"n_{d}")).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("d"))
            for i, d in enumerate(fixed.DIRECTIONS)
        ]
    )
    present = F.array_sort(F.filter(entries, lambda e: e["n"] < 0))
    return F.array_join(
        F.transform(present, lambda e: F.concat(e["d"], F.lit(" ("), (-e["n"]).cast("string"), F.lit(")"))),
        " · ",
    )


def index_totals(named: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: recurring groups, predictors seen in one paper only, rows, papers."""
    every = named.agg(
        F.count_distinct("group").alias("labels"),
        F.count("*").alias("rows"),
        F.count_distinct("pmid").alias("papers"),
    )
    found = groups.agg(F.count("*").alias("groups"))
    one = every.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("once", F.col("labels") - F.col("groups")).drop("labels")
