"""Landed JSON replies of the bibliographic services, and JSONL logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidary import fixed
from evidary.functions.text import col, strip, text_or_empty

# --- search results -------------------------------------------------------------

_SEARCH = (
    "struct<esearchresult:struct<count:string,idlist:array<string>,querytranslation:string,"
    "errorlist:struct<fieldsnotfound:array<string>,phrasesnotfound:array<string>>,ERROR:string>>"
)


def parse_search_results(df: DataFrame, term: str = "term", raw: str = "raw") -> DataFrame:
    """One row per executed search (A11); an ``ERROR`` reply or a non-JSON body fails the job."""
    none = F.array().cast("array<string>")
    parsed = df.withColumn("_p", F.from_json(raw, _SEARCH))
    result = F.col("_p.esearchresult")
    count = F.coalesce(result["count"].cast("long"), F.lit(0).cast("long"))
    guarded = (
        F.when(
            F.col("_p").isNull() | ~F.ltrim(raw).startswith("{"),
            F.raise_error(F.concat(F.lit("search reply is not JSON: "), F.substring(raw, 1, 200))).cast("long"),
        )
        .when(
            result["ERROR"].isNotNull(),
            F.raise_error(F.concat(F.lit("search was rejected: "), result["ERROR"])).cast("long"),
        )
        .otherwise(count)
    )
    return parsed.select(
        F.col(term).alias("term"),
        guarded.alias("count"),
        F.coalesce(result["idlist"], none).alias("ids"),
        text_or_empty(result["querytranslation"]).alias("translation"),
        F.coalesce(result["errorlist"]["fieldsnotfound"], none).alias("fields_not_found"),
        F.coalesce(result["errorlist"]["phrasesnotfound"], none).alias("phrases_not_found"),
    )


def search_hits(results: DataFrame) -> DataFrame:
    """The hit edge ``(pmid, term, rank)``; the best rank when an id repeats."""
    return (
        results.select("term", F.posexplode("ids").alias("rank", "pmid"))
        .groupBy("pmid", "term")
        .agg(F.min("rank").alias("rank"))
    )


# --- cited-by links ---------------------------------------------------------------

_LINKS = (
    "struct<linksets:array<struct<ids:array<string>,"
    "linksetdbs:array<struct<linkname:string,links:array<string>>>>>>"
)


def parse_cited_by(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``(pmid, cited_by)``; a linkset that names several ids belongs to none."""
    sets = df.select(F.posexplode(F.from_json(raw, _LINKS)["linksets"]).alias("seq", "s")).filter(
        F.size("s.ids") == 1
    )
    matching = F.filter(
        F.coalesce(F.col("s.linksetdbs"), F.from_json(F.lit("[]"), "array<struct<linkname:string,links:array<string>>>")),
        lambda d: d["linkname"] == fixed.CITED_BY_LINKNAME,
    )
    count = F.aggregate(
        matching,
        F.lit(0),
        lambda n, d: n + F.when(d["links"].isNull(), F.lit(0)).otherwise(F.size(d["links"])),
    )
    return (
        sets.select(F.col("s.ids")[0].alias("pmid"), "seq", count.alias("cited_by"))
        .groupBy("pmid")
        .agg(F.max_by("cited_by", "seq").alias("cited_by"))
    )


# --- citation metrics ----------------------------------------------------------------

_METRIC = (
    "struct<pmid:string,_id:string,citation_count:string,citations_per_year:string,"
    "relative_citation_ratio:string,nih_percentile:string,field_citation_rate:string,"
    "expected_citations_per_year:string,apt:string,is_clinical:string,"
    "is_research_article:string,cited_by_clin:array<string>,year:string,journal:string>"
)


def tolerant_double(value: Column | str) -> Column:
    """A number, a boolean or a numeric string as a double; anything else is null."""
    v = strip(value)
    return F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))


def tolerant_int(value: Column | str) -> Column:
    """The same, cut to an integer; 0 when there is no number."""
    return F.coalesce(tolerant_double(value).cast("long"), F.lit(0).cast("long"))


def _truthy(value: Column) -> Column:
    return F.coalesce(~value.isin("false", "0", "0.0", ""), F.lit(False))


def parse_citation_metrics(df: DataFrame, raw: str = "raw") -> DataFrame:
    """The metric rows of a bare list or of a ``data`` envelope."""
    enveloped = F.ltrim(raw).startswith("{")
    rows = F.when(enveloped, F.from_json(raw, f"struct<data:array<{_METRIC}>>")["data"]).otherwise(
        F.from_json(raw, f"array<{_METRIC}>")
    )
    m = F.col("m")
    pmid = strip(F.coalesce(F.nullif(m["pmid"], F.lit("")), m["_id"], F.lit("")))
    doubles = (
        "relative_citation_ratio nih_percentile field_citation_rate expected_citations_per_year apt"
    ).split()
    return (
        df.select(F.explode(rows).alias("m"))
        .select(
            pmid.alias("pmid"),
            tolerant_int(m["citation_count"]).alias("citation_count"),
            F.coalesce(tolerant_double(m["citations_per_year"]), F.lit(0.0)).alias("citations_per_year"),
            *[tolerant_double(m[name]).alias(name) for name in doubles],
            _truthy(m["is_clinical"]).alias("is_clinical"),
            _truthy(m["is_research_article"]).alias("is_research_article"),
            F.greatest(F.size(m["cited_by_clin"]), F.lit(0)).alias("cited_by_clinical"),
            F.nullif(tolerant_int(m["year"]), F.lit(0).cast("long")).cast("int").alias("year"),
            strip(text_or_empty(m["journal"])).alias("journal"),
        )
        .filter(F.col("pmid") != "")
    )


# --- full text -------------------------------------------------------------------------

_FULL_TEXT = (
    "array<struct<documents:array<struct<infons:map<string,string>,"
    "passages:array<struct<offset:string,infons:map<string,string>,text:string>>>>>>"
)


def normalize_pmcid(value: Column | str) -> Column:
    """``PMC`` plus digits, or null."""
    digits = F.regexp_extract(strip(value), r"(?i)^(?:PMC)?(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("PMC"), digits))


def is_unavailable(raw: Column | str) -> Column:
    return F.ltrim(col(raw), F.lit(" \t\r\n")).startswith("[Error]")


def parse_full_text(df: DataFrame, pmcid: str = "pmcid", raw: str = "raw") -> DataFrame:
    """Sections ``(pmcid, license, seq, section_type, passage_type, text, offset)``.

    The requested id wins over the payload's.  A body that opens with ``[Error]`` or is not
    JSON yields no row: not available, not a failure.
    """
    document = F.get(F.get(F.from_json(raw, _FULL_TEXT), F.lit(0))["documents"], F.lit(0))
    opened = (
        df.filter(~is_unavailable(raw))
        .select(F.col(pmcid).alias("pmcid"), document.alias("d"))
        .filter(F.col("d").isNotNull())
    )
    texts = F.filter(
        F.coalesce(F.col("d.passages"), F.array().cast("array<struct<offset:string,infons:map<string,string>,text:string>>")),
        lambda p: strip(text_or_empty(p["text"])) != "",
    )
    infon = lambda name: text_or_empty(F.element_at(F.col("p.infons"), name))
    return opened.select(
        "pmcid",
        strip(text_or_empty(F.element_at(F.col("d.infons"), "license"))).alias("license"),
        F.posexplode(texts).alias("seq", "p"),
    ).select(
        "pmcid",
        "license",
        "seq",
        F.upper(infon("section_type")).alias("section_type"),
        infon("type").alias("passage_type"),
        strip("p.text").alias("text"),
        F.coalesce(F.col("p.offset").try_cast("int"), F.lit(0)).alias("offset"),
    )


# --- entity annotations ------------------------------------------------------------------

_ANNOTATED = (
    "array<struct<pmid:string,id:string,pmcid:string,passages:array<struct<"
    "infons:map<string,string>,annotations:array<struct<infons:map<string,string>,text:string>>>>>>"
)


def _clean(value: Column) -> Column:
    text = strip(text_or_empty(value))
    return F.when((text != "") & ~F.lower(text).isin("none", "null"), text)


def parse_annotations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``(pmid, pmcid, seq, concept_type, text, identifier)`` keyed by the payload's id."""
    enveloped = F.from_json(raw, f"struct<PubTator3:{_ANNOTATED}>")["PubTator3"]
    bare = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, _ANNOTATED))
    documents = df.select(F.explode(F.coalesce(bare, enveloped)).alias("d"))
    d = F.col("d")
    passage_pmc = F.filter(
        F.transform(d["passages"], lambda p: _clean(F.element_at(p["infons"], "article-id_pmc"))),
        lambda x: x.isNotNull(),
    )
    annotations = F.flatten(
        F.transform(
            d["passages"],
            lambda p: F.coalesce(
                p["annotations"],
                F.array().cast("array<struct<infons:map<string,string>,text:string>>"),
            ),
        )
    )
    field = lambda name: strip(text_or_empty(F.element_at(F.col("a.infons"), name)))
    return (
        documents.select(
            strip(F.coalesce(F.nullif(d["pmid"], F.lit("")), d["id"], F.lit(""))).alias("pmid"),
            F.coalesce(_clean(d["pmcid"]), F.get(passage_pmc, F.lit(0))).alias("pmcid"),
            F.posexplode(annotations).alias("seq", "a"),
        )
        .filter(F.col("pmid") != "")
        .select(
            "pmid",
            "pmcid",
            "seq",
            field("type").alias("concept_type"),
            strip(text_or_empty(F.col("a.text"))).alias("text"),
            field("identifier").alias("identifier"),
        )
        .filter((F.col("concept_type") != "") & (F.col("text") != ""))
    )


def annotation_forms(annotations: DataFrame) -> DataFrame:
    """Distinct forms per paper and type, most frequent first, first seen on ties."""
    counted = annotations.groupBy("pmid", "concept_type", "text").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seen")
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_seen", "text")))
    return counted.groupBy("pmid", "concept_type").agg(
        F.transform(ordered, lambda s: s["text"]).alias("forms")
    )


# --- append-only logs ------------------------------------------------------------------------


def last_write_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest record per key (A17): a combinable aggregate, not a sort per key."""
    payload = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(seq)).alias("_latest"))
    return latest.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in payload])


def parse_catalog(lines: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Catalogue rows, and the lines that are no JSON object.

    ``lines`` keeps every other column (a file, a line number) beside both results.
    """
    probe = lines.withColumn("_ok", F.try_parse_json(value).isNotNull())
    is_object = strip(value).startswith("{")
    others = [c for c in lines.columns if c != value]
    rows = probe.filter(F.col("_ok") & is_object).select(
        *others, F.from_json(value, schema).alias("row")
    )
    problems = probe.filter(~(F.col("_ok") & is_object)).select(
        *others,
        F.when(~F.col("_ok"), F.lit("not valid JSON")).otherwise(F.lit("not a JSON object")).alias("problem"),
    )
    return rows.select(*others, "row.*"), problems
