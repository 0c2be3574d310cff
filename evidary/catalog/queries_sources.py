"""Parsing what services return: XML, JSON, replies, logs.

The payloads are derived from the given tables, so what must come back is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidary.catalog import sql_text as q
from evidary.catalog.registry import query
from evidary.catalog.roles import table
from evidary.functions.labels import is_suspect
from evidary.session import scratch_path
from evidary.sources import bibxml as X, landed_json as J, replies as R
from evidary.sources.filesource import read_lines, write_files

# --- article XML ---------------------------------------------------------------------


def article_xml(spark, sf):
    """Parts as article sets: small ones are books, all carry markup, entities and reference ids."""
    pid = F.col("p_partkey").cast("string")
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    year = (F.col("p_size") + 1970).cast("string")
    date = F.when(F.col("p_size") % 2 == 0, c("<Year>", year, "</Year><Month>May</Month>")).otherwise(
        c("<MedlineDate>Spring ", year, " Jun-Jul</MedlineDate>")
    )
    ids = c('<ArticleId IdType="pubmed">', pid, '</ArticleId><ArticleId IdType="DOI">10.1/', pid, "</ArticleId>")
    authors = c(
        "<AuthorList><Author><LastName>", F.initcap("p_name"), "</LastName><Initials>A</Initials></Author>",
        "<Author><CollectiveName>The ", F.col("p_brand"), " Group</CollectiveName></Author></AuthorList>",
    )
    abstract = c(
        '<Abstract><AbstractText Label="METHODS/AIMS">We <b>saw</b> ', F.col("p_name"), " &amp; more</AbstractText>",
        "<AbstractText>  Plain\n text </AbstractText><AbstractText/></Abstract>",
    )
    title = c("Role of <i>", F.col("p_name"), "</i>  &lt; ", F.col("p_size").cast("string"), " in <sup>x</sup>")
    mesh = c(
        '<MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="N">', F.col("p_type"),
        '</DescriptorName><QualifierName MajorTopicYN="', F.when(F.col("p_size") > 25, "Y").otherwise("N"),
        '">use</QualifierName></MeshHeading></MeshHeadingList>',
    )
    refs = c(
        "<ReferenceList><Reference><ArticleIdList><ArticleId IdType=\"pmc\">PMC9</ArticleId></ArticleIdList></Reference></ReferenceList>"
    )
    pmc = F.when(F.col("p_size") > 40, c('<ArticleId IdType="pmc">PMC', pid, "</ArticleId>")).otherwise(F.lit(""))
    retraction = F.when(
        F.col("p_size") == 7,
        c('<CommentsCorrectionsList><CommentsCorrections RefType="RetractionIn"><PMID>', pid, "9</PMID></CommentsCorrections></CommentsCorrectionsList>"),
    ).otherwise("")
    journal = c(
        '<PubmedArticle><MedlineCitation Status="x"><PMID Version="1">', pid, "</PMID><Article><Journal><JournalIssue><PubDate>", date,
        "</PubDate></JournalIssue><Title>Journal of ", F.col("p_type"), "</Title><ISOAbbreviation>J.</ISOAbbreviation></Journal><ArticleTitle>", title,
        "</ArticleTitle>", abstract, authors, "<Language>eng</Language><PublicationTypeList><PublicationType UI=\"D2\">Journal Article</PublicationType>",
        "</PublicationTypeList></Article>", retraction, mesh, "<KeywordList><Keyword MajorTopicYN=\"N\">", F.col("p_brand"),
        "</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList>", ids, pmc, "</ArticleIdList>", refs, "</PubmedData></PubmedArticle>",
    )
    book = c(
        '<PubmedBookArticle><BookDocument><PMID Version="1">', pid, "</PMID><ArticleIdList>", ids, "</ArticleIdList><Book><BookTitle>Book of ",
        F.col("p_brand"), "</BookTitle><PubDate><Year>", year, "</Year></PubDate></Book>",
        F.when(F.col("p_size") > 25, c("<ArticleTitle>", title, "</ArticleTitle>")).otherwise(""), "<Language>eng</Language>", authors,
        '<PublicationType UI="D3">Review</PublicationType>', abstract, "</BookDocument></PubmedBookArticle>",
    )
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") == "SMALL", book).otherwise(journal).alias("xml"))


_INIT = "upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2)"


@query(
    "article_records",
    "A1 A2 A3 A4 A5 A6 A7 A8 A9 A10",
    f"""
SELECT CAST(p_partkey AS VARCHAR) AS pmid,
  CASE WHEN p_type = 'SMALL' AND p_size <= 25 THEN 'Book of ' || p_brand ELSE 'Role of ' || p_name || ' < ' || p_size || ' in x' END AS title,
  'Methods/Aims: We saw ' || p_name || ' & more' || chr(10) || chr(10) || 'Plain text' AS abstract,
  CASE WHEN p_type = 'SMALL' THEN 'Book of ' || p_brand ELSE 'Journal of ' || p_type END AS journal, p_size + 1970 AS year,
  CASE WHEN p_type = 'SMALL' THEN CAST(p_size + 1970 AS VARCHAR) WHEN p_size % 2 = 0 THEN (p_size + 1970) || ' May' ELSE 'Spring ' || (p_size + 1970) || ' Jun-Jul' END AS pub_date_raw,
  {_INIT} || ' A; The ' || p_brand || ' Group' AS authors, '10.1/' || p_partkey AS doi,
  CASE WHEN p_type <> 'SMALL' AND p_size > 40 THEN 'PMC' || p_partkey ELSE '' END AS pmcid,
  CASE WHEN p_type = 'SMALL' THEN '' ELSE p_type || CASE WHEN p_size > 25 THEN '*' ELSE '' END || '/use' END AS mesh,
  CASE WHEN p_type = 'SMALL' THEN '' ELSE p_brand END AS keywords, CASE WHEN p_type = 'SMALL' THEN 'book' ELSE 'journal' END AS source_type,
  p_type <> 'SMALL' AND p_size = 7 AS retracted
FROM part""",
)
def article_records(spark, sf):
    # Article sets as they land, of 512 neighbouring records each, read in ranges that cut through records.
    folder = scratch_path(spark, "article-sets")
    sets = article_xml(spark, sf).groupBy(F.floor(F.col("p_partkey") / 512).alias("file")).agg(F.array_join(F.collect_list("xml"), "\n").alias("body"))
    named = sets.select(
        F.concat(F.lit("set-"), "file", F.lit(".xml")).alias("path"),
        F.concat(F.lit('<?xml version="1.0"?>\n<PubmedArticleSet>\n'), "body", F.lit("\n</PubmedArticleSet>\n")).alias("text"),
    )
    write_files(named, folder)
    df = X.parse_articles(X.read_article_sets(spark, folder, 1 << 16))
    headings = F.transform(
        "mesh",
        lambda m: F.concat(m["descriptor"], F.when(m["major"], "*").otherwise(""), F.lit("/"), F.array_join(m["qualifiers"], ",")),
    )
    return df.select(
        "pmid", "title", "abstract", "journal", "year", "pub_date_raw", F.array_join(X.author_names("authors"), "; ").alias("authors"), "doi",
        F.coalesce("pmcid", F.lit("")).alias("pmcid"), F.array_join(headings, ";").alias("mesh"), F.array_join("keywords", ",").alias("keywords"),
        "source_type", X.is_retracted("publication_types", "retraction_refs").alias("retracted"),
    )


# --- JSON replies -------------------------------------------------------------------------


def _lists(spark, sf):
    """The parts of each order, in line order."""
    ids = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.transform(ids, lambda s: s["l_partkey"].cast("string")).alias("ids")
    )


_ORDERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"


@query(
    "search_result_hits",
    "A11",
    f"""
SELECT CAST(l_orderkey AS VARCHAR) AS term, CAST(l_partkey AS VARCHAR) AS pmid, min(rank) AS rank, any_value(n) AS count, any_value(n) % 2 = 0 AS suspect
FROM (SELECT *, {_ORDERED} AS rank, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey, l_partkey""",
)
def search_result_hits(spark, sf):
    lists = _lists(spark, sf)
    missing = F.when(F.size("ids") % 2 == 0, F.array(F.lit("nosuchfield"))).otherwise(F.array().cast("array<string>"))
    raw = F.to_json(
        F.struct(
            F.struct(
                F.size("ids").cast("string").alias("count"), F.col("ids").alias("idlist"), F.lit("x[tiab]").alias("querytranslation"),
                F.struct(missing.alias("fieldsnotfound")).alias("errorlist"),
            ).alias("esearchresult")
        )
    )
    results = J.parse_search_results(lists.select(F.col("l_orderkey").cast("string").alias("term"), raw.alias("raw")))
    flagged = results.select("term", "count", is_suspect("term", "translation", "fields_not_found").alias("suspect"))
    return J.search_hits(results).join(flagged, "term").select("term", "pmid", "rank", "count", "suspect")


@query(
    "cited_by_counts",
    "A12",
    """
SELECT CAST(l_orderkey AS VARCHAR) AS pmid, CASE WHEN count(*) % 3 = 0 THEN 0 ELSE count(*) END AS cited_by FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4""",
)
def cited_by_counts(spark, sf):
    key = F.col("l_orderkey").cast("string")
    n = F.size("ids")
    shape = "array<struct<linkname:string,links:array<string>>>"
    dbs = F.when(n % 3 == 0, F.lit(None).cast(shape)).otherwise(
        F.array(
            F.struct(F.lit("pubmed_pubmed_citedin").alias("linkname"), F.col("ids").alias("links")),
            F.struct(F.lit("other").alias("linkname"), F.col("ids").alias("links")),
        ).cast(shape)
    )
    sets = F.array(F.struct(F.when(n == 4, F.array(key, F.lit("x"))).otherwise(F.array(key)).alias("ids"), dbs.alias("linksetdbs")))
    raw = F.to_json(F.struct(sets.alias("linksets")))
    return J.parse_cited_by(_lists(spark, sf).select(raw.alias("raw"))).select("pmid", F.col("cited_by").cast("long").alias("cited_by"))


@query(
    "citation_metric_rows",
    "A13",
    """
SELECT CAST(p_partkey AS VARCHAR) AS pmid, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS citation_count,
  CASE WHEN p_size % 4 = 0 THEN -1.0 ELSE p_retailprice END AS rcr, p_size > 25 AS is_clinical, p_size % 5 AS cited_by_clinical, CASE WHEN p_size % 3 = 1 THEN 2000 ELSE -1 END AS year FROM part""",
)
def citation_metric_rows(spark, sf):
    s = F.col("p_size")
    count = F.when(s % 3 == 0, F.lit("null")).when(s % 3 == 1, F.concat(F.lit('"'), s.cast("string"), F.lit('"'))).otherwise(s.cast("string"))
    rcr = F.when(s % 4 == 0, F.lit("null")).otherwise(F.col("p_retailprice").cast("string"))
    clin = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("1"), s % 5), ","), F.lit("]"))
    row = F.concat(
        F.when(s % 2 == 0, F.lit('{"pmid":')).otherwise(F.lit('{"_id":')), F.col("p_partkey").cast("string"), F.lit(',"citation_count":'), count,
        F.lit(',"relative_citation_ratio":'), rcr, F.lit(',"is_clinical":'), (s > 25).cast("string"), F.lit(',"cited_by_clin":'), clin,
        F.lit(',"year":'), F.when(s % 3 == 1, F.lit("2000")).otherwise(F.lit("false")), F.lit("}"),
    )
    body = F.when(s % 2 == 0, F.concat(F.lit('{"data":['), row, F.lit("]}"))).otherwise(F.concat(F.lit("["), row, F.lit("]")))
    df = J.parse_citation_metrics(table(spark, sf, "part").select(body.alias("raw")))
    return df.select(
        "pmid", "citation_count", F.coalesce("relative_citation_ratio", F.lit(-1.0)).alias("rcr"), "is_clinical", "cited_by_clinical",
        F.coalesce("year", F.lit(-1)).alias("year"),
    )


KINDS = ("TITLE", "ABSTRACT", "INTRO", "METHODS", "RESULTS", "REF", "DISCUSS")


def full_text_replies(spark, sf):
    """Documents as full-text replies, one passage per line; French ones are not available."""
    kinds = F.array(*[F.lit(k.lower()) for k in KINDS])
    passages = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            (i * 10).alias("offset"),
            F.create_map(F.lit("section_type"), F.get(kinds, i % len(KINDS)), F.lit("type"), F.when(i % 5 == 0, "fig_caption").otherwise("paragraph")).alias("infons"),
            F.concat(F.lit(" "), x, F.lit(" ")).alias("text"),
        ),
    )
    document = F.struct(F.lit("unknown").alias("id"), F.create_map(F.lit("license"), F.lit(" CC BY ")).alias("infons"), passages.alias("passages"))
    raw = F.to_json(F.array(F.struct(F.array(document).alias("documents"))))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"),
        F.when(F.col("lang") == "fr", F.concat(F.lit(" [Error] : "), "text")).otherwise(raw).alias("raw"),
    )


SECTIONS_SQL = f"""lines AS (SELECT 'PMC' || doc_id AS pmcid, {q.words(KINDS)}[(i - 1) % {len(KINDS)} + 1] AS section_type,
   CASE WHEN (i - 1) % 5 = 0 THEN 'fig_caption' ELSE 'paragraph' END AS passage_type, trim(string_split(text, chr(10))[i]) AS text, (i - 1) * 10 AS off
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE lang <> 'fr')),
sections AS (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY off) - 1 AS seq FROM lines WHERE text <> '')"""


@query(
    "full_text_sections",
    "A14",
    f"WITH {SECTIONS_SQL} SELECT pmcid, 'CC BY' AS license, seq, section_type, passage_type, md5(text) AS text_md5, off AS \"offset\" FROM sections",
)
def full_text_sections(spark, sf):
    df = J.parse_full_text(full_text_replies(spark, sf))
    return df.select("pmcid", "license", "seq", "section_type", "passage_type", F.md5("text").alias("text_md5"), "offset")


@query(
    "annotation_forms",
    "A16 F10",
    f"""
WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS pmid, l_returnflag AS t, p_type AS form, {_ORDERED} AS seq FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT pmid, t, form, count(*) AS n, min(seq) AS seen FROM a WHERE t <> 'N' GROUP BY ALL)
SELECT pmid, t AS concept_type, string_agg(form, ',' ORDER BY n DESC, seen) AS forms, 'PMC' || pmid AS pmcid FROM c GROUP BY pmid, t""",
)
def annotation_forms(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = table(spark, sf, "lineitem").join(names, "l_partkey")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "p_type")))
    notes = F.transform(
        ordered,
        lambda s: F.struct(
            F.create_map(F.lit("type"), F.when(s["l_returnflag"] == "N", "").otherwise(s["l_returnflag"]), F.lit("identifier"), F.lit("1")).alias("infons"),
            F.concat(F.lit(" "), s["p_type"]).alias("text"),
        ),
    )
    key = F.col("l_orderkey").cast("string")
    passage = F.struct(F.create_map(F.lit("article-id_pmc"), F.concat(F.lit("PMC"), key)).alias("infons"), F.col("notes").alias("annotations"))
    document = F.struct(key.alias("id"), F.lit("None").alias("pmcid"), F.array(passage).alias("passages"))
    grouped = rows.groupBy("l_orderkey").agg(notes.alias("notes"))
    enveloped = F.to_json(F.struct(F.array(document).alias("PubTator3")))
    bare = F.to_json(F.array(document))
    raw = grouped.select(F.when(F.col("l_orderkey") % 2 == 0, enveloped).otherwise(bare).alias("raw"))
    parsed = J.parse_annotations(raw)
    forms = J.annotation_forms(parsed)
    ids = parsed.groupBy("pmid").agg(F.first("pmcid").alias("pmcid"))
    return forms.join(ids, "pmid").select("pmid", "concept_type", F.array_join("forms", ",").alias("forms"), "pmcid")


# --- logs and replies ------------------------------------------------------------------------


@query(
    "last_writes",
    "A17",
    "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type",
)
def last_writes(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "props")
    return J.last_write_wins(df, ["user_id", "event_type"], "event_id")


@query(
    "catalog_lines",
    "A26",
    """
WITH w AS (SELECT *, coalesce(source, 'none') || '-' || (doc_id // 256) || '.jsonl' AS file, row_number() OVER (PARTITION BY source, doc_id // 256 ORDER BY doc_id) AS place FROM documents)
SELECT file, 2 * place - 1 AS line, CASE WHEN lang IN ('fr', 'es') THEN '' ELSE coalesce(source, '') END AS source, CASE WHEN lang = 'fr' THEN 'not valid JSON' WHEN lang = 'es' THEN 'not a JSON object' ELSE '' END AS problem
FROM w""",
)
def catalog_lines(spark, sf):
    good = F.to_json(F.struct(F.col("source").alias("source"), F.col("text").alias("title")))
    value = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("{"), good))
        .when(F.col("lang") == "es", F.concat(F.lit("["), good, F.lit("]")))
        .otherwise(good)
    )
    # Files of a source and 256 neighbouring ids, with a blank line after every entry, read in ranges that cut through lines.
    folder = scratch_path(spark, "catalog-lines")
    entry = F.struct("doc_id", value.alias("value"))
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / 256), F.lit(".jsonl"))
    files = table(spark, sf, "documents").groupBy(name.alias("path")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(e["value"], F.lit("\n \n"))), "").alias("text")
    )
    write_files(files, folder)
    lines = read_lines(spark, folder, 1 << 16).withColumn("file", F.element_at(F.split("file", "/"), -1))
    rows, problems = J.parse_catalog(lines, "source string, title string")
    return rows.select("file", "line", F.coalesce("source", F.lit("")).alias("source"), F.lit("").alias("problem")).unionByName(
        problems.select("file", "line", F.lit("").alias("source"), "problem")
    )


@query(
    "reply_rows",
    "A18 U5",
    """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE md5(trim(text)) END AS reason_md5, CASE WHEN role = 'system' THEN FALSE ELSE turn % 2 = 0 END AS include,
  CASE WHEN role = 'system' THEN 'no JSON object' ELSE '' END AS problem FROM conversations""",
)
def reply_rows(spark, sf):
    body = F.to_json(F.struct((F.col("turn") % 2 == 0).alias("include"), F.trim("text").alias("reason"), F.lit(-5).alias("conv_id")))
    loose = F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(",}"))
    reply = (
        F.when(F.col("role") == "system", F.lit("I cannot say."))
        .when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), F.lit('{"parameters": '), body, F.lit("}\n```")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Here: "), loose, F.lit(" Done.")))
        .otherwise(F.to_json(F.struct(body.alias("verdict"))))
    )
    df = table(spark, sf, "conversations").select("conv_id", "turn", "role", reply.alias("reply"))
    good, bad = R.parse_replies(
        df, "reply", "conv_id long, turn long, include boolean, reason string", known=["conv_id", "turn"], required=["include"]
    )
    return good.select(
        "conv_id", "turn", F.md5("reason").alias("reason_md5"), "include", F.lit("").alias("problem")
    ).unionByName(
        bad.select("conv_id", "turn", F.lit("").alias("reason_md5"), F.lit(False).alias("include"), "problem")
    )


@query(
    "escape_repairs",
    "A19",
    "SELECT conv_id, turn, md5(text || ' \\u0041 \\u200b') AS text_md5, md5('é' || role) AS tag_md5 FROM conversations",
)
def escape_repairs(spark, sf):
    spelled = F.col("text")
    for char in "éèêàçüöäßñóíáúœæôîûùÉÈ":
        spelled = F.replace(spelled, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    df = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(spelled, F.lit(" \\u0041 \\u200b")).alias("text"), F.array(F.concat(F.lit("\\u00e9"), "role")).alias("tags")
    )
    done = R.repair_escapes(df, ["text", "tags"])
    return done.select("conv_id", "turn", F.md5("text").alias("text_md5"), F.md5(F.get("tags", F.lit(0))).alias("tag_md5"))
