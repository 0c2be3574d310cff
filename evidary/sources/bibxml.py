"""Article-set XML: journal and book records side by side (A1 to A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidary import fixed
from evidary.functions.text import code_array_map, col, inline, strings, text_or_empty
from evidary.sources.filesource import RANGE, numbered_records, record_files

_TEXT = "struct<_VALUE:string>"
_ABSTRACT = "struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>"
_AUTHORS = (
    "struct<Author:array<struct<LastName:string,Initials:string,CollectiveName:string>>>"
)
_IDS = "struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>"
_KEYWORDS = "array<struct<Keyword:array<struct<_VALUE:string>>>>"
_PUB_DATE = "struct<Year:string,Month:string,Day:string,MedlineDate:string>"

JOURNAL_SCHEMA = (
    f"MedlineCitation struct<PMID:{_TEXT},Article:struct<ArticleTitle:{_TEXT},"
    f"Abstract:{_ABSTRACT},AuthorList:{_AUTHORS},Language:array<string>,"
    f"Journal:struct<Title:string,ISOAbbreviation:string,JournalIssue:struct<PubDate:{_PUB_DATE}>>,"
    f"PublicationTypeList:struct<PublicationType:array<{_TEXT}>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<"
    "DescriptorName:struct<_VALUE:string,_UI:string,_MajorTopicYN:string>,"
    "QualifierName:array<struct<_VALUE:string,_MajorTopicYN:string>>>>>,"
    f"KeywordList:{_KEYWORDS},"
    "CommentsCorrectionsList:struct<CommentsCorrections:array<struct<"
    f"_RefType:string,PMID:{_TEXT}>>>>,"
    f"PubmedData struct<ArticleIdList:{_IDS}>"
)
BOOK_SCHEMA = (
    f"BookDocument struct<PMID:{_TEXT},ArticleIdList:{_IDS},ArticleTitle:{_TEXT},"
    f"Book:struct<BookTitle:{_TEXT},PubDate:{_PUB_DATE}>,Abstract:{_ABSTRACT},"
    f"AuthorList:array<{_AUTHORS}>,Language:array<string>,PublicationType:array<{_TEXT}>,"
    f"KeywordList:{_KEYWORDS}>"
)

# Structural elements open with a capital, inline markup with a small letter, so dropping
# the small-letter tags leaves all descendant text of titles and abstracts in place.
_INLINE_MARKUP = r"</?(?:[a-z][^>]*|DispFormula[^>]*)>"


def read_article_sets(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Raw records ``(file, number, position, kind, xml)`` of article sets, books and journal articles side by side (A1).

    A large file is read in many ranges, each of which finds its own records.  ``number`` orders the records of a
    file as they stand in it, from 1; ``position`` is the byte at which one begins.
    """
    numbered = numbered_records(record_files(spark, path, "articles", range_bytes))
    kind = F.when(F.col("record").startswith("<PubmedBookArticle"), F.lit("book")).otherwise(F.lit("journal"))
    return numbered.select("file", F.col("line").alias("number"), "position", kind.alias("kind"), F.col("record").alias("xml"))


def parse_articles(raw: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """Both kinds of record as one table of papers.

    ``raw`` needs an XML string column; ``keep`` names columns to carry along.
    """
    clean = raw.withColumn("_xml", F.regexp_replace(xml, _INLINE_MARKUP, ""))
    is_book = F.instr("_xml", "<PubmedBookArticle") > 0
    journals = clean.filter(~is_book).withColumn(
        "r", F.from_xml("_xml", JOURNAL_SCHEMA, {"rowTag": "PubmedArticle"})
    )
    books = clean.filter(is_book).withColumn(
        "r", F.from_xml("_xml", BOOK_SCHEMA, {"rowTag": "PubmedBookArticle"})
    )
    return _journals(journals, keep).unionByName(_books(books, keep))


def _value(node: Column) -> Column:
    return inline(text_or_empty(node["_VALUE"]))


def _values(nodes: Column) -> Column:
    return F.coalesce(F.transform(nodes, _value), F.array().cast("array<string>"))


def _identifier(ids: Column, kind: str) -> Column:
    """This record's own id of one kind, the last one listed (A4)."""
    matching = F.filter(ids, lambda i: F.lower(F.coalesce(i["_IdType"], F.lit(""))) == kind)
    return F.nullif(
        F.trim(text_or_empty(F.try_element_at(matching, F.lit(-1))["_VALUE"])), F.lit("")
    )


def title_case(label: Column) -> Column:
    """Each run of letters capitalized, as headings are."""
    runs = F.regexp_extract_all(label, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2)))),
        ),
        "",
    )


def _abstract(abstract: Column) -> Column:
    """Labelled paragraphs joined by a blank line."""
    parts = F.filter(
        F.transform(
            abstract["AbstractText"],
            lambda t: F.struct(
                _value(t).alias("body"), F.trim(text_or_empty(t["_Label"])).alias("label")
            ),
        ),
        lambda p: p["body"] != "",
    )
    rendered = F.transform(
        parts,
        lambda p: F.when(
            p["label"] != "", F.concat(title_case(p["label"]), F.lit(": "), p["body"])
        ).otherwise(p["body"]),
    )
    return F.coalesce(F.array_join(rendered, "\n\n"), F.lit(""))


def _authors(authors: Column) -> Column:
    """Surname and initials; a collective name stays whole."""
    shaped = F.transform(
        authors,
        lambda a: F.when(
            inline(text_or_empty(a["CollectiveName"])) != "",
            F.struct(
                inline(a["CollectiveName"]).alias("surname"),
                F.lit("").alias("initials"),
                F.lit(True).alias("collective"),
            ),
        ).otherwise(
            F.struct(
                inline(text_or_empty(a["LastName"])).alias("surname"),
                inline(text_or_empty(a["Initials"])).alias("initials"),
                F.lit(False).alias("collective"),
            )
        ),
    )
    empty = F.array().cast("array<struct<surname:string,initials:string,collective:boolean>>")
    return F.coalesce(F.filter(shaped, lambda a: a["surname"] != ""), empty)


def author_names(authors: Column | str) -> Column:
    """Display names of the author structs."""
    return F.transform(col(authors), lambda a: F.trim(F.concat_ws(" ", a["surname"], a["initials"])))


def publication_year(year: Column | str, medline_date: Column | str) -> Column:
    """The year, else the first four-digit word of a free-text date."""
    y = inline(text_or_empty(year))
    token = F.regexp_extract(inline(text_or_empty(medline_date)), r"(?:^| )(\d{4})(?= |$)", 1)
    return F.when(y.rlike(r"^\d+$"), y.try_cast("int")).otherwise(
        F.nullif(token, F.lit("")).cast("int")
    )


def _mesh(headings: Column) -> Column:
    """Headings, major when the descriptor or any qualifier is major."""
    present = F.filter(headings, lambda h: h["DescriptorName"].isNotNull())
    major = lambda flag: F.coalesce(flag == "Y", F.lit(False))
    no_qualifiers = F.array().cast("array<struct<_VALUE:string,_MajorTopicYN:string>>")
    shaped = F.transform(
        present,
        lambda h: F.struct(
            _value(h["DescriptorName"]).alias("descriptor"),
            text_or_empty(h["DescriptorName"]["_UI"]).alias("ui"),
            (
                major(h["DescriptorName"]["_MajorTopicYN"])
                | F.exists(
                    F.coalesce(h["QualifierName"], no_qualifiers),
                    lambda q: major(q["_MajorTopicYN"]),
                )
            ).alias("major"),
            _values(h["QualifierName"]).alias("qualifiers"),
        ),
    )
    empty = F.array().cast(
        "array<struct<descriptor:string,ui:string,major:boolean,qualifiers:array<string>>>"
    )
    return F.coalesce(shaped, empty)


def _keywords(lists: Column) -> Column:
    return F.filter(F.flatten(F.transform(lists, lambda k: _values(k["Keyword"]))), lambda k: k != "")


def _or_empty(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def _journals(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    c = F.col("r.MedlineCitation")
    a, j = c["Article"], c["Article"]["Journal"]
    date = j["JournalIssue"]["PubDate"]
    ids = F.col("r.PubmedData.ArticleIdList.ArticleId")
    parts = F.array(*[inline(text_or_empty(date[p])) for p in ("Year", "Month", "Day")])
    raw_date = F.when(
        inline(text_or_empty(date["Year"])).rlike(r"^\d+$"),
        F.array_join(F.filter(parts, lambda p: p != ""), " "),
    ).otherwise(inline(text_or_empty(date["MedlineDate"])))
    retractions = F.filter(
        c["CommentsCorrectionsList"]["CommentsCorrections"], lambda x: x["_RefType"] == "RetractionIn"
    )
    return df.select(
        *keep,
        F.coalesce(
            F.nullif(_value(c["PMID"]), F.lit("")), _identifier(ids, "pubmed"), F.lit("")
        ).alias("pmid"),
        _value(a["ArticleTitle"]).alias("title"),
        _abstract(a["Abstract"]).alias("abstract"),
        inline(text_or_empty(j["Title"])).alias("journal"),
        inline(text_or_empty(j["ISOAbbreviation"])).alias("journal_abbrev"),
        publication_year(date["Year"], date["MedlineDate"]).alias("year"),
        raw_date.alias("pub_date_raw"),
        _authors(a["AuthorList"]["Author"]).alias("authors"),
        _identifier(ids, "doi").alias("doi"),
        _identifier(ids, "pmc").alias("pmcid"),
        _values(a["PublicationTypeList"]["PublicationType"]).alias("publication_types"),
        _mesh(c["MeshHeadingList"]["MeshHeading"]).alias("mesh"),
        _or_empty(_keywords(c["KeywordList"])).alias("keywords"),
        inline(text_or_empty(F.get(a["Language"], F.lit(0)))).alias("language"),
        F.lit("journal").alias("source_type"),
        _or_empty(F.transform(retractions, lambda x: _value(x["PMID"]))).alias("retraction_refs"),
    )


def _books(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    d = F.col("r.BookDocument")
    book_title = _value(d["Book"]["BookTitle"])
    year = inline(text_or_empty(d["Book"]["PubDate"]["Year"]))
    ids = d["ArticleIdList"]["ArticleId"]
    title = _value(d["ArticleTitle"])
    no_mesh = F.array().cast(
        "array<struct<descriptor:string,ui:string,major:boolean,qualifiers:array<string>>>"
    )
    return df.select(
        *keep,
        F.coalesce(
            F.nullif(_value(d["PMID"]), F.lit("")), _identifier(ids, "pubmed"), F.lit("")
        ).alias("pmid"),
        F.when(title == "", book_title).otherwise(title).alias("title"),
        _abstract(d["Abstract"]).alias("abstract"),
        book_title.alias("journal"),
        F.lit("").alias("journal_abbrev"),
        F.when(year.rlike(r"^\d+$"), year.try_cast("int")).alias("year"),
        year.alias("pub_date_raw"),
        _authors(F.get(d["AuthorList"], F.lit(0))["Author"]).alias("authors"),
        _identifier(ids, "doi").alias("doi"),
        _identifier(ids, "pmc").alias("pmcid"),
        _values(d["PublicationType"]).alias("publication_types"),
        no_mesh.alias("mesh"),
        _or_empty(_keywords(d["KeywordList"])).alias("keywords"),
        inline(text_or_empty(F.get(d["Language"], F.lit(0)))).alias("language"),
        F.lit("book").alias("source_type"),
        F.array().cast("array<string>").alias("retraction_refs"),
    )


def is_retracted(publication_types: Column | str, retraction_refs: Column | str) -> Column:
    """A retraction type or a retraction notice (A10)."""
    return F.arrays_overlap(col(publication_types), strings(fixed.RETRACTED_TYPES)) | (
        F.size(col(retraction_refs)) > 0
    )


def language_codes() -> Column:
    """Every accepted spelling of a language mapped to its three-letter code."""
    spellings = {short: code for code, short, _ in fixed.LANGUAGES if short}
    spellings |= {name: code for code, _, name in fixed.LANGUAGES}
    spellings |= fixed.LANGUAGE_OTHER_CODES
    spellings |= {code: code for code, _, _ in fixed.LANGUAGES}
    return code_array_map(spellings)


def normalize_languages(languages: Column | str) -> Column:
    """``struct<codes, unknown>``: distinct codes in order, and what is no language."""
    entries = F.filter(
        F.transform(col(languages), lambda e: F.trim(e)), lambda e: e != ""
    )
    # An array search keeps the table a constant; a null marks an unknown spelling.
    looked_up = F.transform(
        entries, lambda e: F.struct(e.alias("raw"), F.element_at(language_codes(), F.lower(e)).alias("code"))
    )
    return F.struct(
        F.array_distinct(
            F.transform(F.filter(looked_up, lambda x: x["code"].isNotNull()), lambda x: x["code"])
        ).alias("codes"),
        F.transform(F.filter(looked_up, lambda x: x["code"].isNull()), lambda x: x["raw"]).alias(
            "unknown"
        ),
    )
