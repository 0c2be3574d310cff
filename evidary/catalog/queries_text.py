"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidary import fixed
from evidary.catalog import roles, sql_text as q
from evidary.catalog.registry import query
from evidary.catalog.roles import table
from evidary.catalog.roles_sql import with_roles
from evidary.functions import labels as L, numbers as N, text as T
from evidary.operators import budgets
from evidary.operators.placement import blank_unknown_topics, recover_topics
from evidary.sources.bibxml import normalize_languages
from evidary.sources.landed_json import normalize_pmcid


def _documents(spark, sf):
    return table(spark, sf, "documents").withColumn("pmid", F.col("doc_id").cast("string"))


@query(
    "token_sets",
    "C1 C2 C3",
    f"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, {q.tokens("text")} AS body,
                  {q.tokens("split_part(text, chr(10), 1) || ' ' || source || ' ' || lang")} AS head FROM documents)
SELECT pmid, len(body) AS n_tokens, md5(array_to_string(list_sort(body), ' ')) AS tokens_md5, len(head) AS n_head,
       round({q.jaccard("body", "head")}, 6) AS overlap FROM t""",
)
def token_sets(spark, sf):
    df = _documents(spark, sf).select(
        "pmid",
        T.text_tokens("text").alias("body"),
        T.paper_tokens(F.substring_index("text", "\n", 1), F.array("source"), F.array("lang")).alias("head"),
    )
    return df.select(
        "pmid",
        F.size("body").alias("n_tokens"),
        F.md5(F.array_join(F.array_sort("body"), " ")).alias("tokens_md5"),
        F.size("head").alias("n_head"),
        F.round(T.jaccard("body", "head"), 6).alias("overlap"),
    )


@query(
    "titles_and_names",
    "C10 C11 C21",
    f"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, split_part(text, chr(10), 1) AS title, text, source, lang, n_chars FROM documents)
SELECT pmid, {q.norm_title("title")} AS norm,
       rtrim(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64), '-') AS slug,
       rtrim(substr(trim(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 64), '-') AS token,
       md5(trim(title || chr(10) || chr(10) || text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS screening_md5,
       'Ferrari Silva B et al. ' || source || ' ' || (1990 + n_chars % 36) AS citation,
       pmid || '_Ferrari-Silva.md' AS filename
FROM t""",
)
def titles_and_names(spark, sf):
    authors = F.array(F.lit("Ferrari Silva B"), F.lit("Li C"))
    title = F.substring_index("text", "\n", 1)
    return _documents(spark, sf).select(
        "pmid",
        T.normalized_title(title).alias("norm"),
        T.slugify(title).alias("slug"),
        T.filename_token(title).alias("token"),
        F.md5(T.screening_text(title, "text")).alias("screening_md5"),
        T.citation(authors, "source", (F.lit(1990) + F.col("n_chars") % 36)).alias("citation"),
        T.document_filename("pmid", authors).alias("filename"),
    )


_PHRASE = "p_name || 's status (' || p_type || ', >= ' || p_size || ' units/d) of SD ' || p_brand"
_INIT = r"\b[A-Z][A-Z0-9-]*\b"
_OPENED = (
    r"array_to_string(list_transform(regexp_extract_all(phrase, '\([^)]*\)|[^(]+|\('), lambda p: "
    rf"CASE WHEN p LIKE '(%)' THEN ' ' || regexp_replace(substr(p, 2, length(p) - 2), '{_INIT}', ' ', 'g') || ' ' ELSE p END), '')"
)
_SINGULAR = "list_transform({x}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|os|as)$') THEN substr(w, 1, length(w) - 1) ELSE w END)"


@query(
    "phrase_keys",
    "C12 C13 C14",
    f"""
WITH t AS (SELECT p_partkey, {_PHRASE} AS phrase FROM part), o AS (SELECT *, {_OPENED} AS opened FROM t)
SELECT p_partkey, phrase,
       array_to_string(list_sort(list_distinct(list_concat({_SINGULAR.format(x=q.tokens("opened"))},
           list_transform(list_filter(regexp_extract_all(opened, '{_INIT}'), lambda w: length(w) > 1), lambda w: lower(w))))), ' ') AS key,
       array_to_string(list_sort(list_distinct(regexp_extract_all(phrase, '[0-9]+(?:\\.[0-9]+)?'))), ' ') AS numbers,
       trim({q.inline("regexp_replace(regexp_replace(regexp_replace(phrase, '[<>≤≥=~]*[ ]*[0-9]+(?:[.][0-9]+)?[ ]*[a-zA-Z0-9_/%]*', ' ', 'g'), '[(][ ]*[)]', ' ', 'g'), '[ ,;:]+([)\\]])', '\\1', 'g')")}, ' ,;:-.') AS bare
FROM o""",
)
def phrase_keys(spark, sf):
    phrase = F.concat(
        "p_name", F.lit("s status ("), "p_type", F.lit(", >= "), F.col("p_size").cast("string"),
        F.lit(" units/d) of SD "), "p_brand",
    )
    df = table(spark, sf, "part").select("p_partkey", phrase.alias("phrase"))
    return df.select(
        "p_partkey",
        "phrase",
        F.array_join(T.surface_key("phrase"), " ").alias("key"),
        T.number_set("phrase").alias("numbers"),
        T.without_thresholds("phrase").alias("bare"),
    )


@query(
    "folded_texts",
    "C15 C16",
    f"SELECT CAST(doc_id AS VARCHAR) AS pmid, md5({q.fold('text')}) AS folded_md5, length({q.fold('text')}) AS folded_length FROM documents",
)
def folded_texts(spark, sf):
    df = _documents(spark, sf).select("pmid", T.fold("text").alias("f"))
    return df.select("pmid", F.md5("f").alias("folded_md5"), F.length("f").cast("long").alias("folded_length"))


@query(
    "numbers_in_texts",
    "C17",
    f"""
SELECT CAST(doc_id AS VARCHAR) AS pmid, len(n) AS n_numbers, array_to_string(n, ' ') AS literals,
       coalesce(list_max(list_transform(n, lambda v: CASE WHEN contains(v, '.') THEN length(v) - strpos(v, '.') ELSE 0 END)), 0) AS max_decimals
FROM (SELECT doc_id, {q.numbers("text || ' ' || doc_id || ' - 4 (-' || n_chars || '.50) −3·25 ' || n_chars || '–9'")} AS n FROM documents)""",
)
def numbers_in_texts(spark, sf):
    text = F.concat(
        "text", F.lit(" "), "pmid", F.lit(" - 4 (-"), F.col("n_chars").cast("string"),
        F.lit(".50) −3·25 "), F.col("n_chars").cast("string"), F.lit("–9"),
    )
    df = _documents(spark, sf).select("pmid", text.alias("t")).withColumn("q", N.quantities("t")).withColumn(
        "n", N.number_literals("t")
    )
    places = F.transform("q", lambda x: x["decimals"])
    return df.select(
        "pmid",
        F.size("q").cast("long").alias("n_numbers"),
        F.array_join("n", " ").alias("literals"),
        F.coalesce(F.array_max(places), F.lit(0)).cast("long").alias("max_decimals"),
    )


@query(
    "claim_precision",
    "C18",
    """
SELECT o_orderkey, CAST(v AS DOUBLE) AS value, length(rtrim(split_part(CAST(v AS VARCHAR), '.', 2), '0')) AS decimals
FROM (SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(38,12)), 10) AS DECIMAL(38,10)) AS v FROM orders)""",
)
def claim_precision(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        N.claim_value("o_totalprice").cast("double").alias("value"),
        N.claim_decimals("o_totalprice").cast("long").alias("decimals"),
    )


@query(
    "sentences_of_documents",
    "C19 C20",
    f"""
WITH t AS (SELECT doc_id, text, {q.sentences("text")} AS s, {q.inline("text")} AS flat FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS pmid, len(s) AS n_sentences, md5(array_to_string(s, chr(1))) AS sentences_md5,
       array_to_string(s[1:2], ' ') AS first_two,
       CASE WHEN length(flat) <= 200 THEN flat ELSE
         rtrim(CASE WHEN contains(substr(flat, 1, 199), ' ') AND 199 - strpos(reverse(substr(flat, 1, 199)), ' ') > 100
                    THEN substr(flat, 1, 199 - strpos(reverse(substr(flat, 1, 199)), ' ')) ELSE substr(flat, 1, 199) END, ' ,;:.') || '…' END AS short,
       CASE WHEN flat = '' THEN 0 ELSE len(string_split(flat, ' ')) END AS words
FROM t""",
)
def sentences_of_documents(spark, sf):
    df = _documents(spark, sf).withColumn("s", T.sentences("text"))
    return df.select(
        "pmid",
        F.size("s").cast("long").alias("n_sentences"),
        F.md5(F.array_join("s", "\u0001")).alias("sentences_md5"),
        F.array_join(F.slice("s", 1, 2), " ").alias("first_two"),
        T.truncate_chars("text", 200).alias("short"),
        T.word_count("text").cast("long").alias("words"),
    )


_BREAK = q.words(fixed.PHRASE_STOPWORDS + fixed.PHRASE_TASK_WORDS)


@query(
    "keyphrases",
    "C32",
    f"""
WITH t AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''\\-]*') AS w FROM benchmark),
m AS (SELECT item_id, array_to_string(list_transform(w, lambda x: CASE WHEN list_contains({_BREAK}, lower(x)) OR length(x) < 3 THEN chr(1) ELSE x END), ' ') AS s FROM t),
r AS (SELECT item_id, list_filter(list_transform(string_split(s, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS runs FROM m),
p AS (SELECT item_id, list_transform(runs, lambda x: array_to_string(string_split(x, ' ')[1:4], ' ')) AS heads FROM r)
SELECT item_id, array_to_string(list_filter(heads, lambda x, i: list_position(heads, x) = i), '; ') AS phrases FROM p""",
)
def keyphrases(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", F.array_join(T.keyphrases("text"), "; ").alias("phrases")
    )


@query(
    "language_codes",
    "C36",
    """
SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'ger' WHEN 'fr' THEN 'fre' WHEN 'es' THEN 'spa' END ||
       CASE WHEN lang = 'de' THEN '' ELSE ',ger' END AS codes, source AS unknown FROM documents""",
)
def language_codes(spark, sf):
    langs = F.array(F.upper("lang"), F.lit("deu"), F.lit(" "), F.col("source"))
    df = table(spark, sf, "documents").select("doc_id", normalize_languages(langs).alias("n"))
    return df.select(
        "doc_id", F.array_join("n.codes", ",").alias("codes"), F.array_join("n.unknown", ",").alias("unknown")
    )


_LICENSE = "CASE p_type WHEN 'LARGE' THEN 'CC BY' WHEN 'SMALL' THEN 'cc-by-nc' WHEN 'PROMO' THEN ' CC0 ' WHEN 'MEDIUM' THEN 'cc by-nd' WHEN 'ECONOMY' THEN '' ELSE 'Public  Domain' END"


@query(
    "export_safety",
    "C22 D7",
    f"""
SELECT p_partkey, licence, licence IN ('CC BY', ' CC0 ', 'Public  Domain') AS safe,
       lower(trim(flag)) = 'true' AS says_true
FROM (SELECT p_partkey, {_LICENSE} AS licence, CASE WHEN p_size > 25 THEN ' True' ELSE 'false' END AS flag FROM part)""",
)
def export_safety(spark, sf):
    licence = F.expr(_LICENSE)
    flag = F.when(F.col("p_size") > 25, F.lit(" True")).otherwise(F.lit("false"))
    return table(spark, sf, "part").select(
        "p_partkey",
        licence.alias("licence"),
        L.is_export_safe(licence).alias("safe"),
        L.says_true(flag).alias("says_true"),
    )


@query(
    "interaction_bands",
    "C23 C39",
    with_roles(
        """
SELECT pmid, row, kind, CASE WHEN kind IN ('mutually_exclusive', 'derived_from', 'derives') THEN 'structural'
            WHEN value IS NULL THEN 'stated' WHEN abs(value) >= 0.7 THEN 'strong' WHEN abs(value) >= 0.4 THEN 'moderate' ELSE 'weak' END AS magnitude,
       CASE kind WHEN 'correlated' THEN kind WHEN 'mutually_exclusive' THEN kind WHEN 'modifies' THEN 'modified_by'
            WHEN 'confounds' THEN 'confounded_by' WHEN 'mediates' THEN 'mediated_by' WHEN 'derived_from' THEN 'derives' END AS inverse
FROM interactions""",
        "interactions",
    ),
)
def interaction_bands(spark, sf):
    return roles.interactions(roles.findings(spark, sf)).select(
        "pmid",
        "row",
        "kind",
        L.band_interaction("kind", "measure", "value").alias("magnitude"),
        L.inverse_interaction("kind").alias("inverse"),
    )


@query(
    "canonical_codes",
    "C37",
    """
SELECT p_partkey, 'icd10:' || p_brand || CASE WHEN p_size > 25 THEN ';atc:' || p_type ELSE '' END AS codes FROM part""",
)
def canonical_codes(spark, sf):
    code = lambda s, c: F.struct(s.alias("system"), c.alias("code"))
    codes = F.array(
        code(F.lit("ICD-10"), F.concat(F.lit(" "), F.col("p_brand"))),
        code(F.lit("icd 10"), F.col("p_brand")),
        code(F.when(F.col("p_size") > 25, F.lit("ATC")).otherwise(F.lit("icd10")),
             F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_brand"))),
    )
    shown = F.transform(L.canonical_codes(codes), lambda c: F.concat(c["system"], F.lit(":"), c["code"]))
    return table(spark, sf, "part").select("p_partkey", F.array_join(shown, ";").alias("codes"))


@query(
    "confidence_steps",
    "C38",
    with_roles(
        """
SELECT confidence, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank,
       CASE confidence WHEN 'high' THEN 'medium' ELSE 'low' END AS down, count(*) AS findings FROM findings GROUP BY ALL""",
        "findings",
    ),
)
def confidence_steps(spark, sf):
    return (
        roles.findings(spark, sf)
        .groupBy("confidence")
        .agg(F.count("*").alias("findings"))
        .select("confidence", L.confidence_rank("confidence").alias("rank"), L.confidence_down("confidence").alias("down"), "findings")
    )


@query(
    "token_estimates",
    "C40",
    """
SELECT conv_id, turn, CAST(floor(length(text) / 4.0) AS BIGINT) + 1 AS prompt_tokens,
       CAST(ceil(length(text) / 3.0) AS BIGINT) AS chunk_tokens FROM conversations""",
)
def token_estimates(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", L.prompt_tokens("text").alias("prompt_tokens"), L.chunk_tokens("text").alias("chunk_tokens")
    )


@query(
    "timestamps",
    "C30 C31",
    """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS started,
       '' AS typed FROM events""",
)
def timestamps(spark, sf):
    run = F.concat(F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("-"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select(
        "event_id",
        L.stamp("ts").alias("stamp"),
        F.date_format(L.started_at(run), "yyyy-MM-dd HH:mm:ss").alias("started"),
        F.coalesce(F.date_format(L.started_at(F.concat(F.lit("by-hand-"), run)), "yyyy"), F.lit("")).alias("typed"),
    )


_TERM = "'\"' || p_name || '\"[tiab] AND (' || lower(p_type) || CASE WHEN p_size > 40 THEN '' ELSE '[mh]' END || ')'"
_TRANSLATION = "'\"' || p_name || '\"[Title/Abstract] AND \"' || lower(p_type) || CASE WHEN p_size % 2 = 0 THEN '\"[MeSH Terms]' ELSE '\"[All Fields]' END"


@query(
    "query_inspection",
    "C34 C35 I4",
    f"""
WITH t AS (SELECT p_partkey, {_TERM} AS term, {_TRANSLATION} AS translation, p_size FROM part),
s AS (SELECT *, p_size = 50 OR (p_size <= 40 AND p_size % 2 = 1) AS suspect FROM t)
SELECT p_partkey, term, CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS untagged, suspect,
       NOT suspect AND p_size <= 40 AND p_size % 2 = 0 AS mechanical FROM s""",
)
def query_inspection(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey",
        F.expr(_TERM).alias("term"),
        F.expr(_TRANSLATION).alias("translation"),
        F.when(F.col("p_size") == 50, F.array(F.lit("nosuchfield"))).otherwise(F.array().cast("array<string>")).alias("missing"),
    )
    df = df.withColumn("suspect", L.is_suspect("term", "translation", "missing"))
    return df.select(
        "p_partkey",
        "term",
        F.size(L.untagged_clauses("term")).alias("untagged"),
        "suspect",
        L.expansion_is_mechanical("term", "translation", "suspect").alias("mechanical"),
    )


@query(
    "request_keys",
    "C42 C43",
    """
WITH t AS (SELECT page_id, split_part(url, '?', 1) AS base, CASE WHEN contains(url, '?') THEN substr(url, strpos(url, '?') + 1) ELSE '' END AS qs, url FROM pages),
c AS (SELECT *, array_to_string(list_sort(list_filter(string_split(split_part(qs, '#', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('api_key', 'tool'))), '&') AS canon FROM t)
SELECT page_id, sha256('GET ' || base || '?' || canon) AS key,
       url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'api_key=REDACTED&tool=x' AS safe,
       substr(sha256(concat(url, chr(0), base, chr(0))), 1, 16) AS fingerprint
FROM c""",
)
def request_keys(spark, sf):
    has = F.instr("url", "?") > 0
    base = F.substring_index("url", "?", 1)
    query_text = F.when(has, F.substring_index(F.substr(F.col("url"), F.instr("url", "?") + 1), "#", 1)).otherwise("")
    full = F.concat("url", F.when(has, F.lit("&")).otherwise(F.lit("?")), F.lit("api_key=s3cret&tool=x"))
    params = F.map_concat(
        F.map_filter(F.str_to_map(query_text, F.lit("&"), F.lit("=")), lambda k, v: k != ""),
        F.create_map(F.lit("api_key"), F.lit("s3cret"), F.lit("tool"), F.lit("x")),
    )
    return table(spark, sf, "pages").select(
        "page_id",
        L.request_key(F.lit("get"), base, params).alias("key"),
        L.redact_url(full).alias("safe"),
        L.fingerprint("url", base).alias("fingerprint"),
    )


@query(
    "effect_cells",
    "C27",
    with_roles(
        f"""
SELECT pmid, row, CASE WHEN effect IS NOT NULL AND row > 1 THEN effect_raw
                       WHEN effect IS NOT NULL THEN {q.general("effect")} || ' ' || effect_measure
                       WHEN direction = 'none' THEN 'reported as null' WHEN direction = 'unclear' THEN 'unverified' ELSE '—' END AS cell,
       CASE WHEN effect IS NULL THEN '—' ELSE 'moderate ' || printf('%.2f', effect) END AS strength
FROM findings""",
        "findings",
    ),
)
def effect_cells(spark, sf):
    raw = (
        F.when(F.col("effect").isNotNull() & (F.col("row") > 1), F.col("effect_raw"))
        .when(F.col("effect").isNotNull(), F.lit(" "))
        .when(F.col("direction") == "none", F.lit("reported as null"))
        .when(F.col("direction") == "unclear", F.lit("OR 1.8"))
        .otherwise(F.lit(""))
    )
    df = roles.findings(spark, sf).withColumn("raw", raw)
    return df.select(
        "pmid",
        "row",
        L.effect_cell("effect", "effect_measure", "raw").alias("cell"),
        L.strength_cell(F.when(F.col("effect").isNotNull(), F.lit("moderate")).otherwise(F.lit("ungraded")), "effect").alias("strength"),
    )


@query(
    "topic_name_recovery",
    "C47 D8",
    with_roles(
        """
SELECT v.pmid, CASE WHEN v.segment = 'BUILDING' THEN v.region WHEN v.segment = 'FURNITURE' THEN v.region
                  WHEN v.segment = 'AUTOMOBILE' THEN NULL ELSE v.region END AS recovered,
       CASE WHEN v.topic = 'not a topic' THEN '' ELSE v.topic END AS topic,
       CASE WHEN v.topic = 'not a topic' THEN v.topic END AS unknown
FROM verdicts v""",
        "verdicts",
    ),
)
def topic_name_recovery(spark, sf):
    topics = roles.topics(spark, sf)
    named = (
        F.when(F.col("segment") == "BUILDING", F.upper(F.replace("region", F.lit("-"), F.lit("_"))))
        .when(F.col("segment") == "FURNITURE", F.concat(F.lit("nowhere; "), F.col("region"), F.lit("; asia")))
        .when(F.col("segment") == "AUTOMOBILE", F.lit("no such place"))
        .otherwise(F.col("region"))
    )
    df = recover_topics(blank_unknown_topics(roles.verdicts(spark, sf), topics).withColumn("named", named), "named", topics)
    return df.select("pmid", "recovered", "topic", F.col("unknown_topic").alias("unknown"))


@query(
    "pmc_ids",
    "A15",
    """
SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr') THEN 'PMC' || doc_id END AS pmcid FROM documents""",
)
def pmc_ids(spark, sf):
    raw = (
        F.when(F.col("lang") == "en", F.concat(F.lit(" pmc"), F.col("doc_id").cast("string")))
        .when(F.col("lang") == "de", F.col("doc_id").cast("string"))
        .when(F.col("lang") == "fr", F.concat(F.lit("PMC"), F.col("doc_id").cast("string"), F.lit("\n")))
        .otherwise(F.concat(F.lit("PMC-"), F.col("doc_id").cast("string")))
    )
    return table(spark, sf, "documents").select("doc_id", normalize_pmcid(raw).alias("pmcid"))


# --- readings with nested lists ---------------------------------------------------------


def readings(spark, sf):
    """One nested reading per order, from its findings."""
    rows = roles.findings(spark, sf)
    nested = rows.groupBy("pmid").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "row", "predictor", "operationalization", "timing", "outcome", "effect_raw", "quote",
                    F.array_repeat(
                        F.struct(F.col("predictor").alias("feature"), F.col("effect_raw").alias("measure_raw")),
                        F.col("d"),
                    ).alias("interacts_with"),
                )
            )
        ).alias("predictors")
    )
    texts = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("pmid"), F.col("text").alias("caveats")
    )
    return (
        nested.join(roles.order_papers(spark, sf).drop("caveats"), "pmid")
        .join(texts, "pmid", "left")
        .withColumn("caveats", T.text_or_empty("caveats"))
        .withColumn(
            "null_findings",
            F.transform("predictors", lambda r: F.struct(r["predictor"].alias("predictor"), r["outcome"].alias("outcome"), r["timing"].alias("detail"))),
        )
        .withColumn("vocabulary_hints", F.transform("predictors", lambda r: F.struct(r["predictor"].alias("concept"))))
    )


_WORDS = lambda x: f"(CASE WHEN {q.inline(x)} = '' THEN 0 ELSE len(string_split({q.inline(x)}, ' ')) END)"
_SENT_N = f"len({q.sentences('caveats')})"


@query(
    "body_lengths",
    "C46 F17",
    with_roles(
        f"""
WITH f AS (SELECT pmid, sum({_WORDS("predictor")} * 2 + {_WORDS("operationalization")} + {_WORDS("timing")} * 2 + {_WORDS("outcome")} * 2
             + {_WORDS("effect_raw")} + {_WORDS("quote")} + d * ({_WORDS("predictor")} + {_WORDS("effect_raw")})) AS cells FROM findings GROUP BY pmid),
p AS (SELECT o.pmid, {_WORDS("bottom_line")} + {_WORDS("population")} + {_WORDS("outcome_definition")} + {_WORDS("coalesce(x.text, '')")} AS prose
      FROM order_papers o LEFT JOIN documents x ON o.pmid = CAST(x.doc_id AS VARCHAR))
SELECT pmid, CAST(cells + prose AS BIGINT) AS words, cells + prose > {fixed.MAX_BODY_WORDS} AS over FROM f JOIN p USING (pmid)""",
        "findings",
        "order_papers",
    ),
)
def body_lengths(spark, sf):
    measured = budgets.body_words(readings(spark, sf))
    return measured.select(
        "pmid", F.col("words").cast("long").alias("words"), F.col("overrun").isNotNull().alias("over")
    )


@query(
    "overrun_totals",
    "F17",
    with_roles(
        f"""
WITH f AS (SELECT pmid, sum({_WORDS("predictor")} * 2 + {_WORDS("operationalization")} + {_WORDS("timing")} * 2 + {_WORDS("outcome")} * 2
             + {_WORDS("effect_raw")} + {_WORDS("quote")} + d * ({_WORDS("predictor")} + {_WORDS("effect_raw")})) AS cells FROM findings GROUP BY pmid),
p AS (SELECT o.pmid, {_WORDS("bottom_line")} + {_WORDS("population")} + {_WORDS("outcome_definition")} + {_WORDS("coalesce(x.text, '')")} AS prose
      FROM order_papers o LEFT JOIN documents x ON o.pmid = CAST(x.doc_id AS VARCHAR))
SELECT count(*) FILTER (cells + prose > {fixed.MAX_BODY_WORDS}) AS overruns, CAST(coalesce(max(cells + prose) FILTER (cells + prose > {fixed.MAX_BODY_WORDS}), -1) AS BIGINT) AS largest FROM f JOIN p USING (pmid)""",
        "findings",
        "order_papers",
    ),
)
def overrun_totals(spark, sf):
    found = budgets.overrun_summary(budgets.body_words(readings(spark, sf)))
    return found.select("overruns", F.coalesce(F.col("largest").cast("long"), F.lit(-1).cast("long")).alias("largest"))


@query(
    "length_budgets",
    "C45",
    with_roles(
        f"""
WITH f AS (SELECT pmid, count(*) AS n, count(*) FILTER (row <= {fixed.MAX_PREDICTOR_ROWS} AND d > {fixed.MAX_INTERACTIONS}) AS over_rows,
       sum(CASE WHEN row <= {fixed.MAX_PREDICTOR_ROWS} THEN least(d, {fixed.MAX_INTERACTIONS}) ELSE 0 END) AS inter,
       string_agg(predictor, ', ' ORDER BY row) FILTER (row > {fixed.MAX_NULL_FINDINGS}) AS tail FROM findings GROUP BY pmid),
p AS (SELECT o.pmid, coalesce(x.text, '') AS caveats FROM order_papers o LEFT JOIN documents x ON o.pmid = CAST(x.doc_id AS VARCHAR))
SELECT pmid, least(n, {fixed.MAX_PREDICTOR_ROWS}) AS predictors, least(n, {fixed.MAX_NULL_FINDINGS}) AS nulls, CAST(inter AS BIGINT) AS interactions,
       md5(array_to_string(({q.sentences("caveats")})[1:{fixed.MAX_CAVEAT_SENTENCES}], ' ')) AS caveats_md5,
       CAST({_SENT_N} > {fixed.MAX_CAVEAT_SENTENCES} AS INTEGER) + CAST(n > {fixed.MAX_PREDICTOR_ROWS} AS INTEGER) + 2 * CAST(n > {fixed.MAX_NULL_FINDINGS} AS INTEGER)
         + CAST(over_rows > 0 AS INTEGER) AS cuts,
       CASE WHEN n > {fixed.MAX_NULL_FINDINGS} THEN 'dropped ' || (n - {fixed.MAX_NULL_FINDINGS}) || ' null finding(s) over the limit of {fixed.MAX_NULL_FINDINGS}: ' || tail ELSE '' END AS note
FROM f JOIN p USING (pmid)""",
        "findings",
        "order_papers",
    ),
)
def length_budgets(spark, sf):
    cut = budgets.enforce_budgets(readings(spark, sf))
    inter = F.aggregate("predictors", F.lit(0), lambda n, r: n + F.size(r["interacts_with"]))
    notes = F.filter("cuts", lambda c: F.contains(c, F.lit("null finding")))
    return cut.select(
        "pmid",
        F.size("predictors").cast("long").alias("predictors"),
        F.size("null_findings").cast("long").alias("nulls"),
        inter.cast("long").alias("interactions"),
        F.md5("caveats").alias("caveats_md5"),
        F.size("cuts").alias("cuts"),
        F.coalesce(F.get(notes, F.lit(0)), F.lit("")).alias("note"),
    )
