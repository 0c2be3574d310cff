"""The roles of ``roles`` in SQL, for the oracle."""

from __future__ import annotations

ROLES: dict[str, tuple[tuple[str, ...], str]] = {}


def role(name: str, *needs: str):
    def keep(sql: str) -> None:
        ROLES[name] = (needs, sql.strip())

    return keep


def with_roles(sql: str, *names: str) -> str:
    """A statement with the roles it needs stated before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in ROLES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({ROLES[n][1]})" for n in order]
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = "RECURSIVE ", ", " + body[len("WITH RECURSIVE") :].strip()
    elif body.upper().startswith("WITH "):
        body = ", " + body[4:].strip()
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


SLUG = "rtrim(substr(trim(regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64), '-')"

role("topics")(
    f"""
SELECT r_regionkey AS ord, {SLUG} AS slug, r_name AS title,
       'papers about ' || lower(r_name) AS scope, [lower(r_name), 'small', 'medium'] AS seed_terms
FROM region"""
)
role("plan", "topics")("SELECT ord, ['AF1','AO2','NF3','NO4','RF5'][ord + 1] AS term, slug AS topic FROM topics")
role("hits")(
    """
SELECT CAST(l_partkey AS VARCHAR) AS pmid, l_returnflag || l_linestatus || l_linenumber AS term,
       (list_position(['AF','AO','NF','NO','RF','RO'], l_returnflag || l_linestatus) - 1) * 7 + l_linenumber AS term_ord,
       CAST(l_quantity AS INTEGER) AS rank
FROM lineitem"""
)
role("merged_hits", "hits")(
    """
SELECT pmid, list(term ORDER BY term_ord) AS found_by, min(rank) AS best_rank
FROM (SELECT pmid, term, term_ord, min(rank) AS rank FROM hits GROUP BY ALL) GROUP BY pmid"""
)
role("part_records")(
    """
SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_name || ' ' || lower(p_type) || ' ' || p_brand AS title,
       CASE WHEN p_size = 2 THEN '' ELSE p_name END AS abstract, p_brand AS journal,
       p_size + 1976 AS year,
       CASE WHEN p_type IN ('LARGE', 'PROMO') THEN 'PMC' || p_partkey END AS pmcid,
       CASE WHEN p_type = 'PROMO' THEN ['Editorial'] ELSE ['Journal Article'] END AS publication_types,
       [lower(p_type)] AS mesh_terms, [p_brand] AS keywords,
       CASE WHEN p_type = 'SMALL' THEN 'book' ELSE 'journal' END AS source_type,
       (p_type = 'ECONOMY' AND p_size = 1) AS is_retracted, p_partkey AS seq
FROM part"""
)
role("metrics")(
    """
SELECT CAST(l_partkey AS VARCHAR) AS pmid, count(*) AS citation_count,
       CASE WHEN min(CAST(round(l_discount * 100) AS BIGINT)) > 0
            THEN sum(CAST(round(l_discount * 100) AS BIGINT)) * CAST(0.3 AS DOUBLE) / count(*) END AS relative_citation_ratio,
       count(*) FILTER (l_returnflag = 'R') < 10 AS is_research_article
FROM lineitem GROUP BY l_partkey HAVING max(l_extendedprice) > 90000"""
)
role("part_candidates", "part_records", "merged_hits", "metrics")(
    """
SELECT r.*, coalesce(h.found_by, CAST([] AS VARCHAR[])) AS found_by, coalesce(h.best_rank, 0) AS best_rank,
       m.pmid IS NOT NULL AS metrics_known, coalesce(m.citation_count, 0) AS citation_count,
       m.relative_citation_ratio AS rcr, coalesce(m.is_research_article, TRUE) AS is_research_article
FROM part_records r LEFT JOIN merged_hits h USING (pmid) LEFT JOIN metrics m USING (pmid)"""
)
role("document_papers")(
    """
SELECT CAST(doc_id AS VARCHAR) AS pmid, split_part(text, chr(10), 1) AS title, text AS abstract,
       source AS journal, 1990 + n_chars % 36 AS year,
       CASE WHEN lang = 'en' THEN 'PMC' || doc_id END AS pmcid,
       coalesce(toxic = 1, FALSE) AS is_retracted,
       list_filter([source, CASE WHEN n_chars > 400 THEN lang END, CASE WHEN n_chars > 800 THEN 'long' END],
                   lambda x: x IS NOT NULL) AS found_by,
       n_chars % 50 AS best_rank, doc_id AS seq, lang
FROM documents LEFT JOIN labels USING (doc_id)"""
)
role("findings")(
    """
SELECT CAST(l_orderkey AS VARCHAR) AS pmid, row, p_name AS predictor,
       CASE WHEN t = 0 THEN '' ELSE lower(p_type) || ' outcome' END AS outcome,
       lower(p_type) AS operationalization, 'wave ' || l_linenumber AS timing,
       CASE l_returnflag WHEN 'A' THEN 'observational_association' WHEN 'N' THEN 'randomized_intervention' ELSE 'outcome_definition' END AS evidence_type,
       CASE WHEN t < 8 THEN q / 10 END AS effect,
       CASE l_returnflag WHEN 'A' THEN 'OR' WHEN 'N' THEN 'HR' ELSE 'mean difference' END AS effect_measure,
       CASE WHEN t < 8 THEN printf('%.1f (95%% CI %.1f to %.1f)', q / 10, (q - d) / 10, (q + d + t) / 10) ELSE '' END AS effect_raw,
       CASE WHEN t < 8 THEN (q - d) / 10 END AS ci_low, CASE WHEN t < 8 THEN (q + d + t) / 10 END AS ci_high,
       '0.0' || CAST(d AS INTEGER) AS p_value,
       CASE WHEN l_linestatus = 'F' THEN 'increases' WHEN l_returnflag = 'R' THEN 'decreases' WHEN l_returnflag = 'N' THEN 'none' ELSE 'unclear' END AS direction,
       CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence,
       CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'N' THEN FALSE END AS adjusted,
       CASE WHEN l_returnflag = 'R' THEN 'Nobody wrote of ' || p_name
            ELSE 'In wave ' || l_linenumber || ' row ' || row || ' the ' || p_name END AS quote,
       'In wave ' || l_linenumber || ' row ' || row || ' the ' || p_name || ' effect was ' ||
         printf('%.1f (95%% CI %.1f to %.1f; p = 0.0%d).', CASE WHEN l_linestatus = 'F' THEN q ELSE q + 1 END / 10, (q - d) / 10, (q + d + t) / 10, CAST(d AS INTEGER)) AS sentence,
       CAST(d AS INTEGER) AS d
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS row,
             CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS q, CAST(round(l_discount * 100) AS DOUBLE) AS d, CAST(round(l_tax * 100) AS DOUBLE) AS t
      FROM lineitem) JOIN part ON l_partkey = p_partkey"""
)
role("source_texts", "findings")(
    """
SELECT pmid, '## RESULTS' || chr(10) || string_agg(sentence, chr(10) ORDER BY row) AS text
FROM findings GROUP BY pmid"""
)
role("order_papers")(
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS pmid, 'Study | of order ' || o_orderkey AS title,
       'A "short" note on order ' || o_orderkey AS description, 'Orders Weekly' AS journal,
       CAST(year(o_orderdate) AS INTEGER) AS year, [c_name || ' AB', 'Li C'] AS authors,
       CASE WHEN o_orderstatus = 'F' THEN 'PMC' || o_orderkey END AS pmcid, {SLUG} AS domain,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'randomized_trial' WHEN '2-HIGH' THEN 'prospective_cohort'
            WHEN '3-MEDIUM' THEN 'case_control' WHEN '4-NOT SPECIFIED' THEN 'unclear' ELSE 'cross_sectional' END AS design,
       lower(o_orderpriority) AS study_design,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 100) AS INTEGER) END AS n,
       CASE WHEN o_orderstatus = 'F' THEN 'full_text' ELSE 'abstract' END AS basis,
       CASE o_orderstatus WHEN 'F' THEN 'CC BY' WHEN 'O' THEN 'cc-by-nc' ELSE '' END AS license,
       o_orderpriority <> '5-LOW' AS has_covariates, [lower(o_orderstatus), 'orders'] AS tags,
       'Order ' || o_orderkey || ' was placed. It shipped.' AS bottom_line, 'customers' AS population,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'delivery' END AS outcome_definition,
       CASE WHEN o_orderstatus = 'O' THEN 'Small sample.' ELSE '' END AS caveats,
       '# Aim: order.' || chr(10) || chr(10) || 'Methods: ' || lower(o_orderpriority) AS abstract,
       o_orderdate AS generated_at,
       CAST(o_orderkey AS VARCHAR) || '_' || replace(c_name, '#', '-') || '.md' AS filename
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
role("interactions", "findings")(
    """
SELECT pmid, row, 1 AS seq, feature,
       ['correlated','modifies','confounds','mediates','derived_from','mutually_exclusive'][least(d, 5) + 1] AS kind,
       CASE WHEN d > 0 THEN 'Pearson r' ELSE '' END AS measure,
       CASE WHEN d > 0 THEN CAST(d AS DOUBLE) / 10 END AS value,
       CASE WHEN d > 0 THEN printf('r = %.1f', CAST(d AS DOUBLE) / 10) ELSE '' END AS measure_raw
FROM (SELECT *, lead(predictor) OVER (PARTITION BY pmid ORDER BY row) AS feature FROM findings)
WHERE feature IS NOT NULL"""
)
role("null_findings", "findings")(
    """
SELECT pmid, row AS seq, CASE WHEN direction = 'none' THEN predictor ELSE 'None reported ' END AS predictor,
       CASE WHEN direction = 'none' THEN outcome ELSE '' END AS outcome,
       CASE WHEN direction = 'none' THEN timing ELSE '' END AS detail,
       CASE WHEN direction = 'none' THEN quote ELSE '' END AS quote
FROM findings WHERE direction = 'none' OR row = 1"""
)
role("codes", "findings")(
    """
SELECT pmid, row AS seq, predictor AS concept, 'ICD-10' AS system, printf('%.1f', effect) AS code
FROM findings WHERE effect IS NOT NULL"""
)
role("verdicts")(
    f"""
SELECT CAST(c_custkey AS VARCHAR) AS pmid, c_mktsegment <> 'MACHINERY' AS include,
       CASE WHEN c_acctbal > 7500 THEN 3 WHEN c_acctbal > 4500 THEN 2 WHEN c_acctbal > 1500 THEN 1 ELSE 0 END AS relevance,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'not a topic' ELSE {SLUG} END AS topic,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'low' ELSE 'medium' END AS confidence,
       c_acctbal AS score, c_name AS name, c_mktsegment AS segment, {SLUG} AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
role("event_log")(
    """
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS call_id, event_type AS role,
       CASE WHEN event_type <> 'error' THEN value END AS usd,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens,
       CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS completion_tokens, ts AS at
FROM events"""
)
