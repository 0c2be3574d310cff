"""Merging, ranking and selecting."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidary import fixed
from evidary.catalog import roles, sql_text as q
from evidary.catalog.registry import query
from evidary.catalog.roles import NOW_YEAR, POOL_SIZE, table
from evidary.catalog.roles_sql import with_roles
from evidary.operators import merge, ranking
from evidary.plans import dry_run


def candidates(spark, sf):
    """Parts with their hits and metrics."""
    found = merge.attach_hits(roles.part_records(spark, sf), roles.hits(spark, sf))
    return merge.attach_metrics(found, roles.metrics(spark, sf))


def scored(spark, sf):
    rows = ranking.score(merge.screenable(candidates(spark, sf)), NOW_YEAR)
    return ranking.topic_affinity(ranking.with_tokens(rows), roles.plan(spark, sf))


_PARTS = f"""
SELECT *, 0.25 * least(1.0, greatest(0, len(found_by) - 1) / 2.0) AS s_agreement,
  0.30 * (1.0 / (1.0 + best_rank / 10.0)) AS s_position,
  0.15 * least(1.0, greatest(0.0, (year - {NOW_YEAR - 20}) / 20.0)) AS s_recency,
  0.15 * CASE WHEN NOT metrics_known THEN 0.5 WHEN rcr IS NOT NULL THEN least(1.0, greatest(0.0, rcr / 3.0))
              WHEN {NOW_YEAR} - year <= 2 THEN 0.5 ELSE least(1.0, ln(1.0 + citation_count) / ln(201.0)) END AS s_citation,
  0.10 * CASE WHEN trim(abstract) <> '' THEN 1.0 ELSE 0.0 END AS s_abstract,
  0.05 * CASE WHEN list_has_any(publication_types, {q.words(fixed.NON_RESEARCH_TYPES)}) THEN 0.0 WHEN source_type <> 'journal' THEN 0.3
              WHEN is_research_article THEN 1.0 ELSE 0.7 END AS s_article
FROM part_candidates"""
_SCORED = f"""
WITH parts AS ({_PARTS}),
affinity AS (SELECT * EXCLUDE (topic_ord), row_number() OVER (PARTITION BY pmid ORDER BY topic_ord) AS rn FROM (
  SELECT p.pmid, pl.topic, pl.ord AS topic_ord FROM part_candidates p, unnest(p.found_by) AS u(term) JOIN plan pl ON pl.term = u.term)),
scored AS (SELECT parts.*, s_agreement + s_position + s_recency + s_citation + s_abstract + s_article AS score, coalesce(a.topic, '') AS topic
  FROM parts LEFT JOIN affinity a ON a.pmid = parts.pmid AND a.rn = 1 WHERE NOT is_retracted AND trim(abstract) <> ''),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, pmid) - 1 AS position FROM scored)"""


def _sql(tail: str) -> str:
    return with_roles(f"{_SCORED}\n{tail}", "part_candidates", "plan")


@query(
    "merged_sightings",
    "F1 E1 I2",
    with_roles(
        """
SELECT r.pmid, array_to_string(coalesce(h.found_by, CAST([] AS VARCHAR[])), ',') AS found_by, coalesce(h.best_rank, 0) AS best_rank
FROM part_records r LEFT JOIN merged_hits h USING (pmid)""",
        "part_records",
        "merged_hits",
    ),
)
def merged_sightings(spark, sf):
    df = merge.attach_hits(roles.part_records(spark, sf), roles.hits(spark, sf))
    return df.select("pmid", F.array_join("found_by", ",").alias("found_by"), "best_rank")


_ROUND = """
SELECT pmid, list(term ORDER BY term_ord) AS found_by, min(rank) AS best_rank FROM
  (SELECT pmid, term, term_ord, min(rank) AS rank FROM hits WHERE {} GROUP BY ALL) GROUP BY pmid"""


@query(
    "merged_rounds",
    "I2",
    with_roles(
        f"""
WITH a AS ({_ROUND.format("rank <= 10")}), b AS ({_ROUND.format("rank > 8")})
SELECT r.pmid, array_to_string(list_concat(coalesce(a.found_by, []), list_filter(coalesce(b.found_by, []), lambda x: NOT list_contains(coalesce(a.found_by, []), x))), ',') AS found_by,
  least(coalesce(a.best_rank, 0), coalesce(b.best_rank, 0)) AS best_rank, r.title, coalesce(r.pmcid, '') AS pmcid
FROM part_records r LEFT JOIN a USING (pmid) LEFT JOIN b USING (pmid)""",
        "hits",
        "part_records",
    ),
)
def merged_rounds(spark, sf):
    hits, records = roles.hits(spark, sf), roles.part_records(spark, sf)
    first = merge.attach_hits(records.withColumn("pmcid", F.lit(None).cast("string")), hits.filter("rank <= 10"))
    second = merge.attach_hits(records.withColumn("title", F.lit("another title")), hits.filter("rank > 8"))
    return merge.merge_rounds(first, second).select(
        "pmid", F.array_join("found_by", ",").alias("found_by"), "best_rank", "title", F.coalesce("pmcid", F.lit("")).alias("pmcid")
    )


_TITLES = f"""
WITH keep AS (SELECT *, {q.norm_title("title")} AS k FROM document_papers WHERE NOT is_retracted AND trim(abstract) <> ''),
g AS (SELECT * FROM keep WHERE k <> ''),
firsts AS (SELECT k, term, min(seq) AS seen FROM (SELECT k, seq, unnest(found_by) AS term FROM g) GROUP BY k, term),
opens AS (SELECT k, seen AS seq, count(*) AS fresh FROM firsts GROUP BY k, seen),
pre AS (SELECT g.*, coalesce(sum(coalesce(o.fresh, 0)) OVER w, 0) AS u_terms, min(best_rank) OVER w AS u_rank, max(CAST(pmcid IS NOT NULL AS INTEGER)) OVER w AS u_pmc,
          row_number() OVER (PARTITION BY g.k ORDER BY g.seq) AS place
        FROM g LEFT JOIN opens o ON o.k = g.k AND o.seq = g.seq
        WINDOW w AS (PARTITION BY g.k ORDER BY g.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
led AS (SELECT *, place = 1 OR (len(found_by) > u_terms OR (len(found_by) = u_terms AND (best_rank < u_rank OR
          (best_rank = u_rank AND CAST(pmcid IS NOT NULL AS INTEGER) > u_pmc)))) AS wins FROM pre),
prio AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN wins THEN 0 ELSE 1 END, CASE WHEN wins THEN -place ELSE place END) AS p FROM led),
terms AS (SELECT k, term, min(p * 100 + i) AS o FROM (SELECT k, p, unnest(found_by) AS term, generate_subscripts(found_by, 1) AS i FROM prio) GROUP BY k, term),
lists AS (SELECT k, string_agg(term, ',' ORDER BY o) AS found_by FROM terms GROUP BY k),
merged AS (SELECT k, arg_min(pmid, p) AS pmid, arg_min(title, p) AS title, min(best_rank) AS best_rank, arg_min(pmcid, p) FILTER (pmcid IS NOT NULL) AS pmcid,
             arg_min(year, p) AS year, count(*) - 1 AS absorbed FROM prio GROUP BY k)"""


@query(
    "folded_titles",
    "F2 D1",
    with_roles(
        f"""{_TITLES}
SELECT pmid, title, best_rank, coalesce(pmcid, '') AS pmcid, year, absorbed, coalesce(l.found_by, '') AS found_by FROM merged LEFT JOIN lists l USING (k)
UNION ALL SELECT pmid, title, best_rank, coalesce(pmcid, ''), year, 0, array_to_string(found_by, ',') FROM keep WHERE k = ''""",
        "document_papers",
    ),
)
def folded_titles(spark, sf):
    merged = merge.merge_titles(merge.screenable(roles.document_papers(spark, sf)))
    return merged.select(
        "pmid", "title", "best_rank", F.coalesce("pmcid", F.lit("")).alias("pmcid"), "year", "absorbed",
        F.array_join("found_by", ",").alias("found_by"),
    )


@query(
    "drop_counts",
    "F3 D1 A10",
    with_roles(
        f"""{_TITLES},
c AS (SELECT count(*) AS candidates, count(*) FILTER (is_retracted) AS retracted, count(*) FILTER (NOT is_retracted AND trim(abstract) = '') AS no_abstract FROM document_papers),
d AS (SELECT coalesce(sum(absorbed), 0) AS duplicate_title FROM merged)
SELECT candidates, retracted, no_abstract, CAST(duplicate_title AS BIGINT) AS duplicate_title, CAST(retracted + no_abstract + duplicate_title AS BIGINT) AS lost,
  retracted + no_abstract + duplicate_title > candidates // 3 AS over_a_third FROM c, d""",
        "document_papers",
    ),
)
def drop_counts(spark, sf):
    papers = roles.document_papers(spark, sf)
    return merge.drop_counts(papers, merge.merge_titles(merge.screenable(papers)))


@query(
    "citation_enrichment",
    "E2",
    with_roles(
        """
SELECT pmid, metrics_known, citation_count, coalesce(round(rcr, 6), -1.0) AS rcr, is_research_article FROM part_candidates""",
        "part_candidates",
    ),
)
def citation_enrichment(spark, sf):
    df = candidates(spark, sf)
    return df.select(
        "pmid", "metrics_known", "citation_count",
        F.coalesce(F.round("rcr", 6), F.lit(-1.0)).alias("rcr"), "is_research_article",
    )


@query(
    "citation_fallback",
    "E3",
    with_roles(
        """
WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS pmid, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT r.pmid, c.n IS NOT NULL AS metrics_known, coalesce(c.n, 0) AS citation_count FROM part_records r LEFT JOIN c USING (pmid)""",
        "part_records",
    ),
)
def citation_fallback(spark, sf):
    links = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("pmid"))
        .agg(F.count("*").alias("cited_by"))
    )
    none = spark.createDataFrame([], roles.metrics(spark, sf).schema)
    df = merge.attach_metrics_or_counts(roles.part_records(spark, sf), none, links)
    return df.select("pmid", "metrics_known", "citation_count")


@query(
    "missing_ids",
    "I3",
    """
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS pmid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def missing_ids(spark, sf):
    as_id = lambda t: table(spark, sf, t).select(F.col("doc_id").cast("string").alias("pmid"))
    return merge.missing_ids(as_id("documents"), as_id("labels"))


@query(
    "relevance_scores",
    "C4 C5 C6 C7 C8 C9",
    _sql(
        """SELECT pmid, round(CAST(s_agreement AS DOUBLE), 6) AS agreement, round(CAST(s_position AS DOUBLE), 6) AS position, round(CAST(s_recency AS DOUBLE), 6) AS recency,
  round(CAST(s_citation AS DOUBLE), 6) AS citation, round(CAST(s_abstract AS DOUBLE), 6) AS abstract, round(CAST(s_article AS DOUBLE), 6) AS article, round(CAST(score AS DOUBLE), 6) AS score FROM scored"""
    ),
)
def relevance_scores(spark, sf):
    parts = [F.round(F.col(f"components.{p}"), 6).alias(p) for p in fixed.RELEVANCE_WEIGHTS]
    return scored(spark, sf).select("pmid", *parts, F.round("score", 6).alias("score"))


@query("score_positions", "G1", _sql("SELECT pmid, position, round(CAST(score AS DOUBLE), 6) AS score FROM ranked"))
def score_positions(spark, sf):
    df = scored(spark, sf).withColumn("score", F.round("score", 9))
    return ranking.with_positions(df).select("pmid", "position", F.round("score", 6).alias("score"))


@query("pure_top", "H1", _sql(f"SELECT pmid, round(CAST(score AS DOUBLE), 6) AS score FROM ranked WHERE position < {POOL_SIZE}"))
def pure_top(spark, sf):
    df = scored(spark, sf).withColumn("score", F.round("score", 9))
    return ranking.pure_top(df, POOL_SIZE).select("pmid", F.round("score", 6).alias("score"))


@query("topic_affinity", "E4", _sql("SELECT pmid, topic FROM scored"))
def topic_affinity(spark, sf):
    return scored(spark, sf).select("pmid", "topic")


_QUOTA = f"""
, groups AS (SELECT count(DISTINCT topic) AS n FROM ranked),
firsts AS (SELECT r.* FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY position) AS rn FROM ranked) r, groups
           WHERE rn <= greatest(1, ceil({POOL_SIZE} / n))),
rest AS (SELECT r.*, row_number() OVER (ORDER BY position) AS rn FROM ranked r WHERE pmid NOT IN (SELECT pmid FROM firsts)),
taken AS (SELECT pmid, position, topic FROM firsts UNION ALL
          SELECT pmid, position, topic FROM rest WHERE rn <= greatest(0, {POOL_SIZE} - (SELECT count(*) FROM firsts))),
pool AS (SELECT * FROM taken ORDER BY position LIMIT {POOL_SIZE})"""


@query("quota_selection", "H3", _sql(f"{_QUOTA} SELECT pmid, topic FROM pool"))
def quota_selection(spark, sf):
    df = scored(spark, sf).withColumn("score", F.round("score", 9))
    return ranking.quota_select(df, POOL_SIZE, lambda_=1.0).select("pmid", "topic")


@query(
    "selection_comparison",
    "I1 F4",
    _sql(
        f"""{_QUOTA}, both_ AS (SELECT coalesce(p.topic, d.topic) AS topic, p.pmid AS a, d.pmid AS b
  FROM (SELECT * FROM ranked WHERE position < {POOL_SIZE}) p FULL JOIN pool d ON p.pmid = d.pmid)
SELECT CASE WHEN topic = '' THEN '(unassigned)' ELSE topic END AS topic, count(a) AS pure, count(b) AS diversified,
  count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS dropped, count(b) > count(a) AS helped FROM both_ GROUP BY topic"""
    ),
)
def selection_comparison(spark, sf):
    df = scored(spark, sf).withColumn("score", F.round("score", 9))
    pure = ranking.pure_top(df, POOL_SIZE)
    spread = ranking.quota_select(df, POOL_SIZE, lambda_=1.0)
    return ranking.selection_by_topic(ranking.compare_selections(pure, spread))


# The greedy order of every topic, one pick a step: the rest carry their greatest similarity to what is picked.
_LAMBDA = f"CAST({fixed.DEFAULT_LAMBDA} AS DOUBLE)"
_BEST = "row_number() OVER (PARTITION BY topic ORDER BY {l} * score - (1.0::DOUBLE - {l}) * {c} DESC, score DESC, pmid)".replace("{l}", _LAMBDA)


def _recursive(sql: str) -> str:
    """Spell out that one of the tables refers to itself."""
    return sql.replace("WITH", "WITH RECURSIVE", 1)


# Titles folded before scoring, then a walk within each topic, a walk over what is left, and the cut.
_TOKENS = q.tokens("title || ' ' || array_to_string(mesh_terms, ' ') || ' ' || array_to_string(keywords, ' ')")


def _walk(name: str, source: str, picks: str) -> str:
    """A greedy walk over the groups of ``source``, one pick a step, as a recursive table."""
    best = _BEST.replace("PARTITION BY topic", "PARTITION BY grp")
    return f"""{name} AS (
  SELECT grp, pmid, topic, score, tokens, CAST(0 AS DOUBLE) AS closest, {best.replace("{c}", "CAST(0 AS DOUBLE)")} AS rn, 0 AS pick FROM {source}
  UNION ALL
  SELECT grp, pmid, topic, score, tokens, closest, {best.replace("{c}", "closest")} AS rn, pick + 1 AS pick
  FROM (SELECT w.grp, w.pmid, w.topic, w.score, w.tokens, greatest(w.closest, {q.jaccard("w.tokens", "b.tokens")}) AS closest, w.pick
        FROM {name} w JOIN {name} b ON b.grp = w.grp AND b.rn = 1 WHERE w.rn > 1 AND w.pick + 1 < ({picks})))"""


_FLAGSHIP = f"""
WITH RECURSIVE part_hits AS (SELECT r.*, coalesce(h.found_by, CAST([] AS VARCHAR[])) AS found_by, coalesce(h.best_rank, 0) AS best_rank FROM part_records r LEFT JOIN merged_hits h USING (pmid)),
{_TITLES.replace("document_papers", "part_hits").replace("WITH ", "", 1)},
told_terms AS (SELECT k, list(term ORDER BY o) AS found_by FROM terms GROUP BY k),
uniques AS (SELECT r.* EXCLUDE (found_by, best_rank, pmcid), m.pmcid, coalesce(l.found_by, CAST([] AS VARCHAR[])) AS found_by, m.best_rank FROM merged m JOIN part_hits r USING (pmid) LEFT JOIN told_terms l USING (k)),
part_candidates AS (SELECT u.*, m.pmid IS NOT NULL AS metrics_known, coalesce(m.citation_count, 0) AS citation_count, m.relative_citation_ratio AS rcr,
  coalesce(m.is_research_article, TRUE) AS is_research_article FROM uniques u LEFT JOIN metrics m USING (pmid)),
{_SCORED.replace("WITH ", "", 1)},
told AS (SELECT topic AS grp, pmid, topic, CAST(round(score, 9) AS DOUBLE) AS score, {_TOKENS} AS tokens FROM scored),
{_walk("walk", "told", f"SELECT greatest(1, ceil({POOL_SIZE} / count(DISTINCT topic))) FROM told")},
quota AS (SELECT pmid FROM walk WHERE rn = 1),
others AS (SELECT '' AS grp, * EXCLUDE (grp) FROM told WHERE pmid NOT IN (SELECT pmid FROM quota)),
{_walk("more", "others", f"SELECT {POOL_SIZE} - count(*) FROM quota")},
pool AS (SELECT pmid, topic FROM told WHERE pmid IN (SELECT pmid FROM quota)
   OR ((SELECT {POOL_SIZE} - count(*) FROM quota) > 0 AND pmid IN (SELECT pmid FROM more WHERE rn = 1)) ORDER BY score DESC, pmid LIMIT {POOL_SIZE}),
pure AS (SELECT pmid, topic FROM told ORDER BY score DESC, pmid LIMIT {POOL_SIZE}),
both_ AS (SELECT coalesce(p.topic, d.topic) AS topic, p.pmid AS a, d.pmid AS b FROM pure p FULL JOIN pool d ON p.pmid = d.pmid)
SELECT CASE WHEN topic = '' THEN '(unassigned)' ELSE topic END AS topic, count(a) AS pure, count(b) AS diversified,
  count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS dropped, count(b) > count(a) AS helped FROM both_ GROUP BY topic"""


@query("diversified_pool", "H2 H3 I1 F4 U6", with_roles(_FLAGSHIP, "part_records", "merged_hits", "metrics", "plan"))
def diversified_pool(spark, sf):
    """The flagship: hits and records to a diversified pool, compared with the pure one by topic."""
    return dry_run.dry_run(
        records=roles.part_records(spark, sf),
        hits=roles.hits(spark, sf),
        metrics=roles.metrics(spark, sf),
        plan=roles.plan(spark, sf),
        pool_size=POOL_SIZE,
        now_year=NOW_YEAR,
    ).comparison


@query(
    "diversified_order",
    "H2 U6",
    _recursive(
        _sql(
            f""", told AS (SELECT pmid, topic, CAST(round(score, 9) AS DOUBLE) AS score, {q.tokens("title || ' ' || array_to_string(mesh_terms, ' ') || ' ' || array_to_string(keywords, ' ')")} AS tokens FROM scored),
walk AS (
  SELECT *, CAST(0 AS DOUBLE) AS closest, {_BEST.replace("{c}", "CAST(0 AS DOUBLE)")} AS rn, 0 AS pick FROM told
  UNION ALL
  SELECT pmid, topic, score, tokens, closest, {_BEST.replace("{c}", "closest")} AS rn, pick + 1 AS pick
  FROM (SELECT w.pmid, w.topic, w.score, w.tokens, greatest(w.closest, {q.jaccard("w.tokens", "b.tokens")}) AS closest, w.pick
        FROM walk w JOIN walk b ON b.topic = w.topic AND b.rn = 1 WHERE w.rn > 1 AND w.pick < {POOL_SIZE - 1})
)
SELECT topic, pmid, pick FROM walk WHERE rn = 1"""
        )
    ),
)
def diversified_order(spark, sf):
    df = scored(spark, sf).withColumn("score", F.round("score", 9))
    return ranking.mmr_order(df, POOL_SIZE, group="topic")


@query(
    "basis_policy",
    "D2",
    _sql(
        f"""SELECT pmid, 'full-text' AS policy FROM (SELECT *, row_number() OVER (ORDER BY position) AS rn FROM ranked WHERE pmcid IS NOT NULL)
WHERE rn <= {POOL_SIZE} AND (journal NOT IN ('Brand#1', 'Brand#2') OR keywords[1] = 'Brand#2')
UNION ALL SELECT pmid, 'abstract' FROM ranked"""
    ),
)
def basis_policy(spark, sf):
    df = scored(spark, sf).withColumn("score", F.round("score", 9))
    checks = df.select(
        "pmid",
        F.when(F.col("journal") == "Brand#1", False).when(F.col("journal") == "Brand#2", None).otherwise(True).alias("available"),
    )
    full = ranking.apply_basis(df, "full-text", POOL_SIZE, checks)
    short = ranking.apply_basis(df, "abstract", POOL_SIZE)
    return full.select("pmid", F.lit("full-text").alias("policy")).unionByName(
        short.select("pmid", F.lit("abstract").alias("policy"))
    )


@query(
    "non_research",
    "I4",
    """SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_type = 'PROMO' AS not_research, CASE WHEN p_type = 'PROMO' THEN 'Editorial' ELSE 'Journal Article' END AS type FROM part""",
)
def non_research(spark, sf):
    records = roles.part_records(spark, sf)
    return records.select("pmid", merge.types_overlap("publication_types").alias("not_research"), F.get("publication_types", F.lit(0)).alias("type"))


@query(
    "screening_queue",
    "E5 H4",
    _sql(
        """, done AS (SELECT pmid FROM ranked WHERE journal = 'Brand#3')
SELECT pmid FROM ranked WHERE pmid NOT IN (SELECT pmid FROM done) ORDER BY position LIMIT greatest(0, 200 - (SELECT count(*) FROM done))"""
    ),
)
def screening_queue(spark, sf):
    df = scored(spark, sf).withColumn("score", F.round("score", 9))
    seen = df.filter("journal = 'Brand#3'").select("pmid")
    return ranking.screening_queue(df, seen, 200).select("pmid")


@query(
    "spend_projection",
    "F15 C40",
    _sql(
        f"""{_QUOTA}, p AS (SELECT r.* FROM ranked r SEMI JOIN pool USING (pmid)),
s AS (SELECT CAST(sum(CAST(floor(length(trim(title || chr(10) || chr(10) || abstract)) / 4.0) AS BIGINT) + 1) AS BIGINT) AS screening,
             CAST(sum(CAST(floor(length(title) / 4.0) AS BIGINT) + 1) AS BIGINT) AS titles FROM (SELECT * FROM p ORDER BY position LIMIT 40)),
e AS (SELECT CAST(sum(CAST(floor(length(abstract) / 4.0) AS BIGINT) + 1) AS BIGINT) AS abstracts, count(pmcid) AS linked FROM (SELECT * FROM p ORDER BY position LIMIT 50)),
x AS (SELECT *, abstracts // 50 AS a, linked / 50.0 * 0.6 AS share FROM e)
SELECT 0 AS ord, 'screen' AS node, 'fast' AS role, 40 AS calls, screening + 100 * 40 AS prompt_tokens, 80 * 40 AS completion_tokens,
  round((screening + 4000) / 1e6 * 1.0 + 3200 / 1e6 * 5.0, 6) AS usd FROM s
UNION ALL SELECT 1, 'curate', 'balanced', 5, 5 * (200 + 8 * (titles // 40 + 25)), 5 * 8 * 160, NULL FROM s
UNION ALL SELECT 2, 'extract', 'balanced', 50, 50 * (300 + CAST(floor(a * (1 - share) + least(a * 12.0, 6000.0) * share) AS BIGINT)), 50 * 5000, NULL FROM x"""
    ),
)
def spend_projection(spark, sf):
    from evidary.operators.spend import SpendPlan, project_spend

    df = scored(spark, sf).withColumn("score", F.round("score", 9))
    pool = ranking.quota_select(df, POOL_SIZE, lambda_=1.0)
    plan = SpendPlan(
        screen_budget=40, target=30, topics=5, floor=10, screen_prefix=100, curate_prefix=200, extract_prefix=300,
        prices={"fast": (1.0, 5.0)},
    )
    return project_spend(pool, plan).withColumn("usd", F.round("usd", 6))


@query(
    "dry_run_spend",
    "F15 C40",
    with_roles(
        _FLAGSHIP[: _FLAGSHIP.index("pure AS (")]
        + """p AS (SELECT title, abstract, pmcid, row_number() OVER (ORDER BY round(score, 9) DESC, pmid) - 1 AS position FROM scored SEMI JOIN pool USING (pmid)),
s AS (SELECT CAST(sum(CAST(floor(length(trim(title || chr(10) || chr(10) || abstract)) / 4.0) AS BIGINT) + 1) AS BIGINT) AS screening,
             CAST(sum(CAST(floor(length(title) / 4.0) AS BIGINT) + 1) AS BIGINT) AS titles FROM p WHERE position < 40),
e AS (SELECT CAST(sum(CAST(floor(length(abstract) / 4.0) AS BIGINT) + 1) AS BIGINT) AS abstracts, count(pmcid) AS linked FROM p WHERE position < 50),
x AS (SELECT *, abstracts // 50 AS a, linked / 50.0 * 0.6 AS share FROM e)
SELECT 0 AS ord, 'screen' AS node, 'fast' AS role, 40 AS calls, screening + 100 * 40 AS prompt_tokens, 80 * 40 AS completion_tokens,
  round((screening + 4000) / 1e6 * 1.0 + 3200 / 1e6 * 5.0, 6) AS usd FROM s
UNION ALL SELECT 1, 'curate', 'balanced', 5, 5 * (200 + 8 * (titles // 40 + 25)), 5 * 8 * 160, NULL FROM s
UNION ALL SELECT 2, 'extract', 'balanced', 50, 50 * (300 + CAST(floor(a * (1 - share) + least(a * 12.0, 6000.0) * share) AS BIGINT)), 50 * 5000, NULL FROM x""",
        "part_records",
        "merged_hits",
        "metrics",
        "plan",
    ),
)
def dry_run_spend(spark, sf):
    """What the diversified pool of a dry run would cost."""
    from evidary.operators.spend import SpendPlan

    plan = SpendPlan(
        screen_budget=40, target=30, topics=5, floor=10, screen_prefix=100, curate_prefix=200, extract_prefix=300,
        prices={"fast": (1.0, 5.0)},
    )
    run = dry_run.dry_run(
        records=roles.part_records(spark, sf), hits=roles.hits(spark, sf), metrics=roles.metrics(spark, sf), plan=roles.plan(spark, sf),
        pool_size=POOL_SIZE, now_year=NOW_YEAR, spend=plan,
    )
    return run.spend.withColumn("usd", F.round("usd", 6))
