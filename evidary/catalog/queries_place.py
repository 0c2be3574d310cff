"""Topics, offers, decisions, bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidary.catalog import roles, sql_text as q
from evidary.catalog.registry import query
from evidary.catalog.roles import BOUNDS, table
from evidary.catalog.roles_sql import with_roles
from evidary.functions import text as T
from evidary.functions.labels import borderline
from evidary.operators import placement as P, queryplan, ranking, reports
from evidary.operators.common import numbered
from evidary.session import durable, scratch_path


def papers(spark, sf):
    """Customers as candidates: segment words as title, region by balance as affinity."""
    v = roles.verdicts(spark, sf)
    return v.select(
        "pmid",
        F.when(F.col("segment") == "BUILDING", F.col("region")).otherwise(F.lit("")).alias("topic"),
        T.text_tokens(F.concat_ws(" ", F.col("segment"), F.when(F.col("score") > 0, F.replace("region", F.lit("-"), F.lit("_"))), F.lit("small"))).alias("tokens"),
    )


def assigned(spark, sf):
    topics = roles.topics(spark, sf)
    placed = P.assign_topics(roles.verdicts(spark, sf), papers(spark, sf), topics)
    pool = ranking.with_positions(roles.verdicts(spark, sf).filter("score > 0").select("pmid", "score"))
    return durable(P.curation_order(placed, pool))


_ASSIGNED = f"""
WITH cand AS (SELECT v.*, CASE WHEN segment = 'BUILDING' THEN region ELSE '' END AS affinity,
    {q.tokens("segment || ' ' || CASE WHEN score > 0 THEN replace(region, '-', '_') || ' ' ELSE '' END || 'small'")} AS tokens FROM verdicts v),
tt AS (SELECT ord, slug, {q.tokens("title || ' ' || scope || ' ' || array_to_string(seed_terms, ' ')")} AS tokens FROM topics),
near AS (SELECT pmid, arg_max(slug, sim - ord * 1e-9) FILTER (sim > 0) AS nearest FROM (SELECT c.pmid, t.ord, t.slug, {q.jaccard("c.tokens", "t.tokens")} AS sim FROM cand c, tt t) GROUP BY pmid),
pool AS (SELECT pmid, row_number() OVER (ORDER BY score DESC, pmid) - 1 AS position FROM verdicts WHERE score > 0),
assigned AS (SELECT c.* EXCLUDE (topic), coalesce(CASE WHEN c.topic IN (SELECT slug FROM topics) THEN c.topic END, nullif(affinity, ''), nearest, '') AS topic, p.position,
    row_number() OVER (ORDER BY -relevance, coalesce(p.position, 4611686018427387904), c.pmid) AS rk
  FROM cand c JOIN near USING (pmid) LEFT JOIN pool p ON p.pmid = c.pmid),
offered AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rk) AS offer FROM assigned WHERE include AND topic <> '') WHERE offer <= {3 * BOUNDS.ceiling}),
decided AS (SELECT o.*, CASE WHEN topic = 'europe' THEN TRUE WHEN segment = 'FURNITURE' THEN FALSE ELSE score > 0 END AS keep,
    CASE WHEN topic = 'europe' THEN 'curation unavailable' WHEN segment = 'FURNITURE' THEN 'the curator did not answer' ELSE name END AS rationale FROM offered o),
reserved AS (SELECT a.topic, a.pmid, a.rk, CASE WHEN NOT d.keep THEN 2 WHEN d.pmid IS NOT NULL THEN NULL WHEN a.include THEN 0
    WHEN (NOT a.include AND a.relevance >= 2) OR (a.include AND a.confidence = 'low') THEN 1 END AS tier
  FROM assigned a LEFT JOIN decided d USING (pmid) WHERE a.topic <> '')"""


def _sql(tail: str) -> str:
    return with_roles(f"{_ASSIGNED}\n{tail}", "verdicts", "topics")


@query(
    "included_verdicts",
    "D4 C49",
    with_roles("SELECT pmid, relevance, confidence = 'low' AS borderline FROM verdicts WHERE include", "verdicts"),
)
def included_verdicts(spark, sf):
    return P.included(roles.verdicts(spark, sf)).select("pmid", "relevance", "borderline")


@query("topic_assignment", "E6 E7", _sql("SELECT pmid, topic FROM assigned WHERE topic <> ''"))
def topic_assignment(spark, sf):
    return P.assign_topics(roles.verdicts(spark, sf), papers(spark, sf), roles.topics(spark, sf)).select("pmid", "topic")


@query(
    "curation_order",
    "G2",
    _sql("SELECT pmid, relevance, coalesce(position, -1) AS position, row_number() OVER (ORDER BY rk) AS place FROM assigned WHERE topic <> ''"),
)
def curation_order(spark, sf):
    # The dense place is for show.
    return numbered(assigned(spark, sf), ["order"], "place").select(
        "pmid",
        "relevance",
        F.when(F.col("order.position") < 2**62, F.col("order.position")).otherwise(-1).alias("position"),
        (F.col("place") + 1).alias("place"),
    )


def offered(spark, sf, rows=None):
    return P.offers(assigned(spark, sf) if rows is None else rows, BOUNDS.ceiling)


def decided(spark, sf, rows=None):
    rows = offered(spark, sf, rows)
    answers = rows.filter("segment <> 'FURNITURE'").select(
        "topic", "pmid", (F.col("score") > 0).alias("keep"), F.col("name").alias("rationale")
    )
    failed = spark.createDataFrame([("europe",)], "topic string")
    return durable(P.reconcile_decisions(rows, answers, failed))


@query("offers", "H5", _sql("SELECT topic, pmid, offer FROM offered"))
def offers(spark, sf):
    return offered(spark, sf).select("topic", "pmid", "offer")


@query("curation_decisions", "E8", _sql("SELECT topic, pmid, keep, rationale FROM decided"))
def curation_decisions(spark, sf):
    return decided(spark, sf).select("topic", "pmid", "keep", "rationale")


@query("reserve_queue", "H6", _sql("SELECT topic, pmid, tier FROM reserved WHERE tier IS NOT NULL"))
def reserve_queue(spark, sf):
    rows = assigned(spark, sf)
    return P.reserve(rows, decided(spark, sf, rows)).select("topic", "pmid", "tier")


_PLACED = f"""
, held0 AS (SELECT * FROM (SELECT topic, pmid, rk, row_number() OVER (PARTITION BY topic ORDER BY rk) AS position, FALSE AS backfilled FROM decided WHERE keep) WHERE position <= {BOUNDS.ceiling}),
have AS (SELECT topic, count(*) AS n FROM held0 GROUP BY topic),
extra AS (SELECT r.topic, r.pmid, r.rk, coalesce(h.n, 0) + row_number() OVER (PARTITION BY r.topic ORDER BY r.tier, r.rk) AS position, TRUE AS backfilled
  FROM reserved r LEFT JOIN have h USING (topic) WHERE r.tier IS NOT NULL AND r.pmid NOT IN (SELECT pmid FROM held0)),
held AS (SELECT * FROM held0 UNION ALL SELECT * FROM extra WHERE position <= {BOUNDS.floor}),
cut AS (SELECT *, row_number() OVER (ORDER BY position DESC, topic DESC) AS turn FROM held WHERE position > {BOUNDS.floor}),
final AS (SELECT topic, pmid, backfilled, rk FROM held WHERE pmid NOT IN (SELECT pmid FROM cut WHERE turn <= greatest(0, (SELECT count(*) FROM held) - {BOUNDS.target})))"""


@query(
    "placement",
    "G3 G4 G5 G6",
    _sql(f"{_PLACED} SELECT topic, pmid, row_number() OVER (PARTITION BY topic ORDER BY rk) AS position, backfilled FROM final"),
)
def placement(spark, sf):
    rows = assigned(spark, sf)
    kept = decided(spark, sf, rows)
    return P.place(
        kept.filter("keep").select("topic", "pmid"),
        rows.select("pmid", "order"),
        roles.topics(spark, sf),
        BOUNDS,
        P.reserve(rows, kept),
    )


@query(
    "placement_accounting",
    "G3 G4 G5 G6",
    _sql(
        f"""{_PLACED} SELECT (SELECT count(*) FROM decided WHERE keep AND topic NOT IN (SELECT slug FROM topics)) AS unknown_topic,
  (SELECT count(*) FROM decided WHERE keep) - (SELECT count(DISTINCT pmid) FROM decided WHERE keep) AS duplicates,
  (SELECT count(*) FROM decided WHERE keep) - (SELECT count(*) FROM held0) AS over_ceiling,
  (SELECT count(*) FROM held WHERE backfilled) AS backfilled, (SELECT count(*) FROM held) - (SELECT count(*) FROM final) AS over_target,
  (SELECT count(*) FROM final) AS placed, greatest(0, (SELECT count(*) FROM final) - {BOUNDS.target}) AS above_target,
  greatest(0, {BOUNDS.target} - (SELECT count(*) FROM final)) AS below_target"""
    ),
)
def placement_accounting(spark, sf):
    rows = assigned(spark, sf)
    kept = decided(spark, sf, rows)
    return P.place_in_bounds(
        kept.filter("keep").select("topic", "pmid"), rows.select("pmid", "order"), roles.topics(spark, sf), BOUNDS, P.reserve(rows, kept)
    ).account


@query(
    "placement_gaps",
    "F16 C49",
    with_roles(
        f"""
WITH k AS (SELECT region AS topic, count(*) AS kept FROM verdicts WHERE segment = 'FURNITURE' AND relevance = 3 GROUP BY region)
SELECT t.slug AS topic, coalesce(kept, 0) AS kept, greatest(0, 1000 - coalesce(kept, 0)) AS shortfall, 'more on ' || t.slug AS missing
FROM topics t LEFT JOIN k ON k.topic = t.slug WHERE coalesce(kept, 0) < 1000""",
        "verdicts",
        "topics",
    ),
)
def placement_gaps(spark, sf):
    topics = roles.topics(spark, sf)
    placed = roles.verdicts(spark, sf).filter("segment = 'FURNITURE' and relevance = 3").select(
        F.col("region").alias("topic"), "pmid"
    )
    lacks = topics.select(F.col("slug").alias("topic"), F.concat(F.lit("more on "), "slug").alias("missing"))
    return P.gaps(placed, topics, 1000, lacks).select("topic", "kept", "shortfall", "missing")


@query(
    "taxonomy_capacity",
    "F16 Q9",
    """
SELECT count(*) AS topics, count(*) * 20 AS floor, count(*) * 60 AS ceiling,
  CASE WHEN count(*) > 4 THEN 'too many topics' ELSE '' END || CASE WHEN 150 > count(*) * 60 THEN ',target above capacity' ELSE '' END AS problems FROM region""",
)
def taxonomy_capacity(spark, sf):
    df = P.taxonomy_capacity(roles.topics(spark, sf), BOUNDS, max_topics=4)
    return df.withColumn("problems", F.array_join("problems", ","))


@query(
    "first_claims",
    "G3",
    with_roles(
        """
WITH k AS (SELECT CAST(s_suppkey AS VARCHAR) AS pmid, region AS topic FROM supplier JOIN verdicts ON s_nationkey % 5 = length(segment) % 5)
SELECT pmid, arg_min(topic, ord) AS topic, count(*) AS claims FROM k JOIN topics ON topic = slug GROUP BY pmid""",
        "verdicts",
        "topics",
    ),
)
def first_claims(spark, sf):
    v = roles.verdicts(spark, sf).select((F.length("segment") % 5).alias("m"), F.col("region").alias("topic"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("pmid"), (F.col("s_nationkey") % 5).alias("m"))
    # Verdicts of one remainder and topic claim the same suppliers, so they are counted before the join.
    counted = v.groupBy("m", "topic").agg(F.count("*").alias("claims"))
    return P.first_claim(s.join(counted, "m").select("pmid", "topic", "claims"), roles.topics(spark, sf))


@query(
    "planned_queries",
    "H7 D10",
    """
SELECT min(p_partkey) AS ord, p_name AS term, arg_min(p_brand, p_partkey) AS topic FROM part WHERE p_name <> '' GROUP BY p_name ORDER BY 1 LIMIT 12""",
)
def planned_queries(spark, sf):
    planned = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("term"), F.col("p_brand").alias("topic")
    )
    return queryplan.plan_queries(planned, 12)


@query(
    "gap_queries",
    "E20",
    with_roles(
        """
WITH g AS (SELECT ord, slug AS topic, lower(title) AS low, CASE WHEN ord % 2 = 0 THEN '"cold regions"[tiab] OR ' ELSE '' END AS lead FROM topics),
w AS (SELECT ord, topic, 'outcome AND (' || lead || '"' || low || '"[tiab] OR "small"[tiab] OR "medium"[tiab])' AS term FROM g)
SELECT ord, term, topic FROM w WHERE topic <> 'asia'""",
        "topics",
    ),
)
def gap_queries(spark, sf):
    topics = roles.topics(spark, sf)
    missing = F.when(F.col("ord") % 2 == 0, F.lit("the cold regions of the")).otherwise("")
    gaps = topics.select("ord", F.col("slug").alias("topic"), F.lit(3).alias("shortfall"), missing.alias("missing"))
    done = topics.filter("slug = 'asia'").select(
        F.lit('outcome AND ("cold regions"[tiab] OR "asia"[tiab] OR "small"[tiab] OR "medium"[tiab])').alias("term")
    )
    return queryplan.gap_queries(gaps, topics, done, base="outcome")


@query(
    "empty_searches",
    "D10",
    """
SELECT count(*) AS queries, count(*) FILTER (n = 0) AS empty, CASE WHEN count(*) FILTER (n = 0) = 0 THEN 'none empty'
  WHEN count(*) FILTER (n = 0) = count(*) THEN 'all empty' ELSE 'some empty' END AS state
FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""",
)
def empty_searches(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("count"))
    asked = table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left")
    return reports.empty_query_report(asked.withColumn("count", F.coalesce("count", F.lit(0).cast("long"))))


@query(
    "blank_readings",
    "D5",
    """
SELECT p_partkey FROM part WHERE p_type <> 'SMALL' OR p_size > 10 OR p_brand <> 'Brand#1'""",
)
def blank_readings(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_type") == "SMALL", " ").otherwise(F.col("p_type")).alias("description"),
        F.when(F.col("p_size") > 10, "yes").otherwise("").alias("bottom_line"),
        F.when(F.col("p_brand") == "Brand#1", F.array().cast("array<string>")).otherwise(F.array("p_name")).alias("predictors"),
    )
    return P.nonblank(df).select("p_partkey")


@query(
    "readings_to_make",
    "E19",
    """
SELECT CAST(d.doc_id AS VARCHAR) AS pmid, substr(sha256(concat(text, chr(0))), 1, 16) AS fingerprint FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 WHERE l.doc_id IS NULL""",
)
def readings_to_make(spark, sf):
    from evidary.functions.labels import fingerprint

    wanted = table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("pmid"), fingerprint("text").alias("fingerprint")
    )
    held = wanted.join(table(spark, sf, "labels"), "doc_id").select(
        "pmid", "fingerprint", (F.col("quality") == 0).alias("blank")
    )
    return queryplan.readings_to_make(wanted.drop("doc_id"), held)


@query(
    "readings_kept",
    "E19",
    """WITH w AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS pmid, substr(sha256(concat(text, chr(0))), 1, 16) AS fingerprint, n_chars, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT pmid, fingerprint, coalesce(quality = 1, FALSE) OR (n_chars % 9 <> 0 AND n_chars % 5 <> 0) AS reused FROM w""",
)
def readings_kept(spark, sf):
    """Readings cached by one run, what it lacked read and appended, and what the next run reuses: not what came back blank or failed."""
    from evidary.functions.labels import fingerprint

    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pmid"), fingerprint("text").alias("fingerprint"), "n_chars")
    wanted = docs.select("pmid", "fingerprint", "n_chars")
    cache = scratch_path(spark, "readings")
    first = docs.join(table(spark, sf, "labels"), "doc_id").select("pmid", "fingerprint", (F.col("quality") == 0).alias("blank"), F.lit(False).alias("failed"))
    queryplan.append_readings(first, cache)
    made = queryplan.readings_to_make(wanted, spark.read.parquet(cache))
    read = made.select("pmid", "fingerprint", (F.col("n_chars") % 9 == 0).alias("blank"), (F.col("n_chars") % 5 == 0).alias("failed"))
    queryplan.append_readings(durable(read), cache)
    kept = spark.read.parquet(cache)
    reused = queryplan.readings_reused(wanted, kept).select("pmid", "fingerprint", F.lit(True).alias("reused")).distinct()
    again = queryplan.readings_to_make(wanted, kept).select("pmid", "fingerprint", F.lit(False).alias("reused"))
    return reused.unionByName(again)


__all__ = ["assigned", "borderline", "decided", "offered", "papers"]
