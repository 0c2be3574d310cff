"""Phrase clusters and what recurs across papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidary import fixed
from evidary.catalog import roles, sql_text as q
from evidary.catalog.registry import query
from evidary.catalog.roles import table
from evidary.catalog.roles_sql import with_roles
from evidary.functions.labels import effect_cell
from evidary.operators.common import numbered
from evidary.operators import recurrence as R, reports
from evidary.session import cut


def phrases(spark, sf):
    """Part names with their type and brand as qualifiers, in several written forms."""
    form = (
        F.when(F.col("p_size") % 4 == 0, F.col("p_name"))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lower("p_type"), F.lit(" "), "p_name"))
        .when(F.col("p_size") % 4 == 2, F.concat("p_name", F.lit("s  ("), "p_type", F.lit(")")))
        .otherwise(F.concat(F.lower("p_type"), F.lit(" "), "p_name", F.lit(" treatment >= "), (F.col("p_size") % 3).cast("string")))
    )
    return table(spark, sf, "part").select(form.alias("phrase"), F.col("p_partkey").alias("ord"))


_FORM = """CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN lower(p_type) || ' ' || p_name
  WHEN 2 THEN p_name || 's (' || p_type || ')' ELSE lower(p_type) || ' ' || p_name || ' treatment >= ' || (p_size % 3) END"""
# The forms here keep to lower case outside parentheses and to initialisms inside them.
_SINGULAR = "list_transform({x}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|os|as)$') THEN substr(w, 1, length(w) - 1) ELSE w END)"
_KEY = "list_sort(list_distinct(" + _SINGULAR.format(x=q.tokens(r"regexp_replace(form, '[(][A-Z]+[)]', ' ', 'g')")) + "))"
_REFUSED = q.words(fixed.POLARITY_WORDS + fixed.INTERVENTION_WORDS)
_NUM = "array_to_string(list_sort(list_distinct(regexp_extract_all(form, '[0-9]+(?:[.][0-9]+)?'))), ' ')"
_BARE = "trim(regexp_replace(regexp_replace(first_form, '[<>≤≥=~]*[ ]*[0-9]+(?:[.][0-9]+)?[ ]*[a-zA-Z0-9_/%]*', ' ', 'g'), ' +', ' ', 'g'), ' ,;:-.')"


def _clusters(source: str) -> str:
    """Clusters by the sequential walk: nodes in order, each asks the accepted ones before it."""
    return f"""
WITH RECURSIVE src AS ({source}),
forms AS (SELECT *, {_KEY} AS key, {_NUM} AS nums FROM (SELECT form, count(*) AS n FROM src GROUP BY form)),
nodes AS (SELECT key, sum(n) AS total, arg_min(form, (-n, length(form), form)) AS first_form, min(nums) AS lo, max(nums) AS hi,
            arg_min(form, (-n, length(form), form)) FILTER (nums = '') AS plain FROM forms GROUP BY key),
ord AS (SELECT key, row_number() OVER (ORDER BY total DESC, CASE WHEN lo = hi THEN first_form ELSE coalesce(plain, {_BARE}) END) AS i FROM nodes),
edges AS (SELECT greatest(a.i, b.i) AS late, least(a.i, b.i) AS early FROM ord a JOIN ord b ON len(a.key) = len(b.key) + 1 AND len(list_intersect(a.key, b.key)) = len(b.key)
   WHERE len(list_filter(a.key, lambda w: NOT list_contains(b.key, w) AND length(w) > 2 AND NOT list_contains({_REFUSED}, w))) = 1),
walk AS (SELECT 0 AS i, CAST([] AS BIGINT[]) AS accepted, CAST(NULL AS BIGINT) AS host
  UNION ALL SELECT w.i + 1, CASE WHEN h.host IS NULL THEN list_append(w.accepted, w.i + 1) ELSE w.accepted END, h.host
  FROM walk w LEFT JOIN LATERAL (SELECT min(e.early) AS host FROM edges e WHERE e.late = w.i + 1 AND list_contains(w.accepted, e.early)) h ON TRUE
  WHERE w.i < (SELECT max(i) FROM ord)),
root AS (SELECT o.key, coalesce(w.host, o.i) AS r FROM ord o JOIN walk w ON w.i = o.i),
member AS (SELECT f.form, f.n, f.nums, r.r FROM forms f JOIN root r USING (key)),
labels AS (SELECT r, CASE WHEN lo = hi THEN first_form ELSE coalesce(plain, {_BARE}) END AS label FROM (
   SELECT r, arg_min(form, (-n, length(form), form)) AS first_form, min(nums) AS lo, max(nums) AS hi, arg_min(form, (-n, length(form), form)) FILTER (nums = '') AS plain FROM member GROUP BY r)),
named AS (SELECT m.form, m.n, l.label, m.r FROM member m JOIN labels l USING (r))"""


@query(
    "absorption_edges",
    "E14",
    f"""
WITH forms AS (SELECT DISTINCT form FROM (SELECT {q.inline(_FORM)} AS form FROM part)), k AS (SELECT DISTINCT {_KEY} AS key FROM forms)
SELECT array_to_string(b.key, ' ') AS small, array_to_string(a.key, ' ') AS large FROM k a JOIN k b ON len(a.key) = len(b.key) + 1 AND len(list_intersect(a.key, b.key)) = len(b.key)
WHERE len(b.key) > 0 AND len(list_filter(a.key, lambda w: NOT list_contains(b.key, w) AND length(w) > 2 AND NOT list_contains({_REFUSED}, w))) = 1""",
)
def absorption_edges(spark, sf):
    forms = R.surface_forms(phrases(spark, sf), "phrase", [], "ord")
    nodes = forms.groupBy("seed").agg(F.min_by(F.struct("key", "tokens"), "first").alias("k")).select(
        "seed", "k.key", "k.tokens"
    )
    spaced = lambda c: F.replace(F.col(c), F.lit(R.SEP), F.lit(" ")).alias(c)
    return R.absorption_edges(nodes, []).select(spaced("small"), spaced("large"))


@query("phrase_clusters", "H9 F11", _clusters(f"SELECT {q.inline(_FORM)} AS form FROM part") + " SELECT form, n, label FROM named")
def phrase_clusters(spark, sf):
    return R.cluster_phrases(phrases(spark, sf), "phrase", "ord").select("form", "n", "label")


def sites(spark, sf):
    """Findings as sites: the phrase of the part, filed under the order's region."""
    rows = roles.findings(spark, sf)
    papers = roles.order_papers(spark, sf).select("pmid", "domain", "year")
    named = F.concat(
        F.when(F.col("d") < 3, F.lit("")).otherwise(F.concat("operationalization", F.lit(" "))), "predictor"
    )
    return (
        rows.join(papers, "pmid")
        .withColumn("predictor", named)
        .withColumn("effect", effect_cell("effect", "effect_measure", "effect_raw"))
        .withColumn("file", F.concat("domain", F.lit("/"), "pmid", F.lit("_Customer.md")))
        .withColumn("ord", F.struct(F.col("pmid").cast("long").alias("p"), "row"))
        .withColumn("row_grade", F.lit("moderate"))
        .withColumn("row_score", F.lit(0.5))
        .select(
            "pmid", "domain", "file", "row", "predictor", "outcome", "operationalization", "direction", "effect", "row_grade",
            "row_score", "year", "ord",
        )
    )


_SITES = """
SELECT f.pmid, f.row, p.domain, p.year, CASE WHEN d < 3 THEN '' ELSE operationalization || ' ' END || predictor AS form, outcome, direction, effect_raw, effect,
  CASE WHEN d < 3 THEN '' ELSE operationalization || ' ' END || predictor AS predictor FROM findings f JOIN order_papers p USING (pmid)"""


def _recur(tail: str) -> str:
    return with_roles(_clusters(_SITES) + f""",
site AS (SELECT s.*, n.label FROM src s JOIN (SELECT DISTINCT form, label FROM named) n USING (form)),
groups AS (SELECT label, count(DISTINCT pmid) AS papers, count(*) AS rows FROM site GROUP BY label HAVING count(DISTINCT pmid) >= 2)
{tail}""", "findings", "order_papers")


def grouped(spark, sf, *columns):
    # The sites are both what is clustered and what is labelled; only columns that are read are cut (none named: all).
    found = sites(spark, sf)
    named, clusters = R.label_sites(cut(found.select("pmid", "domain", "predictor", "ord", *columns) if columns else found, "sites"))
    named = cut(named, "named")
    return named, clusters, R.predictor_groups(named, clusters)


@query(
    "predictor_groups",
    "F12 D9 H8",
    _recur(
        """, tp AS (SELECT label, string_agg(domain, ',' ORDER BY seen) AS topics FROM (SELECT label, domain, min(CAST(pmid AS BIGINT)) AS seen FROM site GROUP BY ALL) GROUP BY label),
fm AS (SELECT label, string_agg(form, '|' ORDER BY -n, length(form), form) AS forms FROM named GROUP BY label)
SELECT label AS predictor, papers, rows, topics, forms, row_number() OVER (ORDER BY papers DESC, rows DESC, label) AS place FROM groups JOIN tp USING (label) JOIN fm USING (label)"""
    ),
)
def predictor_groups(spark, sf):
    _, _, groups = grouped(spark, sf, "row")
    return numbered(groups, ["order"], "place").select(
        F.col("group").alias("predictor"), "papers", "rows", F.array_join("topics", ",").alias("topics"),
        F.array_join("surface_forms", "|").alias("forms"), (F.col("place") + 1).alias("place"),
    )


@query(
    "outcome_groups",
    "F12 H8",
    _recur(
        """SELECT label AS predictor, outcome, count(DISTINCT pmid) AS papers, count(*) AS rows, count(*) FILTER (direction = 'increases') AS increases,
  count(*) FILTER (direction = 'decreases') AS decreases, count(*) FILTER (direction = 'increases') > 0 AND count(*) FILTER (direction = 'decreases') > 0 AS contested
FROM site JOIN groups USING (label) GROUP BY label, outcome"""
    ),
)
def outcome_groups(spark, sf):
    named, _, groups = grouped(spark, sf, "outcome", "direction")
    outcomes, _ = R.outcome_groups(named, groups)
    return outcomes.select(
        F.col("group").alias("predictor"), F.col("outcome_label").alias("outcome"), "papers", "rows",
        F.col("n_increases").alias("increases"), F.col("n_decreases").alias("decreases"), "contested",
    )


@query(
    "recurrence_totals",
    "F13",
    _recur(
        """SELECT (SELECT count(*) FROM groups) AS groups, (SELECT count(DISTINCT label) FROM site) - (SELECT count(*) FROM groups) AS once,
  (SELECT count(*) FROM site) AS rows, (SELECT count(DISTINCT pmid) FROM site) AS papers"""
    ),
)
def recurrence_totals(spark, sf):
    named, _, groups = grouped(spark, sf, "row")
    return R.index_totals(named, groups).select("groups", "once", "rows", "papers")


@query(
    "predictor_index",
    "B9 U4",
    _recur(
        f""", og AS (SELECT label, outcome, count(DISTINCT pmid) AS papers, count(*) FILTER (direction = 'increases') AS n0, count(*) FILTER (direction = 'decreases') AS n1,
    count(*) FILTER (direction = 'none') AS n2, count(*) FILTER (direction = 'unclear') AS n3 FROM site JOIN groups USING (label) GROUP BY ALL),
dl AS (SELECT label, outcome, string_agg(d || ' (' || n || ')', ' · ' ORDER BY n DESC, i) AS line FROM (
    SELECT label, outcome, unnest(['increases','decreases','none','unclear']) AS d, unnest([n0,n1,n2,n3]) AS n, unnest([0,1,2,3]) AS i FROM og) WHERE n > 0 GROUP BY ALL),
tp AS (SELECT label, string_agg(domain, ', ' ORDER BY seen) AS topics, count(*) AS nt FROM (SELECT label, domain, min(CAST(pmid AS BIGINT)) AS seen FROM site GROUP BY ALL) GROUP BY label),
fm AS (SELECT label, string_agg('*' || form || '*', ' · ' ORDER BY -n, length(form), form) AS forms, count(*) AS nf FROM named GROUP BY label)
SELECT label AS predictor, '## ' || label AS line FROM groups
UNION ALL SELECT label, papers || ' paper(s) · ' || rows || ' row(s) · ' || nt || ' topic(s): ' || topics FROM groups JOIN tp USING (label)
UNION ALL SELECT label, 'Counted as one: ' || forms FROM groups JOIN fm USING (label) WHERE nf > 1
UNION ALL SELECT label, '### → ' || CASE WHEN outcome = '' THEN 'outcome not recorded' ELSE outcome END FROM og
UNION ALL SELECT label, papers || ' paper(s) — ' || line || CASE WHEN n0 > 0 AND n1 > 0 THEN '  ⚠ contested' ELSE '' END FROM og JOIN dl USING (label, outcome)
UNION ALL SELECT label, {q.row("'[' || pmid || '_Customer](' || domain || '/' || pmid || '_Customer.md)'", "CAST(row AS VARCHAR)", "domain", "s.predictor || ' — ' || f.operationalization", "s.direction", "CASE WHEN f.effect IS NULL THEN '—' ELSE f.effect_raw END", "'moderate 0.50'")}
  FROM site s JOIN groups USING (label) JOIN findings f USING (pmid, row)"""
    ),
)
def predictor_index(spark, sf):
    named, _, groups = grouped(spark, sf)
    outcomes, labelled = R.outcome_groups(named, groups)
    lines = reports.predictor_index(groups, outcomes, labelled)
    return lines.select(F.col("group").alias("predictor"), "line")
