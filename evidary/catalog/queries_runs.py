"""Runs, calls, files, streams, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidary import fixed
from evidary.catalog import roles, sql_text as q
from evidary.catalog.registry import query
from evidary.catalog.roles import table
from evidary.catalog.roles_sql import with_roles
from evidary.functions.labels import format_cost, strength_cell
from evidary.operators import quality, reports, retention, runlog
from evidary.session import scratch_path
from evidary.sinks import bundle
from evidary.sources.filesource import read_lines
from evidary.streaming import events as E
from evidary.streaming.running import BatchLog, KeyedTable, run_to_end

_DISPLAY = """CASE WHEN calls = 0 THEN '$0.00' WHEN unpriced_calls = 0 THEN format('${:,.4f}', usd) WHEN unpriced_calls = calls THEN 'cost unavailable'
  ELSE format('${:,.4f}', usd) || ' + ' || unpriced_calls || ' unpriced' END"""
_LEDGER = f"""
WITH r AS (SELECT run_id, role, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(coalesce(sum(usd), 0), 4) AS usd,
  count(*) FILTER (usd IS NULL) AS unpriced_calls FROM event_log GROUP BY run_id, role
  UNION ALL SELECT run_id, '(all)', count(*), CAST(sum(prompt_tokens) AS BIGINT), CAST(sum(completion_tokens) AS BIGINT), round(coalesce(sum(usd), 0), 4), count(*) FILTER (usd IS NULL) FROM event_log GROUP BY run_id)"""


@query(
    "cost_ledger",
    "F14 C41",
    with_roles(f"{_LEDGER} SELECT run_id, role, calls, prompt_tokens, completion_tokens, usd, unpriced_calls, {_DISPLAY} AS display FROM r", "event_log"),
)
def cost_ledger(spark, sf):
    ledger = runlog.cost_ledger(roles.event_log(spark, sf), "run_id").withColumn("usd", F.round("usd", 4))
    return ledger.withColumn("display", format_cost("usd", "calls", "unpriced_calls"))


@query(
    "cost_displays",
    "Q10",
    with_roles(
        f"{_LEDGER}, s AS (SELECT run_id || '/' || role AS path, calls, unpriced_calls, format('${{:,.4f}}', usd) AS display FROM r) SELECT 'error' AS severity, path, 'cost display' AS rule, display AS message FROM s WHERE unpriced_calls > 0",
        "event_log",
    ),
)
def cost_displays(spark, sf):
    ledger = runlog.cost_ledger(roles.event_log(spark, sf), "run_id")
    shown = F.concat(F.lit("$"), F.format_number(F.round("usd", 4), 4))
    return quality.check_cost_display(
        ledger.select(F.concat_ws("/", "run_id", "role").alias("run_id"), "calls", "unpriced_calls", shown.alias("display"))
    )


@query(
    "running_totals",
    "G12",
    with_roles(
        """SELECT run_id, call_id, CAST(sum(prompt_tokens) OVER w AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) OVER w AS BIGINT) AS total_completion_tokens,
  round(sum(coalesce(usd, 0)) OVER w, 4) AS total_usd, count(*) OVER w AS total_calls, count(*) FILTER (usd IS NULL) OVER w AS unpriced_calls
FROM event_log WINDOW w AS (PARTITION BY run_id ORDER BY "at", call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "event_log",
    ),
)
def running_totals(spark, sf):
    df = runlog.call_totals(roles.event_log(spark, sf))
    return df.select(
        "run_id", "call_id", "total_prompt_tokens", "total_completion_tokens", F.round("total_usd", 4).alias("total_usd"), "total_calls",
        "unpriced_calls",
    )


def stage_events(spark, sf):
    """Clicks start a stage, purchases finish it; views report progress."""
    kinds = {"click": "NodeStarted", "purchase": "NodeFinished", "view": "Progress", "signup": "WarningEvent", "error": "ErrorEvent"}
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        roles.pick(kinds, "event_type").alias("kind"),
        F.col("user_id").cast("string").alias("run_id"),
        F.get(F.array(*[F.lit(m) for m in fixed.MILESTONES]), (k % 9).cast("int")).alias("node"),
        (k * 1).alias("current"),
        F.when(k % 2 == 0, F.lit(100).cast("long")).alias("total"),
        F.col("ts").alias("at"),
    )


_STAGES = f"""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS t, {q.words(fixed.MILESTONES)}[CAST(json_extract_string(props, '$.k') AS BIGINT) % 9 + 1] AS node,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events)"""


@query(
    "stage_durations",
    "G13",
    f"""{_STAGES}, s AS (SELECT run_id, node, min(us) FILTER (t = 'click') AS a, max(us) FILTER (t = 'purchase') AS b FROM e GROUP BY ALL)
SELECT run_id, node, CASE WHEN b - a >= 0 THEN (b - a) / 1e6 ELSE -1.0 END AS seconds FROM s""",
)
def stage_durations(spark, sf):
    df = runlog.stage_durations(stage_events(spark, sf))
    return df.select("run_id", "node", F.coalesce("seconds", F.lit(-1.0)).alias("seconds"))


@query(
    "furthest_stages",
    "G14",
    f"""{_STAGES} SELECT run_id, arg_max(node, list_position({q.words(fixed.MILESTONES)}, node)) AS reached FROM e WHERE t = 'purchase' GROUP BY run_id""",
)
def furthest_stages(spark, sf):
    return runlog.furthest_stage(stage_events(spark, sf).filter("kind = 'NodeFinished'"))


@query(
    "request_statistics",
    "F21",
    """SELECT count(*) FILTER (NOT hit) AS requests, count(*) FILTER (hit) AS cache_hits, CAST(sum(r) AS BIGINT) AS retries, CAST(sum(b) AS BIGINT) AS bytes_downloaded,
  round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM (SELECT url LIKE '%example.org%' AS hit, page_id % 3 AS r, length(html) AS b FROM pages)""",
)
def request_statistics(spark, sf):
    log = table(spark, sf, "pages").select(
        F.contains("url", F.lit("example.org")).alias("cache_hit"), (F.col("page_id") % 3).alias("retries"), F.length("html").alias("bytes")
    )
    return runlog.request_statistics(log).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "priced_calls",
    "E17",
    """WITH p(role, pin, pout) AS (VALUES ('user', 1.0, 5.0), ('assistant', 3.0, 15.0))
SELECT role, count(*) AS calls, round(coalesce(sum((floor(length(text) / 4.0) + 1) / 1e6 * pin + ceil(length(text) / 3.0) / 1e6 * pout), 0), 6) AS usd, count(*) FILTER (pin IS NULL) AS unpriced
FROM conversations LEFT JOIN p USING (role) GROUP BY role""",
)
def priced_calls(spark, sf):
    from evidary.functions.labels import chunk_tokens, prompt_tokens

    calls = table(spark, sf, "conversations").select(
        "role", prompt_tokens("text").alias("prompt_tokens"), chunk_tokens("text").alias("completion_tokens")
    )
    prices = spark.createDataFrame([("user", 1.0, 5.0), ("assistant", 3.0, 15.0)], "role string, price_in double, price_out double")
    return (
        runlog.price_calls(calls, prices)
        .groupBy("role")
        .agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("usd"), F.count_if(F.col("usd").isNull()).alias("unpriced"))
    )


# --- retention -------------------------------------------------------------------------


def _run_id():
    return F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit("-"), F.col("o_orderkey").cast("string"))


@query(
    "bytes_per_run",
    "F20",
    """SELECT run_id, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_quantity AS BIGINT) FROM lineitem) GROUP BY run_id""",
)
def bytes_per_run(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.floor("o_totalprice").alias("bytes"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.col("l_quantity").cast("long").alias("bytes"))
    return retention.bytes_per_run(a, b)


_KEEP, _CAP = 500, 50_000_000


@query(
    "runs_to_drop",
    "G10",
    f"""
WITH r AS (SELECT strftime(o_orderdate, '%Y%m%d-%H%M%S') || '-' || o_orderkey AS run_id, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderstatus FROM orders),
n AS (SELECT *, row_number() OVER w AS i, sum(bytes) OVER w AS held FROM r WINDOW w AS (ORDER BY run_id DESC ROWS UNBOUNDED PRECEDING))
SELECT run_id, CASE WHEN i > {_KEEP} THEN 'count' WHEN held > {_CAP} AND i > 1 THEN 'size' ELSE 'orphan' END AS reason FROM n
WHERE i > {_KEEP} OR (held > {_CAP} AND i > 1) OR o_orderstatus = 'F'""",
)
def runs_to_drop(spark, sf):
    runs = table(spark, sf, "orders").select(
        _run_id().alias("run_id"), F.floor("o_totalprice").alias("bytes"), (F.col("o_orderstatus") != "O").alias("finished"),
        (F.col("o_orderstatus") != "F").alias("output_exists"),
    )
    return retention.runs_to_drop(runs, _KEEP, _CAP)


@query(
    "files_to_trim",
    "G11",
    """
WITH f AS (SELECT 'f' || o_orderkey AS path, o_orderdate AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders),
s AS (SELECT *, sum(bytes) OVER (ORDER BY mtime, bytes, path ROWS UNBOUNDED PRECEDING) AS gone, sum(bytes) OVER () AS total FROM f)
SELECT path, bytes FROM s WHERE gone - bytes < total - 1000000000""",
)
def files_to_trim(spark, sf):
    files = table(spark, sf, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("mtime"), F.floor("o_totalprice").alias("bytes")
    )
    return retention.files_to_trim(files, 1_000_000_000).select("path", "bytes")


# --- streams ------------------------------------------------------------------------------


def _stream(spark, sf):
    """The events table as a stream of model calls."""
    raw = (
        spark.readStream.schema(table(spark, sf, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )
    k = F.get_json_object("props", "$.k").cast("long")
    return raw.select(
        F.lit("LLMCall").alias("kind"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("role"),
        k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"), F.when(F.col("event_type") != "error", F.col("value")).alias("usd"),
        F.col("event_type").alias("event_type"), F.col("ts").alias("at"),
    )


def _settled(spark, stream, keys, name):
    """What a stream of rows per key has come to when everything that landed is processed."""
    base = scratch_path(spark, name)
    table_ = KeyedTable(spark, f"{base}/table", keys)
    run_to_end(stream, table_.upsert, f"{base}/state")
    return table_.read()


@query(
    "live_meter",
    "S1 S2 B14",
    with_roles(
        f"{_LEDGER} SELECT run_id, role, calls, prompt_tokens, completion_tokens, usd, unpriced_calls FROM r WHERE role <> '(all)'", "event_log"
    ),
)
def live_meter(spark, sf):
    # The log as a run leaves it: lines of JSON in a folder that is followed as a stream.
    log = scratch_path(spark, "event-log")
    calls = roles.event_log(spark, sf).withColumn("kind", F.lit("LLMCall"))
    bundle.write_event_log(calls, log, "kind", ["run_id", "role", "prompt_tokens", "completion_tokens", "usd", "at"])
    meter = E.live_meter(E.read_events(spark, log))
    return _settled(spark, meter, ["run_id", "role"], "live-meter").withColumn("usd", F.round("usd", 4))


@query(
    "stage_status",
    "S3",
    f"""{_STAGES}, s AS (SELECT run_id, node, min(us) FILTER (t = 'click') AS a, max(us) FILTER (t = 'purchase') AS b,
  arg_max(k, (us, k)) FILTER (t = 'view' AND k % 2 = 0) AS c FROM e WHERE t IN ('click', 'purchase', 'view') GROUP BY ALL)
SELECT run_id, node, CASE WHEN b IS NULL THEN 'running' ELSE 'done' END AS status, coalesce((b - a) / 1e6, -1e9) AS seconds, coalesce(c, -1) AS current FROM s""",
)
def stage_status(spark, sf):
    raw = (
        spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    kinds = {"click": "NodeStarted", "purchase": "NodeFinished", "view": "Progress", "signup": "WarningEvent", "error": "ErrorEvent"}
    k = F.get_json_object("props", "$.k").cast("long")
    stream = raw.select(
        roles.pick(kinds, "event_type").alias("kind"), F.col("user_id").cast("string").alias("run_id"),
        F.get(F.array(*[F.lit(m) for m in fixed.MILESTONES]), (k % 9).cast("int")).alias("node"), k.alias("current"),
        F.when(k % 2 == 0, F.lit(100).cast("long")).alias("total"), F.col("ts").alias("at"),
    )
    return _settled(spark, E.tracked_stages(stream), ["run_id", "node"], "stage-status").select(
        "run_id", "node", "status", F.coalesce("seconds", F.lit(-1e9)).alias("seconds"), F.coalesce("current", F.lit(-1).cast("long")).alias("current")
    )


@query(
    "trouble_counters",
    "S4",
    "SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) FILTER (event_type = 'signup') AS warnings, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id",
)
def trouble_counters(spark, sf):
    kinds = {"signup": "WarningEvent", "error": "ErrorEvent"}
    stream = _stream(spark, sf).withColumn("kind", roles.pick(kinds, "event_type"))
    return _settled(spark, E.trouble_counters(stream), ["run_id"], "trouble")


@query(
    "budget_alerts",
    "S5",
    with_roles(
        """SELECT run_id, round(sum(coalesce(usd, 0)), 4) AS usd, format('soft budget reached: ${:,.4f} of $100.00', round(sum(coalesce(usd, 0)), 4)) AS message
FROM event_log GROUP BY run_id HAVING sum(coalesce(usd, 0)) >= 100""",
        "event_log",
    ),
)
def budget_alerts(spark, sf):
    base = scratch_path(spark, "alerts")
    alerts = BatchLog(spark, f"{base}/alerts")
    run_to_end(E.budget_alerts(_stream(spark, sf), 100.0), alerts.append, f"{base}/state", "append")
    return alerts.read()


# --- reports ----------------------------------------------------------------------------------


def graded(spark, sf):
    papers = roles.order_papers(spark, sf)
    share = F.when(F.col("design") == "unclear", F.lit("ungraded")).otherwise(F.lit("moderate"))
    return papers.withColumn("grade", share).withColumn("score", F.round(F.lit(0.5) + F.length("pmid") / 100.0, 2))


_GRADED = """(SELECT *, CASE WHEN design = 'unclear' THEN 'ungraded' ELSE 'moderate' END AS grade, round(0.5 + length(pmid) / 100.0, 2) AS score FROM order_papers)"""


@query(
    "topic_index",
    "B7 C28",
    with_roles(
        f"""
WITH p AS (SELECT pmid, count(*) AS n, string_agg(predictor, ', ' ORDER BY row) FILTER (row <= 3) AS names FROM findings GROUP BY pmid)
SELECT domain AS page, g.pmid AS order, {q.row("g.pmid", "'[' || title || '](./' || filename || ')'", "study_design", f"CASE WHEN g.n IS NULL THEN '—' ELSE {q.thousands('g.n')} END", "CASE WHEN grade = 'ungraded' THEN '—' ELSE grade || ' ' || printf('%.2f', score) END", "CASE WHEN p.n IS NULL THEN '—' WHEN p.n > 3 THEN names || ', +' || (p.n - 3) || ' more' ELSE names END")} AS line
FROM {_GRADED} g LEFT JOIN p USING (pmid)""".replace("AS order,", 'AS "order",'),
        "order_papers",
        "findings",
    ),
)
def topic_index(spark, sf):
    return reports.topic_index(graded(spark, sf), roles.findings(spark, sf))


@query(
    "topic_summary",
    "F6",
    with_roles(
        """SELECT slug, topics.title, count(pmid) AS papers, count(pmid) FILTER (basis = 'full_text') AS full_text, count(pmid) FILTER (basis <> 'full_text') AS abstract_only
FROM (SELECT slug, title FROM topics UNION ALL SELECT 'nowhere', 'NOWHERE') topics LEFT JOIN order_papers ON domain = slug GROUP BY slug, topics.title""",
        "topics",
        "order_papers",
    ),
)
def topic_summary(spark, sf):
    topics = roles.topics(spark, sf)
    # One more topic, which no paper has.
    empty = topics.limit(1).withColumns({"ord": F.lit(99).cast(topics.schema["ord"].dataType), "slug": F.lit("nowhere"), "title": F.lit("NOWHERE")})
    df = reports.topic_summary(roles.order_papers(spark, sf), topics.unionByName(empty))
    return df.select("slug", "title", "papers", "full_text", "abstract_only")


def _funnel(spark, sf):
    hits = roles.hits(spark, sf).groupBy("term").agg(F.count("*").alias("retrieved"))
    v = roles.verdicts(spark, sf)
    papers = roles.order_papers(spark, sf)
    return reports.funnel(hits, roles.part_records(spark, sf), v, v.filter("relevance = 3"), papers, roles.findings(spark, sf), papers)


_FUNNEL = """fn AS (SELECT 0 AS ord, 'found' AS stage, (SELECT count(*) FROM lineitem) AS papers UNION ALL SELECT 1, 'unique', (SELECT count(*) FROM part)
  UNION ALL SELECT 2, 'screened', (SELECT count(*) FROM verdicts) UNION ALL SELECT 3, 'included', (SELECT count(*) FROM verdicts WHERE include)
  UNION ALL SELECT 4, 'curated', (SELECT count(*) FROM verdicts WHERE relevance = 3) UNION ALL SELECT 5, 'full text fetched', (SELECT count(*) FROM order_papers WHERE basis = 'full_text')
  UNION ALL SELECT 6, 'extracted', (SELECT count(*) FROM findings) UNION ALL SELECT 7, 'emitted', (SELECT count(*) FROM order_papers))"""


@query("funnel_counts", "F5", with_roles(f"WITH {_FUNNEL} SELECT * FROM fn", "verdicts", "order_papers", "findings"))
def funnel_counts(spark, sf):
    return _funnel(spark, sf)


_TOTAL = f"""tt AS (SELECT count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS pt, CAST(sum(completion_tokens) AS BIGINT) AS ct, round(sum(coalesce(usd, 0)), 4) AS usd, count(*) FILTER (usd IS NULL) AS unpriced_calls FROM event_log),
cl AS (SELECT '- **Model calls** — ' || {q.thousands("calls")} AS line FROM tt
  UNION ALL SELECT '- **Tokens** — ' || {q.thousands("pt + ct")} || ' (' || {q.thousands("pt")} || ' in / ' || {q.thousands("ct")} || ' out)' FROM tt
  UNION ALL SELECT '- **Spend** — ' || {_DISPLAY} FROM tt)"""


def _ledger_total(spark, sf):
    return runlog.cost_ledger(roles.event_log(spark, sf)).filter("role = '(all)'").withColumn("usd", F.round("usd", 4))


def _warnings(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), F.col("text").alias("message"))


@query(
    "root_index",
    "B8",
    with_roles(
        f"""WITH {_FUNNEL}, {_TOTAL}, ts AS (SELECT slug, topics.title, scope, count(pmid) AS papers, count(pmid) FILTER (basis = 'full_text') AS f FROM topics LEFT JOIN order_papers ON domain = slug GROUP BY ALL)
SELECT 1 AS part, {q.row("'[' || slug || '](' || slug || '/index.md)'", "title", "CAST(papers AS VARCHAR)", "CAST(f AS VARCHAR)", "CAST(papers - f AS VARCHAR)", "scope")} AS line FROM ts
UNION ALL SELECT 2, {q.row("stage", q.thousands("papers"))} FROM fn UNION ALL SELECT 3, line FROM cl UNION ALL SELECT 4, '- ' || {q.inline("text")} FROM benchmark""",
        "topics",
        "order_papers",
        "verdicts",
        "findings",
        "event_log",
    ),
)
def root_index(spark, sf):
    summary = reports.topic_summary(roles.order_papers(spark, sf), roles.topics(spark, sf))
    lines = reports.root_index(summary, _funnel(spark, sf), _ledger_total(spark, sf), _warnings(spark, sf))
    return lines.select("part", "line")


@query(
    "root_index_page",
    "B8",
    with_roles(
        f"""WITH {_FUNNEL}, {_TOTAL}, ts AS (SELECT slug, topics.title, scope, count(pmid) AS papers, count(pmid) FILTER (basis = 'full_text') AS f FROM topics LEFT JOIN order_papers ON domain = slug GROUP BY ALL),
page AS (SELECT {q.row("'[' || slug || '](' || slug || '/index.md)'", "title", "CAST(papers AS VARCHAR)", "CAST(f AS VARCHAR)", "CAST(papers - f AS VARCHAR)", "scope")} AS line FROM ts
UNION ALL SELECT {q.row("stage", q.thousands("papers"))} FROM fn UNION ALL SELECT line FROM cl UNION ALL SELECT '- ' || {q.inline("text")} FROM benchmark)
SELECT line, count(*) AS copies FROM page GROUP BY line""",
        "topics",
        "order_papers",
        "verdicts",
        "findings",
        "event_log",
    ),
)
def root_index_page(spark, sf):
    """The root index written as a page and read back as lines."""
    folder = scratch_path(spark, "root-index")
    summary = reports.topic_summary(roles.order_papers(spark, sf), roles.topics(spark, sf))
    lines = reports.root_index(summary, _funnel(spark, sf), _ledger_total(spark, sf), _warnings(spark, sf))
    bundle.write_page(lines, folder, [c for c in lines.columns if c != "line"])
    return read_lines(spark, folder).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("copies"))


def _searches(spark, sf):
    """Part names as executed searches: how many parts carry a name, how many were taken."""
    named = table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("count"), F.min("p_partkey").alias("ord"), F.max("p_size").alias("top"))
    tagged = F.concat(F.lit('"'), "p_name", F.lit('"[tiab]'))
    return named.select(
        "ord", tagged.alias("term"),
        F.when(F.col("ord") % 2 == 0, F.replace(tagged, F.lit("tiab"), F.lit("Title/Abstract"))).otherwise(F.concat(tagged, F.lit(" OR x[MeSH Terms]"))).alias("translation"),
        "count", F.least("count", F.lit(25).cast("long")).alias("retrieved"), (F.col("ord") % 3 == 0).alias("suspect"),
        F.when(F.col("ord") % 3 == 0, F.lit("tag | rewritten")).otherwise("").alias("note"),
    )


_SEARCHES = """s AS (SELECT min(p_partkey) AS ord, '"' || p_name || '"[tiab]' AS term, count(*) AS n, least(count(*), 25) AS retrieved, min(p_partkey) % 3 = 0 AS suspect, min(p_partkey) % 2 = 0 AS even FROM part GROUP BY p_name)"""


@query(
    "search_report",
    "B10",
    f"""WITH {_SEARCHES} SELECT ord, term, CASE WHEN retrieved >= n THEN {q.thousands("n")} || ' papers matched, and all ' || {q.thousands("retrieved")} || ' were retrieved.'
  ELSE {q.thousands("n")} || ' papers matched. The first ' || {q.thousands("retrieved")} || ' were retrieved (the cap is 25); the other ' || {q.thousands("n - retrieved")} || ' were never seen by this run.' END AS result,
  NOT suspect AND even AS mechanical, n > 25 AS capped FROM s""",
)
def search_report(spark, sf):
    return reports.search_report(_searches(spark, sf), 25).select("ord", "term", "result", "mechanical", "capped")


@query(
    "search_totals",
    "B10",
    f"""WITH {_SEARCHES} SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS matched, CAST(sum(retrieved) AS BIGINT) AS retrieved, count(*) FILTER (n > 25) AS capped, count(*) FILTER (n <= 25) AS exact,
  count(*) FILTER (suspect) AS suspect, 0 AS empty FROM s""",
)
def search_totals(spark, sf):
    return reports.search_totals(reports.search_report(_searches(spark, sf), 25))


@query(
    "build_log",
    "B11",
    with_roles(
        f"""WITH {_FUNNEL}, {_TOTAL}, {_SEARCHES}
SELECT 1 AS part, {q.row("CAST(ord + 1 AS VARCHAR)", "term", q.thousands("n"), "CAST(retrieved AS VARCHAR)", "CASE WHEN suspect THEN 'suspect — tag | rewritten' ELSE '' END")} AS line FROM s
UNION ALL SELECT 2, {q.row("stage", q.thousands("papers"))} FROM fn UNION ALL SELECT 3, line FROM cl UNION ALL SELECT 4, '- ' || {q.inline("text")} FROM benchmark""",
        "order_papers",
        "verdicts",
        "findings",
        "event_log",
    ),
)
def build_log(spark, sf):
    lines = reports.build_log(_searches(spark, sf), _funnel(spark, sf), _ledger_total(spark, sf), _warnings(spark, sf))
    return lines.select("part", "line")


@query(
    "corpus_statistics",
    "F22 D6",
    with_roles(
        """SELECT (SELECT count(*) FROM order_papers) AS documents, (SELECT count(*) FROM order_papers WHERE basis = 'full_text') AS full_text,
  (SELECT count(*) FROM order_papers WHERE license = 'CC BY') AS permissive, (SELECT count(*) FROM findings) AS rows,
  (SELECT count(DISTINCT pmid) FROM null_findings WHERE predictor <> 'None reported ') AS with_nulls""",
        "order_papers",
        "findings",
        "null_findings",
    ),
)
def corpus_statistics(spark, sf):
    rows = roles.findings(spark, sf)
    return reports.corpus_statistics(roles.order_papers(spark, sf), rows, roles.null_findings(rows))


@query(
    "event_log_lines",
    "B14",
    with_roles(
        """SELECT '{"kind":"' || role || '","run_id":"' || run_id || '","prompt_tokens":' || prompt_tokens || ',"seen":' || CASE WHEN usd IS NULL THEN 'null' ELSE 'true' END || '}' AS value FROM event_log""",
        "event_log",
    ),
)
def event_log_lines(spark, sf):
    df = roles.event_log(spark, sf).withColumn("seen", F.when(F.col("usd").isNotNull(), F.lit(True)))
    return bundle.event_lines(df, "role", ["run_id", "prompt_tokens", "seen"])


__all__ = ["graded", "strength_cell"]
