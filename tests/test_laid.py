"""Tables laid in buckets by paper: checks, joins and windows over them move no rows."""

from pyspark.sql import Window, functions as F

from evidary import session
from evidary.catalog import roles
from evidary.operators import verification as V

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cut_by_a_key_keeps_rows_and_settings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    rows = spark.range(1000).selectExpr("if(id % 9 = 0, null, cast(id % 100 as string)) AS pmid", "cast(id as int) AS row", "array(id) AS more")
    laid = session.cut(rows, "laid", by="pmid", order=["row"])
    assert laid.dtypes == rows.dtypes and laid.exceptAll(rows).isEmpty() and laid.count() == 1000
    assert spark.conf.get(key) == before
    assert "Exchange" not in _plan(laid.groupBy("pmid").agg(F.collect_list("row")))
    assert "Exchange" not in _plan(laid.withColumn("n", F.row_number().over(Window.partitionBy("pmid").orderBy("row"))))
    with session.as_laid(spark):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            both = _plan(laid.join(laid.select("pmid", "row", F.lit(1).alias("x")), ["pmid", "row"]))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in both and "Sort " not in both


def test_checks_of_laid_findings_shuffle_nothing(spark):
    rows = session.cut(roles.findings(spark, SF), "findings", by="pmid", order=["row"])
    features = session.cut(V.source_features(roles.source_texts(rows)), "features", by="pmid")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [_plan(V.check_rows(rows, features)), _plan(V.check_interactions(roles.interactions(rows, "predictor"), features)), _plan(V.check_codes(roles.codes(rows), features))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not any("Exchange" in plan for plan in plans)


def test_rendering_moves_papers_alone(spark):
    from evidary.catalog import queries_docs as Q
    from evidary.operators import interactions as I, rendering as B

    rows = session.cut(roles.findings(spark, SF), "findings", by="pmid", order=["row"])
    papers = roles.order_papers(spark, SF).select("*", F.lit("moderate").alias("grade"), F.lit(0.5).alias("score"), F.array(F.lit("size")).alias("unmeasured"))
    papers = session.cut(papers, "papers", by="pmid")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with session.as_laid(spark):
            both = I.mirror_interactions(rows, roles.interactions(rows))
            assert "Exchange" not in _plan(both)
            links = session.cut(both, "links", by="pmid", order=["row"])
            made = B.render_documents(papers, Q._marked(rows), roles.null_findings(rows), Q.hints(rows), links)
            plan = _plan(made)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "ObjectHashAggregate" not in plan
