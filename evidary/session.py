"""Session helpers: a test session, and durable cuts in long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "evidary", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a missing
    setting is an error, because a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    fallback = os.path.join(tempfile.gettempdir(), f"spark-evidary-{os.getpid()}")
    os.makedirs(fallback, exist_ok=True)
    return fallback


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so lost executors cost no recompute chain."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Shuffle files go when the query that made them has ended.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back; ``options`` are the writer's.

    What is computed once stays computed when executors are lost; the folder
    (``spark.checkpoint.dir``) belongs to the job, which clears it at its end.
    Columns are compressed and read one by one, so wide rows are cut this way; ``durable`` keeps rows as they lie
    in memory, uncompressed, but also their partitions and order.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def as_laid(spark: SparkSession):
    """Inside it, the shuffles of a query leave the disks as it ends, and tables that ``cut`` laid in buckets are joined as they lie.

    Rows of buckets stand in their order already, so groups are taken as they come, and joins on the buckets' keys and further
    columns move no rows either.
    """
    return _set(
        spark,
        {
            _CLEANED: "true",
            "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
            "spark.sql.requireAllClusterKeysForCoPartition": "false",
            "spark.sql.execution.replaceHashWithSortAgg": "true",
        },
    )


def cut(df: DataFrame, name: str, by: str = "", order: Sequence[str] = ()) -> DataFrame:
    """``stored`` for wide intermediate tables: tighter, and the shuffles that made the table leave the disks with its writing.

    With ``by`` the table is laid in buckets of that column, sorted by it and by ``order``: joins, groups and windows
    by the column then shuffle nothing.  A key of few rows, such as a paper, is meant.
    """
    spark = df.sparkSession
    if by:
        with as_laid(spark):
            count = int(spark.conf.get("spark.sql.shuffle.partitions"))
            path = scratch_path(spark, name)
            table = os.path.basename(path).replace("-", "_")
            laid = df.repartition(count, by).write.bucketBy(count, by).sortBy(by, *order).option("compression", "zstd").option("path", path)
            laid.saveAsTable(table)
            return spark.table(table)
    with _set(spark, {_CLEANED: "true"}):
        return stored(df, name, compression="zstd")
