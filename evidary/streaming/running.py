"""Running streams to their end, and the tables they end in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, GroupedData, SparkSession, functions as F

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def by_keys(stream: DataFrame, *keys: str) -> GroupedData:
    """``stream`` grouped for a stateful processor."""
    return stream.groupBy(*keys)


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Process everything that has landed, batch by batch, and stop; the state lies in ``checkpoint``.

    Stateful processors need the RocksDB state store, which is set for this query only.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


class KeyedTable:
    """A Parquet table with a row per key, of which a batch rewrites only the hash partitions that its keys lie in.

    The partitions as they will be are written beside the table first, under the batch's id, and then put in place with dynamic
    partition overwrite.  A batch that comes again, after a failure at any point, finds what was written and puts it in place
    once more, so it changes nothing twice.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.data, self.staged = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/staged"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _has(self, path: str) -> bool:
        there = self._path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there)

    def _partitioned(self) -> DataFrame | None:
        return self.spark.read.parquet(self.data) if self._has(self.data) else None

    def read(self) -> DataFrame | None:
        """The table, or None before the first batch."""
        found = self._partitioned()
        return None if found is None else found.drop("bucket")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Put the rows of ``batch``, whose keys are distinct, in place of those with the same keys."""
        written = f"{self.staged}/{batch_id}"
        if not self._has(f"{written}/_SUCCESS"):
            batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
            # At most ``buckets`` numbers.
            touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
            now = self._partitioned()
            if now is not None:
                kept = now.where(F.col("bucket").isin(touched))
                ids = batch.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
                same = None
                for k in self.keys:
                    equal = kept[k].eqNullSafe(ids[f"_{k}"])
                    same = equal if same is None else same & equal
                batch_rows = kept.join(ids, same, "left_anti").unionByName(batch)
            else:
                batch_rows = batch
            batch_rows.write.mode("overwrite").parquet(written)
            batch.unpersist()
        staged = self.spark.read.parquet(written)
        if not staged.isEmpty():
            put = staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            put.partitionBy("bucket").parquet(self.data)
        old = self._path(f"{self.staged}/{batch_id - 2}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)


class BatchLog:
    """A Parquet table that batches append to: a partition for each, written again if the batch comes again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")
