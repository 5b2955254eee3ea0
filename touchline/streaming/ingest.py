"""Continuous ingest of match updates into a table of key buckets.

The table is plain Parquet, partitioned by the bucket of its key. A micro-batch reads the partitions of its keys, merges
its updates and replaces just these partitions by dynamic partition overwrite. The merged rows are written first, below
the batch's number; a batch that is replayed after a lost driver finishes from them, so it neither merges twice nor
counts an insert as an update.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from touchline.operators import upsert as U
from touchline.session import STATE_STORE

LOOK_BACK = "6 hours"
BUCKET, BATCH = "_bucket", "batch_id"


@contextmanager
def state_settings(spark: SparkSession, n: int | None = None) -> Iterator[None]:
    """Settings for stateful streams started inside: RocksDB state, and one state partition per core unless given.

    A stateful stream keeps the number it first started with, and adaptive execution does not merge
    its partitions, so the batch default is rarely right for it.
    """
    wanted = {"spark.sql.shuffle.partitions": str(n or spark.sparkContext.defaultParallelism), STATE_STORE[0]: STATE_STORE[1]}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class BucketedTable:
    """A Parquet table partitioned by the hash bucket of ``key``; every row carries the batch that last changed it."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, buckets: int = 32):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.columns = [f.name for f in schema.fields]
        kept = StructType([*schema.fields]).add(BATCH, "long")
        self.schema, self.stored = schema, StructType([*kept.fields]).add(BUCKET, "integer")
        self.staged = StructType([*kept.fields, StructField("_outcome", StringType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def create(self, first: DataFrame) -> None:
        rows = first.select(*self.columns, F.lit(None).cast("long").alias(BATCH), self.bucket().alias(BUCKET))
        rows.write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{self.root}/rows")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets; other partitions are not opened."""
        rows = self.spark.read.schema(self.stored).parquet(f"{self.root}/rows")
        return (rows if only is None else rows.where(F.col(BUCKET).isin(only))).drop(BUCKET)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows, at most as many as the table has."""
        return sorted(r[0] for r in rows.select(self.bucket().alias(BUCKET)).distinct().collect())

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _drop(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def merge(self, batch: DataFrame, batch_id: int, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """Bring a batch into the table; returns the merged rows of its buckets with their ``_outcome``."""
        staged = f"{self.root}/staged/{batch_id}"
        if not self._exists(staged):
            only = self.touched(batch)
            merged = apply(self.read(only), batch)
            mine = F.when(F.col("_outcome") == "untouched", F.col(BATCH)).otherwise(F.lit(batch_id).cast("long"))
            merged.select(*self.columns, mine.alias(BATCH), "_outcome").write.mode("overwrite").parquet(staged)
        merged = self.spark.read.schema(self.staged).parquet(staged)
        whole = merged.select(*self.columns, BATCH, self.bucket().alias(BUCKET)).repartition(BUCKET)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.root}/rows")
        self._drop(f"{self.root}/staged/{batch_id - 1}")
        return merged


def landed(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 4) -> DataFrame:
    """Stream over a folder of landed Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def before_cutoff(stream: DataFrame, cutoff: str, column: str = "kickoff_time") -> DataFrame:
    """Hard cutoff: nothing at or after it enters."""
    return stream.where(F.col(column) < F.lit(cutoff).cast("timestamp"))


def settle_late(stream: DataFrame, column: str = "kickoff_time", delay: str = LOOK_BACK) -> DataFrame:
    """Drop repeats of the same (match, status) inside the look-back; late status changes still pass."""
    return stream.withWatermark(column, delay).dropDuplicatesWithinWatermark(["external_id", "status"])


def upsert_stream(
    stream: DataFrame,
    table: BucketedTable,
    counters: str | None,
    checkpoint: str,
    apply: Callable[[DataFrame, DataFrame], DataFrame],
) -> StreamingQuery:
    """Apply every micro-batch to the buckets that its keys fall into; ``counters`` is a folder for its outcomes, by batch."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        merged = table.merge(batch, batch_id, apply)
        if counters is None:
            return
        o = F.col("_outcome")
        counts = merged.agg(F.count_if(o == "inserted").alias("inserted"), F.count_if(o == "updated").alias("updated")).withColumn(BATCH, F.lit(batch_id).cast("long"))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(counters)

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_matches(now: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda target, batch: U.upsert_matches(target, batch, now)


def tumbling_counts(stream: DataFrame, column: str, size: str, by: str, delay: str = LOOK_BACK) -> DataFrame:
    """Rows per job and event-time window."""
    return (
        stream.withWatermark(column, delay)
        .groupBy(F.window(column, size), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), by, "n")
    )
