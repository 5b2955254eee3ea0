"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
UTC_NAMES = ("UTC", "Etc/UTC", "Z", "GMT", "+00:00")


def build_session(app: str = "touchline", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        STATE_STORE[0]: STATE_STORE[1],
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder that every executor can reach; local sessions may fall back to a new temp folder."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="touchline-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_scope: ContextVar[str | None] = ContextVar("touchline_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Everything written to the scratch folder inside goes below one new folder, removed at the end.

    Results that read those tables must be stored elsewhere before the scope ends.
    """
    root = f"{scratch_root(spark)}/scope-{uuid.uuid4().hex}"
    token = _scope.set(root)
    try:
        yield root
    finally:
        _scope.reset(token)
        remove(spark, root)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the scratch folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def require_checkpoints(spark: SparkSession) -> None:
    """Checkpoints of RDDs go to the scratch folder, unless the context has a folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the scratch folder, or below the scope's folder inside a scope."""
    return f"{_scope.get() or scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def require_utc(spark: SparkSession) -> None:
    """Dates become instants in the session's zone; in any other zone snapshots would show hours early or late."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise RuntimeError(f"the session's time zone is {zone}; set spark.sql.session.timeZone to UTC")


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside keep rows where they are if both sides lie by the same part of the join's keys."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which also cuts its lineage.

    ``by`` partitions the files, so that a filter on those columns reads only its own part.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
