"""Versioned datasets: 77 columns in fixed order plus a one-row manifest with a content digest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions import names as N
from touchline.session import co_partitioned

DATASET_SCHEMA = T.StructType(
    [T.StructField(c, T.TimestampType() if c == "kickoff" else T.LongType()) for c in N.IDENTITY]
    + [T.StructField(c, T.DoubleType() if c in N.DOUBLE_FEATURES else T.LongType()) for c in N.FEATURES]
    + [T.StructField(c, T.IntegerType()) for c in N.TARGETS]
)


class DatasetError(ValueError):
    """A stored dataset does not match its manifest or its schema."""


def content_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of all rows: count, xor and sum of row hashes, in one aggregate."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("hash_xor"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
    )


def digest_text(df: DataFrame) -> str:
    r = content_digest(df).first()
    return f"{r['row_count']}:{r['hash_xor'] & 0xFFFFFFFFFFFFFFFF:016x}:{int(r['hash_sum'])}"


def manifest(df: DataFrame, version: str, cutoff: str, digest: str, now: str) -> DataFrame:
    """One row that describes the dataset; an empty dataset starts now and ends at the epoch."""
    stats = df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.min("kickoff"), F.lit(now).cast("timestamp")).alias("start_date"),
        F.coalesce(F.max("kickoff"), F.timestamp_seconds(F.lit(0))).alias("end_date"),
        F.sort_array(F.collect_set("competition_id")).alias("competitions"),
        F.sort_array(F.collect_set("season_id")).alias("seasons"),
    )
    return stats.select(
        F.lit(version).alias("dataset_version"),
        F.lit(now).cast("timestamp").alias("generated_at"),
        F.lit(N.FEATURE_VERSION).alias("feature_definition_version"),
        F.lit(cutoff).cast("timestamp").alias("data_cutoff"),
        F.lit(N.SCHEMA_VERSION).alias("source_schema_version"),
        "row_count",
        F.array(*[F.lit(c) for c in N.FEATURES]).alias("feature_names"),
        F.array(*[F.lit(c) for c in N.TARGETS]).alias("target_names"),
        "start_date",
        "end_date",
        "competitions",
        "seasons",
        F.lit(digest).alias("content_digest"),
        F.create_map().cast("map<string,string>").alias("extras"),
    )


def write_dataset(df: DataFrame, path: str, version: str, cutoff: str, now: str, clustered: bool = False) -> DataFrame:
    """Write rows partitioned by league season, then the manifest over what was written.

    ``clustered`` rows already lie together by league season and time, as ``build_examples`` leaves them: they are written
    where they are, so the 77 columns are neither joined twice (for the bounds of ranges) nor shuffled.
    """
    spark = df.sparkSession
    order = ["competition_id", "season_id", "kickoff", "fixture_id"]
    rows = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in DATASET_SCHEMA.fields])
    with co_partitioned(spark):
        dealt = rows if clustered else rows.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.partitionBy("competition_id", "season_id").parquet(f"{path}/rows")
    stored = _rows(spark, path)
    m = manifest(stored, version, cutoff, digest_text(stored), now)
    m.coalesce(1).write.json(f"{path}/manifest", ignoreNullFields=False)
    return read_manifest(spark, path)


def export_csv(df: DataFrame, path: str) -> None:
    """Totally ordered CSV with header; a missing value is an empty cell."""
    df.select(*N.DATASET_COLUMNS).orderBy("kickoff", "fixture_id").write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).csv(path)


_MANIFEST_SCHEMA = """dataset_version string, generated_at timestamp, feature_definition_version string,
data_cutoff timestamp, source_schema_version string, row_count long, feature_names array<string>,
target_names array<string>, start_date timestamp, end_date timestamp, competitions array<long>,
seasons array<long>, content_digest string, extras map<string, string>"""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST_SCHEMA).option("mode", "FAILFAST").json(f"{path}/manifest")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET_SCHEMA).parquet(f"{path}/rows").select(*N.DATASET_COLUMNS)


def read_dataset(
    spark: SparkSession, path: str, expected_version: str | None = None, verify: bool = True
) -> DataFrame:
    """Rows of a stored dataset after checking version, names, row count and digest."""
    m = read_manifest(spark, path).first()
    if expected_version is not None and m["dataset_version"] != expected_version:
        raise DatasetError(f"dataset has version {m['dataset_version']}, expected {expected_version}")
    if list(m["feature_names"]) != N.FEATURES or list(m["target_names"]) != N.TARGETS:
        raise DatasetError("dataset columns differ from this feature definition")
    df = _rows(spark, path)
    if verify and digest_text(df) != m["content_digest"]:
        raise DatasetError("row count or digest differs from the manifest")
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Strictly typed CSV: a malformed cell or a wrong header fails the read."""
    return (
        spark.read.schema(DATASET_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")
        .csv(path)
    )


def manifest_json(df: DataFrame) -> str:
    return json.dumps(df.first().asDict(recursive=True), default=str, indent=2)
