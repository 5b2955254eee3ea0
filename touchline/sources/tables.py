"""The given tables and the match tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """One match per order: five competitions of twenty teams, a season per calendar year."""
    o = table(spark, folder, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    slot = F.floor(cust / 5.0).cast("long")
    price = F.floor("o_totalprice").cast("long")
    unplayed = F.col("o_orderstatus") == "P"
    return o.select(
        key.alias("fixture_id"),
        (cust % 5).alias("competition_id"),
        F.year("o_orderdate").cast("long").alias("season_id"),
        ((cust % 5) * 100 + slot % 20).alias("home_team_id"),
        ((cust % 5) * 100 + (slot + 1 + key % 19) % 20).alias("away_team_id"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(key % 10 + 12).cast("int"))).alias("kickoff"),
        F.when(unplayed, "scheduled").otherwise("finished").alias("status"),
        F.when(~unplayed, price % 5).alias("home_goals"),
        F.when(~unplayed, (price + key) % 4).alias("away_goals"),
    )


def team_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots per (team, league season, day); about a third without xg."""
    li = table(spark, folder, "lineitem")
    m = matches(spark, folder).select("fixture_id", "home_team_id", "competition_id", "season_id")
    return (
        li.join(m, li.l_orderkey == m.fixture_id)
        .groupBy(
            F.col("home_team_id").alias("team_id"),
            "competition_id",
            "season_id",
            F.col("l_shipdate").cast("date").alias("as_of_date"),
        )
        .agg(
            F.max(F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 10)).alias("xg"),
            F.max(F.col("l_discount") * 20).alias("xga"),
        )
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Three model versions per match with small whole weights."""
    m = matches(spark, folder)
    v = F.col("model_version_id")
    f = F.col("fixture_id")
    rows = m.select(
        "fixture_id", "kickoff", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("model_version_id")
    ).select(
        "*",
        (F.lit(1) + (f + v * 3) % 7).cast("double").alias("w_h"),
        (F.lit(1) + (F.floor(f / 7.0).cast("long") + v) % 5).cast("double").alias("w_d"),
        (F.lit(1) + (F.floor(f / 35.0).cast("long") + v * 2) % 6).cast("double").alias("w_a"),
    )
    total = F.col("w_h") + F.col("w_d") + F.col("w_a")
    return rows.withColumns(
        {
            "p_home_win": F.col("w_h") / total,
            "p_draw": F.col("w_d") / total,
            "p_away_win": F.col("w_a") / total,
        }
    )
