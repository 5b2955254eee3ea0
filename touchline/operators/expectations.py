"""Table expectations: value rules, unique keys and references, each counted in Spark."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rules(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """(table, rule, violations) for row rules; all rules share one scan. NULL passes, as in SQL CHECK."""
    sums = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return sums.select(F.lit(table).alias("table_name"), F.explode(entries).alias("r")).select("table_name", "r.*")


def check_unique(df: DataFrame, table: str, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Rows beyond the first of each key."""
    rows = df if where is None else df.where(where)
    surplus = rows.groupBy(*keys).agg((F.count("*") - 1).alias("n"))
    return surplus.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(f"unique({', '.join(keys)})").alias("rule"), "violations"
    )


def check_reference(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-NULL reference has no parent."""
    refs = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_ref")).agg(F.count("*").alias("n"))
    lost = refs.join(parent.select(F.col(parent_key).alias("_ref")).distinct(), "_ref", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(f"reference({column})").alias("rule"), "violations"
    )


def report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
