"""League tables: one table as of an instant, and both sides' table rows before every match."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.functions.names import LEAGUE, TEAM
from touchline.operators import history as H

BLOCK_ROWS = 5_000
HOUR_MICROS = 3_600_000_000
_TOTALS = ["played", "points", "goals_for", "goals_against"]


def table_as_of(played: DataFrame, cutoff: str) -> DataFrame:
    """The table of each league season from matches strictly before ``cutoff``."""
    before = played.where(F.col("kickoff") < F.lit(cutoff).cast("timestamp"))
    o = F.col("outcome")
    table = (
        H.team_matches(before)
        .groupBy(*TEAM)
        .agg(
            F.count("*").alias("played"),
            F.count_if(o == "W").alias("wins"),
            F.count_if(o == "D").alias("draws"),
            F.count_if(o == "L").alias("losses"),
            F.sum("goals_for").alias("goals_for"),
            F.sum("goals_against").alias("goals_against"),
            F.sum("points").alias("points"),
        )
        .withColumn("goal_difference", F.col("goals_for") - F.col("goals_against"))
    )
    order = Window.partitionBy(*LEAGUE).orderBy(
        F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"), F.asc("team_id")
    )
    return table.withColumn("position", F.row_number().over(order))


_POSITION = "competition_id long, season_id long, team_id long, at long, position long, points long, goal_difference long"


def _rank_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Walk one block in time order: answer the probes of an instant, then apply its results.

    The table is a sorted list of (-points, -difference, -goals, team); a position is a binary
    search, so the cost does not depend on the number of instants times teams.
    """
    table: list[tuple[int, int, int, int]] = []
    totals: dict[int, tuple[int, int, int]] = {}
    out = []

    def place(team: int) -> tuple[int, int, int, int]:
        points, scored, conceded = totals[team]
        return (-points, conceded - scored, -scored, team)

    rows = rows.sort_values(["at", "probe"], ascending=[True, False], kind="stable")
    for team, at, probe, points, scored, conceded in zip(
        rows["team_id"], rows["at"], rows["probe"], rows["points"], rows["goals_for"], rows["goals_against"]
    ):
        if probe:
            if team in totals:
                spot = place(team)
                out.append((team, at, bisect_left(table, spot) + 1, -spot[0], -spot[1]))
            continue
        if team in totals:
            spot = place(team)
            del table[bisect_left(table, spot)]
            p, s, c = totals[team]
            totals[team] = (p + points, s + scored, c + conceded)
        else:
            totals[team] = (points, scored, conceded)
        insort(table, place(team))
    frame = pd.DataFrame(out, columns=["team_id", "at", "position", "points", "goal_difference"])
    frame.insert(0, "season_id", key[1])
    frame.insert(0, "competition_id", key[0])
    return frame


def row_blocks(rows: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """The rows with ``_block``: numbers from 0 per league season, each of about ``size`` rows in time order.

    Rows are counted per league season and hour; the running count over the hours gives the block of an hour, so no
    window spans rows and a crowded stretch of time is cut into several blocks.
    """
    hour = F.floor(F.col("at") / F.lit(HOUR_MICROS))
    dated = rows.withColumn("_hour", hour)
    per = dated.groupBy(*LEAGUE, "_hour").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*LEAGUE).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    rough = per.select(*LEAGUE, "_hour", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(size)).alias("_rough"))
    dense = F.dense_rank().over(Window.partitionBy(*LEAGUE).orderBy("_rough")) - 1
    return dated.join(rough.select(*LEAGUE, "_hour", dense.alias("_block")), [*LEAGUE, "_hour"]).drop("_hour")


def positions(played: DataFrame, wanted: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Position, points and goal difference of each probed team strictly before its instant.

    Points and goals are summed per (team, instant) first. Every block of a league season then starts
    from the teams' totals of all earlier blocks, so the blocks of one season run in parallel.
    Probes of teams without an earlier match get no row.
    """
    long = H.team_matches(played).withColumn("played", F.lit(1).cast("long"))
    shape = [*[F.col(c).cast("long").alias(c) for c in TEAM], "at"]
    zeros = [F.lit(0).cast("long").alias(m) for m in _TOTALS]
    results = H.instant_totals(long, TEAM, _TOTALS).select(*shape, *_TOTALS, F.lit(False).alias("probe"))
    rows = row_blocks(results.unionByName(wanted.select(*shape, *zeros, F.lit(True).alias("probe"))), block_rows)

    per_block = rows.where(~F.col("probe")).groupBy(*TEAM, "_block").agg(*[F.sum(m).alias(m) for m in _TOTALS])
    upto = Window.partitionBy(*TEAM).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.groupBy(*LEAGUE).agg(F.max("_block").alias("_end"))
    following = F.lead("_block").over(Window.partitionBy(*TEAM).orderBy("_block"))
    closing = per_block.select(
        *TEAM, "_block", *[F.sum(m).over(upto).alias(m) for m in _TOTALS], following.alias("_next")
    ).join(ends, LEAGUE)
    until = F.coalesce(F.col("_next"), F.col("_end"))
    carried = (
        closing.where(until > F.col("_block"))
        .withColumn("_block", F.explode(F.sequence(F.col("_block") + 1, until)))
        .withColumns({"at": F.lit(H.BEFORE_ALL).cast("long"), "probe": F.lit(False)})
    )
    columns = [*TEAM, "at", "_block", "probe", *_TOTALS]
    walked = rows.select(*columns).unionByName(carried.select(*columns))
    return walked.groupBy(*LEAGUE, "_block").applyInPandas(_rank_block, _POSITION)
