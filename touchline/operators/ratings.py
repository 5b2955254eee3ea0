"""Elo ratings as states after each (team, instant).

A rating couples two teams at every step, so the fold inside one league season is sequential. Rows come
sorted in Arrow batches and only the current ratings are carried on, so a season of any size needs the memory
of its teams.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.functions.names import LEAGUE, TEAM

K_FACTOR = 20.0
HOME_ADVANTAGE = 65.0
BASE_RATING = 1500.0

_STATE = "competition_id long, season_id long, team_id long, at long, rating double"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_TYPES = [pa.int64()] * 4 + [pa.float64()]


def rate(ratings: dict[int, float], home: int, away: int, hg: int, ag: int, k: float, hfa: float) -> None:
    """Fold one result into ``ratings``."""
    rh, ra = ratings.get(home, BASE_RATING), ratings.get(away, BASE_RATING)
    expected = 1.0 / (1.0 + 10.0 ** ((ra - (rh + hfa)) / 400.0))
    actual = 1.0 if hg > ag else 0.0 if hg < ag else 0.5
    ratings[home] = rh + k * (actual - expected)
    ratings[away] = ra + k * ((1.0 - actual) - (1.0 - expected))


def fold_ratings(
    games: pd.DataFrame, ratings: dict[int, float], k: float = K_FACTOR, hfa: float = HOME_ADVANTAGE
) -> Iterator[tuple[int, int, float]]:
    """Fold results in (kickoff, id) order into ``ratings``; yield (team, at, rating) as each instant closes."""
    touched: dict[int, float] = {}
    now = None
    for at, home, away, hg, ag in zip(
        games["at"], games["home_team_id"], games["away_team_id"], games["home_goals"], games["away_goals"]
    ):
        if at != now and touched:
            yield from ((t, now, r) for t, r in touched.items())
            touched = {}
        now = at
        rate(ratings, home, away, hg, ag, k, hfa)
        touched[home], touched[away] = ratings[home], ratings[away]
    yield from ((t, now, r) for t, r in touched.items())


def stream_ratings(batches, k: float = K_FACTOR, hfa: float = HOME_ADVANTAGE) -> Iterator[pa.RecordBatch]:
    """Ratings after each instant of rows sorted by league season, instant and id.

    The ratings of one league season are all that is carried from batch to batch.
    """
    league, now = None, None
    ratings: dict[int, float] = {}
    touched: dict[int, float] = {}
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        made = pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(_TYPES)], names=_NAMES)
        out.clear()
        return made

    for batch in batches:
        for comp, season, at, _, home, away, hg, ag in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if at != now or (comp, season) != league:
                out.extend((*league, t, now, r) for t, r in touched.items())
                touched = {}
                if (comp, season) != league:
                    league, ratings = (comp, season), {}
                now = at
            rate(ratings, home, away, hg, ag, k, hfa)
            touched[home], touched[away] = ratings[home], ratings[away]
        yield flush()
    out.extend((*league, t, now, r) for t, r in touched.items())
    yield flush()


def rating_states(played: DataFrame, k: float = K_FACTOR, hfa: float = HOME_ADVANTAGE) -> DataFrame:
    """(league, team, at, struct elo(rating)): the rating after each instant a team played."""
    games = played.select(
        *[F.col(c).cast("long") for c in LEAGUE],
        X.instant("kickoff").alias("at"),
        F.col("fixture_id").cast("long"),
        *[F.col(c).cast("long") for c in ("home_team_id", "away_team_id", "home_goals", "away_goals")],
    )
    ordered = games.repartition(*LEAGUE).sortWithinPartitions(*LEAGUE, "at", "fixture_id")
    states = ordered.mapInArrow(lambda batches: stream_ratings(batches, k, hfa), _STATE)
    return states.select(*TEAM, "at", F.struct(F.col("rating")).alias("elo"))
