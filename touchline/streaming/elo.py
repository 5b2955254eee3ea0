"""Ratings as running state of a stream, in kickoff order.

Each league season keeps keyed state: its waiting results as a list with an entry per row, the ratings as a map by team,
and the last instant folded. One timer per league season stands at the earliest waiting instant; when the watermark has
passed it, all results that are due are folded in time order, and the timer moves to the next one. A row whose kickoff
was already released is reported as late and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.functions import scalars as X
from touchline.functions.names import LEAGUE
from touchline.operators.ratings import BASE_RATING, HOME_ADVANTAGE, K_FACTOR, rate

_OUT = (
    "competition_id long, season_id long, fixture_id long, at long, home_elo double, away_elo double, late boolean"
)
_COLS = ["at", "fixture_id", "home_team_id", "away_team_id", "home_goals", "away_goals"]


class RatingState(StatefulProcessor):
    """Waiting results, ratings by team, last instant released, and the timer that is set."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} long" for c in _COLS))
        self.ratings = handle.getMapState("ratings", "team_id long", "rating double")
        self.released = handle.getValueState("released", "at long")
        self.timer = handle.getValueState("timer", "due long")

    def _wake(self, rows: list[tuple]) -> None:
        """Set the timer for the earliest row, a millisecond after it, unless an earlier one is set."""
        due = min(r[0] for r in rows) // 1000 + 1
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or due < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        released = self.released.get()[0] if self.released.exists() else None
        late = []
        for df in rows:
            new = [tuple(r) for r in df[_COLS].astype("int64").values.tolist()]
            late += [(*key, r[1], r[0], None, None, True) for r in new if released is not None and r[0] <= released]
            fresh = [r for r in new if released is None or r[0] > released]
            if fresh:
                self.waiting.appendList(fresh)
                self._wake(fresh)
        yield _frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        games = sorted(r for r in held if r[0] // 1000 + 1 <= mark)
        rest = [r for r in held if r[0] // 1000 + 1 > mark]
        self.timer.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest)
        else:
            self.waiting.clear()
        if not games:
            return
        ratings = {t[0]: v[0] for t, v in self.ratings.iterator()}
        before = dict(ratings)
        out, i = [], 0
        while i < len(games):
            j = i
            while j < len(games) and games[j][0] == games[i][0]:  # one instant reads the ratings before it
                at, fid, home, away, *_ = games[j]
                out.append((*key, fid, at, ratings.get(home, BASE_RATING), ratings.get(away, BASE_RATING), False))
                j += 1
            for g in games[i:j]:
                rate(ratings, *g[2:], K_FACTOR, HOME_ADVANTAGE)
            i = j
        for team, value in ratings.items():
            if before.get(team) != value:
                self.ratings.updateValue((team,), (value,))
        self.released.update((games[-1][0],))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
    return out.astype({"home_elo": "float64", "away_elo": "float64"})


def rating_stream(results: DataFrame, delay: str = "6 hours") -> DataFrame:
    """Pre-match ratings of a stream of finished matches.

    Keyed state needs the RocksDB store: start the stream inside ``state_settings`` or in a session of ``build_session``.
    """
    rows = results.withWatermark("kickoff", delay).select(
        *[F.col(c).cast("long").alias(c) for c in LEAGUE], "kickoff", X.instant("kickoff").alias("at"), *[F.col(c).cast("long") for c in _COLS[1:]]
    )
    return rows.groupBy(*LEAGUE).transformWithStateInPandas(RatingState(), _OUT, "Append", "EventTime")
