"""Dataset build: window and cutoff rules, features, rows and manifest."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import features as Fe
from touchline.operators import history as H
from touchline.operators.reads import require_keys
from touchline.session import require_utc
from touchline.sources import datasets as D


def resolve_cutoff(cutoff: str | None, end: str | None) -> str:
    """Explicit cutoff, else the end of the window, else now; it may not lie before the end."""
    chosen = cutoff or end or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    if end is not None and _instant(chosen) < _instant(end):
        raise ValueError(f"data cutoff {chosen} lies before the end of the window {end}")
    return chosen


def _instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def build_window(
    matches: DataFrame,
    competitions: Sequence[int],
    seasons: Sequence[int],
    start: str | None,
    end: str | None,
    cutoff: str,
) -> tuple[DataFrame, DataFrame]:
    """(target matches, all matches they may use): both strictly before the cutoff."""
    if not competitions or not seasons:
        raise ValueError("competitions and seasons must both be given")
    k = F.col("kickoff")
    before = H.finished(matches).where(k < F.lit(cutoff).cast("timestamp"))
    targets = before.where(F.col("competition_id").isin(list(competitions)) & F.col("season_id").isin(list(seasons)))
    if start is not None:
        targets = targets.where(k >= F.lit(start).cast("timestamp"))
    if end is not None:
        targets = targets.where(k <= F.lit(end).cast("timestamp"))
    return targets, before


def dataset_rows(
    matches: DataFrame,
    team_stats: DataFrame,
    competitions: Sequence[int],
    seasons: Sequence[int],
    start: str | None = None,
    end: str | None = None,
    cutoff: str | None = None,
) -> DataFrame:
    """Examples of one build.

    Team features and statistics read the requested leagues and seasons only, by filters that reach the scan. Meetings
    come from every league and season, of the pairs that a target asks for, strictly before the cutoff and their kickoff.
    """
    spark = matches.sparkSession
    require_utc(spark)
    targets, before = build_window(matches, competitions, seasons, start, end, resolve_cutoff(cutoff, end))
    require_keys(spark.createDataFrame([(c,) for c in competitions], "competition_id long"), matches, "competition_id")
    require_keys(spark.createDataFrame([(s,) for s in seasons], "season_id long"), matches, "season_id")
    asked = F.col("competition_id").isin(list(competitions)) & F.col("season_id").isin(list(seasons))
    return Fe.build_examples(targets, before.where(asked), team_stats.where(asked), meetings_of=Fe.of_pairs(before, targets))


def build_dataset(
    matches: DataFrame,
    team_stats: DataFrame,
    path: str,
    version: str,
    competitions: Sequence[int],
    seasons: Sequence[int],
    start: str | None = None,
    end: str | None = None,
    cutoff: str | None = None,
) -> DataFrame:
    """Build, write and describe one dataset version; returns its manifest."""
    rows = dataset_rows(matches, team_stats, competitions, seasons, start, end, cutoff)
    now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    return D.write_dataset(rows, path, version, resolve_cutoff(cutoff, end), now, clustered=True)


