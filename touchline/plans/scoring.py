"""Batch scoring of unplayed matches from point-in-time features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.operators import features as Fe
from touchline.operators import history as H
from touchline.session import materialise, require_utc


def scoring_features(matches: DataFrame, team_stats: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Features of the requested, else all, matches that are not finished, from finished matches strictly before them.

    With a request only the league seasons of its matches are read, and the meetings of its pairs.
    """
    require_utc(matches.sparkSession)
    targets = matches.where(F.col("status") != "finished")
    history = H.finished(matches)
    if requested is None:
        return Fe.build_examples(targets, history, team_stats)
    targets = materialise(targets.join(requested.select("fixture_id").distinct(), "fixture_id", "left_semi"), "requested")
    return Fe.build_examples(targets, Fe.in_leagues(history, targets), Fe.in_leagues(team_stats, targets), meetings_of=Fe.of_pairs(history, targets))


def outcome_column(df: DataFrame) -> DataFrame:
    """``insufficient_history`` when neither side has an earlier match this season, else ``scored``."""
    none = F.col("home_table_position").isNull() & F.col("away_table_position").isNull()
    return df.withColumn("outcome", F.when(none, "insufficient_history").otherwise("scored"))


def score(requested: DataFrame, matches: DataFrame, team_stats: DataFrame, model) -> DataFrame:
    """One row per requested id: probabilities, or why there are none."""
    rows = scoring_features(matches, team_stats, requested)
    scored = model.transform(outcome_column(rows)).select("fixture_id", "outcome", "p_home_win", "p_draw", "p_away_win")
    out = requested.select("fixture_id").distinct().join(scored, "fixture_id", "left")
    ok = F.col("outcome") == "scored"
    return out.select(
        "fixture_id",
        F.coalesce("outcome", F.lit("unknown_match")).alias("outcome"),
        *[F.when(ok, F.col(c)).alias(c) for c in ("p_home_win", "p_draw", "p_away_win")],
    )


def score_rows(features: DataFrame, model) -> DataFrame:
    """Probabilities for given feature rows; every feature column must be present."""
    lost = [c for c in N.FEATURES if c not in features.columns]
    unknown = [c for c in features.columns if c not in N.DATASET_COLUMNS]
    if lost or unknown:
        raise ValueError(f"feature rows lack {lost} and carry unknown {unknown}")
    return model.transform(features)
