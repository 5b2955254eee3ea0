"""Read models: filtered lists, pages, latest-per-key lookups, the match feed and match detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.functions.names import LEAGUE, SIDES
from touchline.operators import history as H

SNAPSHOT = ["fixtures_played", "form", "xg", "xga", "corners", "yellow_cards", "red_cards", "possession_avg"]


# --- pages and filters ----------------------------------------------------------------------


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; Spark keeps only limit + offset rows per task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page whose rows carry the number of rows before paging."""
    return page(df, order, limit, offset).withColumn("total", F.lit(df.count()))


def _equal(df: DataFrame, **wanted) -> DataFrame:
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def _between(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    if first is not None:
        df = df.where(F.col(column) >= F.lit(first).cast("timestamp"))
    if last is not None:
        df = df.where(F.col(column) <= F.lit(last).cast("timestamp"))
    return df


def upcoming(matches: DataFrame, first: str | None = None, last: str | None = None, **ids) -> DataFrame:
    """Scheduled or running matches in the closed window."""
    return _between(_equal(matches.where(F.col("status").isin("scheduled", "in_play")), **ids), "kickoff", first, last)


def feed_window(
    matches: DataFrame,
    day: str | None = None,
    first: str | None = None,
    last: str | None = None,
    team_id: int | None = None,
    now: str | None = None,
    **ids,
) -> DataFrame:
    """Matches of one UTC day, else of the closed window, else of the seven days from ``now``."""
    k = F.col("kickoff")
    if day is not None:
        start = F.lit(day).cast("timestamp")
        out = matches.where((k >= start) & (k < start + F.expr("interval 1 day")))
    else:
        base = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        lo = F.lit(first).cast("timestamp") if first else base
        hi = F.lit(last).cast("timestamp") if last else base + F.expr("interval 7 days")
        out = matches.where((k >= lo) & (k <= hi))
    if team_id is not None:
        out = out.where((F.col("home_team_id") == team_id) | (F.col("away_team_id") == team_id))
    return _equal(out, **ids)


def finished_without_outcome(matches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Finished matches none of whose predictions is evaluated yet."""
    done = outcomes.select("fixture_id").distinct()
    return matches.where(F.col("status") == "finished").join(done, "fixture_id", "left_anti")


def finished_since(matches: DataFrame, since: str, competition_id: int | None = None) -> DataFrame:
    rows = matches.where((F.col("status") == "finished") & (F.col("finished_at") >= F.lit(since).cast("timestamp")))
    return _equal(rows, competition_id=competition_id)


def overdue(matches: DataFrame, first: str, last: str) -> DataFrame:
    """Kickoff inside the closed window but not finished."""
    return _between(matches.where(F.col("status") != "finished"), "kickoff", first, last)


def active_injuries(injuries: DataFrame, competition_id: int | None = None) -> DataFrame:
    return _equal(injuries.where(F.col("status").isin("active", "doubtful")), competition_id=competition_id)


def by_keys(df: DataFrame, column: str, keys: Sequence) -> DataFrame:
    """Bulk lookup; an empty key list gives no rows."""
    return df.where(F.col(column).isin(list(keys))) if keys else df.where(F.lit(False))


def current_season(seasons: DataFrame, competition_id: int) -> DataFrame:
    """The season of a competition that is marked current, the latest of several."""
    return _equal(seasons.where("is_current"), competition_id=competition_id).orderBy(F.desc("year")).limit(1)


def season_of_year(seasons: DataFrame, competition_id: int, year: int) -> DataFrame:
    return _equal(seasons, competition_id=competition_id, year=year)


def active_version(versions: DataFrame, name: str) -> DataFrame:
    """The active version of a model, the newest of several."""
    return _equal(versions.where("is_active"), name=name).orderBy(F.desc("id")).limit(1)


def of_match(rows: DataFrame, fixture_id: int) -> DataFrame:
    """Rows of any table that belong to one match."""
    return _equal(rows, fixture_id=fixture_id)


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are not known."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def require_keys(wanted: DataFrame, known: DataFrame, key: str) -> None:
    """Raise when a wanted key is unknown; the message has their number and, of many, the twenty smallest."""
    lost = missing_keys(wanted, known, key)
    n = lost.count()
    if n:
        first = [r[0] for r in lost.orderBy(key).limit(20).collect()]
        raise ValueError(f"unknown {key}: {first}" + (f" and {n - len(first)} more" if n > len(first) else ""))


def eligible(matches: DataFrame, predictions: DataFrame, version: int, now: str, min_hours: int = 1) -> DataFrame:
    """Unplayed matches far enough ahead that this model version has not predicted yet."""
    start = F.lit(now).cast("timestamp") + F.make_dt_interval(hours=F.lit(min_hours))
    mine = predictions.where(F.col("model_version_id") == version).select("fixture_id")
    rows = matches.where((F.col("status") == "scheduled") & (F.col("kickoff") >= start))
    return rows.join(mine, "fixture_id", "left_anti")


def known_before_kickoff(matches: DataFrame, injuries: DataFrame, lineups: DataFrame) -> DataFrame:
    """Per match the injuries that began, and lineups published, strictly before kickoff.

    Injuries meet the matches of their team, so both sides are first summed: injury starts per (team,
    day) and matches per (team, kickoff); a running count answers every kickoff in one window pass.
    """
    starts = injuries.select("team_id", F.unix_micros(F.col("start_date").cast("timestamp")).alias("at"), F.lit(1).cast("long").alias("n"))
    totals = H.instant_totals(starts, ["team_id"], ["n"])
    states = H.running_states(totals, ["team_id"], ["n"], "hurt")
    sides = matches.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), X.instant("kickoff").alias("at"))
    looked = H.as_of(sides.distinct(), [states], ["team_id"], ["hurt"])
    out = matches.withColumn("_at", X.instant("kickoff"))
    for s in SIDES:
        mine = looked.select(F.col("team_id").alias(f"{s}_team_id"), F.col("at").alias("_at"), F.coalesce(F.col("hurt")["n"], F.lit(0)).alias(f"{s}_injuries"))
        out = out.join(mine, [f"{s}_team_id", "_at"], "left")
    seen = (
        lineups.join(matches.select("fixture_id", "kickoff"), "fixture_id")
        .where(F.col("updated_external_at") < F.col("kickoff"))
        .groupBy("fixture_id")
        .agg(F.count("*").alias("lineups"))
    )
    return out.join(seen, "fixture_id", "left").withColumn("lineups", F.coalesce("lineups", F.lit(0))).drop("_at")


# --- latest per key -------------------------------------------------------------------------


def latest_snapshot(team_stats: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """Latest snapshot per (team, league season) on or before one day."""
    rows = team_stats.where(F.col("as_of_date") <= F.lit(day).cast("date"))
    best = rows.groupBy("team_id", *LEAGUE).agg(F.max_by(F.struct("as_of_date", *columns), "as_of_date").alias("stats"))
    return best.select("team_id", *LEAGUE, "stats.*")


def snapshot_as_of(probes: DataFrame, team_stats: DataFrame, columns: Sequence[str], strict: bool) -> DataFrame:
    """For (team, league season, day) probes the latest snapshot before the day, or up to it."""
    keys = [*LEAGUE, "team_id"]
    at = F.unix_micros(F.col("day").cast("timestamp"))
    wanted = probes.select(*keys, at.alias("at")).distinct()
    states = team_stats.select(
        *keys, F.unix_micros(F.col("as_of_date").cast("timestamp")).alias("at"), F.struct("as_of_date", *columns).alias("stats")
    )
    found = H.as_of(wanted, [states], keys, ["stats"], strict=strict)
    return found.select(*keys, F.timestamp_micros("at").cast("date").alias("day"), "stats")


def latest_prediction(predictions: DataFrame, versions: DataFrame) -> DataFrame:
    """Newest prediction per match with its model label."""
    cols = [c for c in predictions.columns if c != "fixture_id"]
    best = predictions.groupBy("fixture_id").agg(
        F.max_by(F.struct(*cols), F.struct("created_at", "prediction_id")).alias("p")
    )
    names = versions.select(F.col("id").alias("model_version_id"), F.concat_ws(" v", "name", "version").alias("model_label"))
    return best.select("fixture_id", "p.*").join(names, "model_version_id")


def per_match(value: str, played: str = "fixtures_played") -> Column:
    """Average per played match, two decimals; NULL without matches."""
    return F.when(F.col(played) > 0, F.round(F.try_divide(F.col(value).cast("double"), F.col(played)), 2))


# --- feed -----------------------------------------------------------------------------------


def market_columns(eg_home: Column, eg_away: Column, xg_home: Column, xg_away: Column) -> dict[str, Column]:
    """Goal markets from expected goals, else from team xG; a rate of zero counts as absent."""
    zero = F.lit(0.0)
    lh = F.nullif(F.coalesce(F.nullif(eg_home, zero), xg_home), zero)
    la = F.nullif(F.coalesce(F.nullif(eg_away, zero), xg_away), zero)
    ou, bt = X.over_under_25(lh, la), X.both_score(lh, la)
    return {"over_2_5": ou["over"], "under_2_5": ou["under"], "btts_yes": bt["yes"], "btts_no": bt["no"]}


def hydrate(
    matches: DataFrame,
    competitions: DataFrame,
    seasons: DataFrame,
    teams: DataFrame,
    snapshots: DataFrame,
    predictions: DataFrame,
) -> DataFrame:
    """Match rows with their dimensions, both sides' statistics, latest prediction and markets.

    ``snapshots`` and ``predictions`` hold one row per key (see ``latest_snapshot``, ``latest_prediction``).
    """
    out = matches.join(
        competitions.select(F.col("id").alias("competition_id"), F.col("name").alias("competition")), "competition_id", "left"
    ).join(seasons.select("competition_id", F.col("id").alias("season_id"), F.col("year").alias("season")), LEAGUE, "left")
    stat_cols = [c for c in snapshots.columns if c not in ("team_id", *LEAGUE)]
    for s in SIDES:
        out = out.join(teams.select(F.col("id").alias(f"{s}_team_id"), F.col("name").alias(f"{s}_team")), f"{s}_team_id", "left")
        own = snapshots.select(
            F.col("team_id").alias(f"{s}_team_id"), *LEAGUE, *[F.col(c).alias(f"{s}_{c}") for c in stat_cols]
        )
        out = out.join(own, [f"{s}_team_id", *LEAGUE], "left")
    keep = ["model_label", "p_home_win", "p_draw", "p_away_win", "expected_home_goals", "expected_away_goals"]
    out = out.join(predictions.select("fixture_id", *keep), "fixture_id", "left")
    return out.withColumns(
        market_columns(*[F.col(c) for c in ("expected_home_goals", "expected_away_goals", "home_xg", "away_xg")])
    )


def nested_response(hydrated: DataFrame) -> DataFrame:
    """The feed item as one nested struct per match."""
    c = F.col
    return hydrated.select(
        "fixture_id",
        F.struct(
            "fixture_id",
            "kickoff",
            "status",
            F.struct(c("competition_id").alias("id"), c("competition").alias("name")).alias("competition"),
            F.struct(c("season_id").alias("id"), c("season").alias("year")).alias("season"),
            *[F.struct(c(f"{s}_team_id").alias("id"), c(f"{s}_team").alias("name")).alias(f"{s}_team") for s in SIDES],
            F.when(c("model_label").isNotNull(), F.struct("model_label", "p_home_win", "p_draw", "p_away_win")).alias("w1x2"),
            F.when(c("over_2_5").isNotNull(), F.struct("over_2_5", "under_2_5", "btts_yes", "btts_no")).alias("goals"),
            F.struct("home_xg", "home_xga", "away_xg", "away_xga").alias("metrics"),
        ).alias("item"),
    )


def group_feed(items: DataFrame) -> DataFrame:
    """One page of the feed grouped by competition, in kickoff order. Input is a page, hence bounded."""
    entry = F.struct("kickoff", "fixture_id")
    return items.groupBy("competition_id").agg(
        F.count("*").alias("matches"),
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["fixture_id"]).alias("fixture_ids"),
    )


# --- detail and evaluation ------------------------------------------------------------------


def detail(
    wanted: DataFrame, played: DataFrame, injuries: DataFrame, lineups: DataFrame, predictions: DataFrame, explanations: DataFrame, meetings: int = 5
) -> DataFrame:
    """Detail of the wanted matches: latest meetings of the pair, active injuries, lineups, prediction.

    The newest meetings are read from a running list per pair and the injuries are counted per team
    before the join, so no row of one side meets every row of the other. ``predictions`` holds one
    row per match.
    """
    pair = ["pair_lo", "pair_hi"]
    keyed = {"pair_lo": F.least("home_team_id", "away_team_id"), "pair_hi": F.greatest("home_team_id", "away_team_id")}
    w = wanted.select("fixture_id", "kickoff", "home_team_id", "away_team_id", *LEAGUE).withColumns(keyed)
    w = w.withColumn("at", X.instant("kickoff"))
    past = played.withColumns(keyed).withColumn("at", X.instant("kickoff"))
    lists = H.recent_lists(past, pair, meetings, ["home_team_id", "home_goals", "away_goals"], "met")
    met = H.as_of(w.select(*pair, "at").distinct(), [lists], pair, ["met"])
    out = w.join(met, [*pair, "at"], "left").withColumn("h2h", F.col("met")["items"]).drop("met", "at", *pair)
    hurt = active_injuries(injuries).groupBy("team_id").agg(F.count("*").alias("n"))
    for s in SIDES:
        own = hurt.select(F.col("team_id").alias(f"{s}_team_id"), F.col("n").alias(f"{s}_injuries"))
        out = out.join(own, f"{s}_team_id", "left").withColumn(f"{s}_injuries", F.coalesce(f"{s}_injuries", F.lit(0)))
    line = lineups.groupBy("fixture_id").agg(F.count("*").alias("lineups"))
    p = predictions.join(explanations, "prediction_id", "left")
    p = p.drop(*[c for c in p.columns if c in out.columns and c != "fixture_id"])
    return out.join(line, "fixture_id", "left").join(p, "fixture_id", "left")


def evaluate_pending(predictions: DataFrame, played: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome rows for predictions made before kickoff of finished matches and not evaluated yet."""
    rows = (
        predictions.join(played.select("fixture_id", *LEAGUE, F.col("kickoff").alias("_k"), "home_goals", "away_goals"), "fixture_id")
        .where(F.col("created_at") < F.col("_k"))
        .join(outcomes.select("prediction_id"), "prediction_id", "left_anti")
    )
    p = [F.col(c) for c in ("p_home_win", "p_draw", "p_away_win")]
    actual = X.outcome_class(F.col("home_goals"), F.col("away_goals"))
    label = F.array(F.lit("home"), F.lit("draw"), F.lit("away"))
    brier = sum((F.pow(p[i] - (F.col("_y") == i).cast("double"), F.lit(2.0)) for i in range(3)), F.lit(0.0))
    truth = X.pick3(F.col("_y"), *p)
    return rows.withColumns({"_y": actual, "_p": X.argmax3(*p)}).select(
        "prediction_id",
        "fixture_id",
        "model_version_id",
        *LEAGUE,
        F.col("home_goals").alias("actual_home_goals"),
        F.col("away_goals").alias("actual_away_goals"),
        F.get(label, F.col("_y")).alias("actual_result"),
        F.get(label, F.col("_p")).alias("predicted_result"),
        (F.col("_y") == F.col("_p")).alias("correct"),
        brier.alias("brier_score"),
        (-X.clipped_log(truth)).alias("log_loss"),
        truth.alias("probability_of_truth"),
        F.greatest(*p).alias("confidence"),
    )


def prediction_list(predictions: DataFrame, outcomes: DataFrame, state: str | None = None, correct: bool | None = None) -> DataFrame:
    """Predictions with their outcome where there is one; ``state`` is pending or evaluated."""
    cols = [F.col(c) for c in outcomes.columns if c == "prediction_id" or c not in predictions.columns]
    out = predictions.join(outcomes.select(*cols).withColumn("evaluated", F.lit(True)), "prediction_id", "left")
    out = out.withColumn("evaluated", F.coalesce("evaluated", F.lit(False)))
    if state is not None:
        out = out.where(F.col("evaluated") == (state == "evaluated"))
    if correct is not None:
        out = out.where(F.col("correct") == correct)
    return out
