"""Key resolution and upserts of staged provider rows, with one outcome per row.

Dimension tables (teams, players, competitions, seasons, matches) are joined by external id with plain
equi-joins: Spark broadcasts a side whose measured size allows it and shuffles it otherwise. Lineups, of which there
are as many as matches, always meet the matches in a merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import upsert as U
from touchline.session import materialise
from touchline.sources.payloads import split_rejects

COUNTERS = ["received", "inserted", "updated", "skipped", "failed"]


def _ids(dim: DataFrame, name: str, *extra: str) -> DataFrame:
    return dim.select(F.col("external_id").alias(f"{name}_external_id"), F.col("id").alias(f"{name}_id"), *extra)


def resolve_matches(staged: DataFrame, teams: DataFrame, competitions: DataFrame, seasons: DataFrame) -> DataFrame:
    """Add internal ids. Rows with an unknown side, competition or season are ``skipped``."""
    years = seasons.select(F.col("competition_id"), F.col("year").alias("season_year"), F.col("id").alias("season_id"))
    out = (
        staged.join(_ids(competitions, "competition"), "competition_external_id", "left")
        .join(years, ["competition_id", "season_year"], "left")
        .join(_ids(teams, "home_team"), "home_team_external_id", "left")
        .join(_ids(teams, "away_team"), "away_team_external_id", "left")
    )
    why = (
        F.when(F.col("competition_id").isNull(), "unknown competition")
        .when(F.col("season_id").isNull(), "unknown season")
        .when(F.col("home_team_id").isNull() | F.col("away_team_id").isNull(), "unknown team")
    )
    return out.withColumn("skip", why)


def resolve_injuries(
    staged: DataFrame, players: DataFrame, teams: DataFrame, competitions: DataFrame, matches: DataFrame
) -> DataFrame:
    """Player and team are required; competition and match stay NULL when unknown."""
    out = staged
    for name, dim in (("player", players), ("team", teams), ("competition", competitions), ("fixture", matches)):
        out = out.join(_ids(dim, name), f"{name}_external_id", "left")
    why = F.when(F.col("player_id").isNull() | F.col("team_id").isNull(), "unknown player or team")
    return out.withColumn("skip", why)


def resolve_lineups(
    staged: DataFrame, matches: DataFrame, teams: DataFrame, players: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(parents, slots): a lineup needs its match and team; an unknown player loses only its slot."""
    heads = (
        staged.join(_ids(matches, "fixture", F.col("home_team_id")).hint("merge"), "fixture_external_id", "left")
        .join(_ids(teams, "team"), "team_external_id", "left")
        .withColumn("is_home", F.col("team_id") == F.col("home_team_id"))
        .withColumn(
            "skip",
            F.when(F.col("fixture_id").isNull(), "unknown match").when(F.col("team_id").isNull(), "unknown team"),
        )
    )
    slots = (
        heads.where(F.col("skip").isNull())
        .select("fixture_id", "team_id", F.posexplode("players").alias("slot", "p"))
        .select("fixture_id", "team_id", "slot", "p.*")
        .join(_ids(players, "player"), "player_external_id", "left")
        .withColumn("skip", F.when(F.col("player_id").isNull(), "unknown player"))
    )
    return heads.drop("players", "home_team_id"), slots


def resolve_player_statistics(
    staged_players: DataFrame, staged_stats: DataFrame, players: DataFrame, team_id: Column, competitions: DataFrame, seasons: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Upsert the players first, new ones with new ids, then link their statistics to the ids of that result."""
    merged = U.assign_ids(U.merge_upsert(players, staged_players, ["external_id"], U.PLAYER_POLICY, "landing"))
    stats = (
        staged_players.select(F.col("external_id").alias("player_external_id"))
        .distinct()
        .join(staged_stats, "player_external_id", "left")
        .join(_ids(merged, "player"), "player_external_id", "left")
        .join(_ids(competitions, "competition"), "competition_external_id", "left")
        .join(
            seasons.select("competition_id", F.col("external_id").alias("season_external_id"), F.col("id").alias("season_id")),
            ["competition_id", "season_external_id"],
            "left",
        )
        .withColumn("team_id", team_id)
        .withColumn("skip", F.when(F.col("appearances").isNull(), "no statistics"))
    )
    return merged, stats


def resolve_team_statistics(staged: DataFrame, teams: DataFrame, competitions: DataFrame, seasons: DataFrame, stamp: str) -> DataFrame:
    """Team totals with internal ids, stamped with the pull date."""
    years = seasons.select("competition_id", F.col("external_id").alias("season_external_id"), F.col("id").alias("season_id"))
    return (
        staged.drop("as_of_date")
        .join(_ids(teams, "team"), "team_external_id", "left")
        .join(_ids(competitions, "competition"), "competition_external_id", "left")
        .join(years, ["competition_id", "season_external_id"], "left")
        .withColumn("as_of_date", F.lit(stamp).cast("date"))
        .withColumn("skip", F.when(F.col("team_id").isNull() | F.col("season_id").isNull(), "unknown team or season"))
    )


def resolve_seasons(staged: DataFrame, competitions: DataFrame, configured_year: int) -> DataFrame:
    """Season rows of known competitions; current means flagged by the provider and configured."""
    return (
        staged.join(_ids(competitions, "competition"), "competition_external_id", "left")
        .withColumn("is_current", F.col("is_current") & (F.col("year") == configured_year))
        .withColumn("skip", F.when(F.col("competition_id").isNull(), "unknown competition"))
    )


def season_year(listed: DataFrame, known: DataFrame, configured_year: int) -> DataFrame:
    """Per competition the configured year when it is stored, else the current one, else the last listed."""
    stored = known.where(F.col("external_id") == configured_year).limit(1).count() > 0
    if stored:
        pick = F.lit(configured_year).cast("long")
    else:
        current = F.min_by("year", F.when(F.col("is_current"), F.col("position")))
        pick = F.coalesce(current, F.max_by("year", "position"))
    return listed.groupBy("competition_external_id").agg(F.max(F.lit(1)).alias("_n"), pick.alias("season_year")).drop("_n")


def ingest_matches(staged: DataFrame, target: DataFrame, teams: DataFrame, competitions: DataFrame, seasons: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Resolve, then upsert what has all its keys: (table with ``_outcome``, skipped rows with their reason)."""
    resolved = resolve_matches(staged, teams, competitions, seasons)
    merged = U.upsert_matches(target, resolved.where(F.col("skip").isNull()), now)
    return merged, resolved.where(F.col("skip").isNotNull())


def ingest_teams(staged: DataFrame, target: DataFrame, competitions: DataFrame, seasons: DataFrame, policy: dict[str, U.Policy]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Teams listed per league season: (table with ``_outcome``, skipped rows, failed rows).

    A row of an unknown league fails, one of a season that is not stored is skipped, and a team of several
    leagues is one row.
    """
    years = seasons.select("competition_id", F.col("external_id").alias("season_external_id"), F.col("id").alias("season_id"))
    found = staged.join(_ids(competitions, "competition"), "competition_external_id", "left").join(years, ["competition_id", "season_external_id"], "left")
    known = found.where(F.col("competition_id").isNotNull() & F.col("season_id").isNotNull())
    merged = U.assign_ids(U.merge_upsert(target, known, ["external_id"], policy, "landing"))
    return merged, found.where(F.col("competition_id").isNotNull() & F.col("season_id").isNull()), found.where(F.col("competition_id").isNull())


def counters(job: str, outcomes: DataFrame, requested: int, rejected: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """One row of counters from rows that carry ``_outcome``; rejected rows failed, skipped rows had unknown keys."""
    o = F.col("_outcome")
    for rows, name in ((rejected, "failed"), (skipped, "skipped")):
        if rows is not None:
            outcomes = outcomes.select("_outcome").unionByName(rows.select(F.lit(name).alias("_outcome")))
    return outcomes.agg(
        F.lit(job).alias("job"),
        F.lit(requested).cast("long").alias("requested"),
        F.count_if(o != "untouched").alias("received"),
        *[F.count_if(o == c).alias(c) for c in COUNTERS[1:]],
    )


def total_counters(parts: DataFrame, job: str = "full_bootstrap") -> DataFrame:
    """Sum of the counters of several jobs."""
    return parts.agg(F.lit(job).alias("job"), *[F.sum(c).cast("long").alias(c) for c in ("requested", *COUNTERS)])


# ---------------------------------------------------------------- the whole bootstrap

STAGES = ("competitions_seasons", "teams", "matches", "team_statistics")
STATISTICS_KEY = ["team_id", "competition_id", "season_id", "as_of_date"]
Staged = tuple[DataFrame, DataFrame]  # accepted rows, rejected rows


def staged_once(staged: DataFrame, name: str) -> Staged:
    """(accepted rows, rejected rows) of parsed pages that are written once, so that no later reader parses them again."""
    return split_rejects(materialise(staged, f"staged-{name}"))


def ingest_competitions(staged: DataFrame, listed: DataFrame, competitions: DataFrame, seasons: DataFrame, year: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leagues and their seasons: (competitions, seasons, skipped seasons); both tables carry ``_outcome`` and ids."""
    leagues = materialise(U.assign_ids(U.merge_upsert(competitions, staged, ["external_id"], U.all_columns(competitions, ["external_id", "id"]), "landing")), "competitions")
    found = resolve_seasons(listed, leagues, year)
    key = ["competition_id", "year"]
    rows = found.where(F.col("skip").isNull())
    merged = U.merge_upsert(seasons, rows, key, U.all_columns(seasons, [*key, "id"]), "landing")
    merged = U.assign_ids(merged.withColumn("_key", F.struct(*key)), "_key").drop("_key")
    return leagues, materialise(merged, "seasons"), found.where(F.col("skip").isNotNull())


def ingest_team_statistics(staged: DataFrame, target: DataFrame, teams: DataFrame, competitions: DataFrame, seasons: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """Team totals of one pull date: (table with ``_outcome``, skipped rows). A second pull of a day overwrites the first."""
    found = resolve_team_statistics(staged, teams, competitions, seasons, stamp)
    rows = found.where(F.col("skip").isNull()).withColumn("landing", F.monotonically_increasing_id())
    return U.merge_upsert(target, rows, STATISTICS_KEY, U.all_columns(target, STATISTICS_KEY), "landing"), found.where(F.col("skip").isNotNull())


def bootstrap(staged: dict[str, Staged], stored: dict[str, DataFrame], leagues: int, year: int, now: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Competitions and seasons, teams, matches, team statistics, in this order: (tables with ``_outcome``, counters).

    ``staged`` holds (accepted, rejected) rows of ``competitions``, ``seasons``, ``teams``, ``matches`` and
    ``team_statistics``, ``stored`` the tables of these names. Every stage is written before the next one resolves
    against it. A bad row fails alone; rows of a league or season that an earlier stage could not bring in are failed
    or skipped, and all other leagues go on. The counters have one row per stage and their sum.
    """
    out: dict[str, DataFrame] = {}
    report = []

    def done(stage: str, outcomes: DataFrame, failed: list[DataFrame], skipped: list[DataFrame]) -> None:
        outcomes = outcomes.select("_outcome")
        for rows, name in ((failed, "failed"), (skipped, "skipped")):
            for part in rows:
                outcomes = outcomes.unionByName(part.select(F.lit(name).alias("_outcome")))
        report.append(counters(stage, outcomes, leagues))

    plain = lambda name: out[name].drop("_outcome")
    comps, comps_bad = staged["competitions"]
    listed, listed_bad = staged["seasons"]
    out["competitions"], out["seasons"], unknown = ingest_competitions(comps, listed, stored["competitions"], stored["seasons"], year)
    both = out["competitions"].select("_outcome").unionByName(out["seasons"].select("_outcome"))
    done(STAGES[0], both, [comps_bad, listed_bad], [unknown])

    rows, bad = staged["teams"]
    merged, skipped, failed = ingest_teams(rows, stored["teams"], plain("competitions"), plain("seasons"), U.all_columns(stored["teams"], ["external_id", "id"]))
    out["teams"] = materialise(merged, "teams")
    done(STAGES[1], out["teams"], [bad, failed], [skipped])

    rows, bad = staged["matches"]
    merged, skipped = ingest_matches(rows, stored["matches"], plain("teams"), plain("competitions"), plain("seasons"), now)
    out["matches"] = materialise(merged, "matches")
    done(STAGES[2], out["matches"], [bad], [skipped])

    rows, bad = staged["team_statistics"]
    merged, skipped = ingest_team_statistics(rows, stored["team_statistics"], plain("teams"), plain("competitions"), plain("seasons"), now[:10])
    out["team_statistics"] = materialise(merged, "team-statistics")
    done(STAGES[3], out["team_statistics"], [bad], [skipped])
    stages = materialise(reduce(DataFrame.unionByName, report), "bootstrap-report")
    return out, stages.unionByName(total_counters(stages).select(*stages.columns))
