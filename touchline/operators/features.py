"""The feature families and their assembly: 66 columns per match, all strictly before kickoff.

Families that depend on one team share one table keyed by (league season, team, instant). A match
then needs three joins in all: that table for the home side, for the away side, and the pair table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import scalars as X
from touchline.operators import history as H
from touchline.operators import ratings, standings
from touchline.session import materialise

MIN_MEETINGS = 3
RECENT, VENUE = (3, 5, 10), (5,)
_MEASURES = ["wins", "draws", "goals_for", "goals_against"]
_MEETING = ["meetings", "lo_wins", "hi_wins", "drawn", "goals"]


# --- states ---------------------------------------------------------------------------------


def _long(played: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return H.team_matches(played).withColumns(
        {"wins": (o == "W").cast("long"), "draws": (o == "D").cast("long")}
    )


def recent(played: DataFrame) -> DataFrame:
    """After each instant: sums over the team's last 3, 5 and 10 matches."""
    return H.recent_states(_long(played), N.TEAM, RECENT, _MEASURES, "recent")


def venue(played: DataFrame) -> DataFrame:
    """After each instant: sums over the team's last 5 matches on that ground, home and away apart."""
    own = H.recent_states(_long(played), [*N.TEAM, "is_home"], VENUE, _MEASURES, "own")
    return own.select(
        *N.TEAM,
        "at",
        F.when(F.col("is_home"), F.col("own")).alias("at_home"),
        F.when(~F.col("is_home"), F.col("own")).alias("at_away"),
    )


def snapshots(team_stats: DataFrame) -> DataFrame:
    """Statistics snapshots on the instant axis: visible from the day after ``as_of_date``."""
    return team_stats.select(
        *N.TEAM,
        X.end_of_day(F.col("as_of_date")).alias("at"),
        F.struct("xg", "xga").alias("snapshot"),
    )


def pair_key(matches: DataFrame) -> DataFrame:
    return matches.withColumns(
        {
            "pair_lo": F.least("home_team_id", "away_team_id"),
            "pair_hi": F.greatest("home_team_id", "away_team_id"),
        }
    )


def meetings(played: DataFrame) -> DataFrame:
    """After each instant: totals of all meetings of a pair, in every competition and season."""
    hg, ag = F.col("home_goals"), F.col("away_goals")
    home_is_lo = F.col("home_team_id") == F.col("pair_lo")
    rows = pair_key(played).select(
        "pair_lo",
        "pair_hi",
        X.instant("kickoff").alias("at"),
        F.lit(1).cast("long").alias("meetings"),
        F.when(home_is_lo, hg > ag).otherwise(ag > hg).cast("long").alias("lo_wins"),
        F.when(home_is_lo, ag > hg).otherwise(hg > ag).cast("long").alias("hi_wins"),
        (hg == ag).cast("long").alias("drawn"),
        (hg + ag).cast("long").alias("goals"),
    )
    keys = ["pair_lo", "pair_hi"]
    return H.running_states(H.instant_totals(rows, keys, _MEETING), keys, _MEETING, "h2h")


# --- one team's columns ---------------------------------------------------------------------


def form_columns(side: str) -> dict[str, Column]:
    out = {}
    for n in RECENT:
        last, full = F.col("recent")[f"last_{n}"], F.col("recent")["seen"] >= n
        out[f"{side}_wins_last_{n}"] = F.when(full, last["wins"])
        out[f"{side}_draws_last_{n}"] = F.when(full, last["draws"])
        out[f"{side}_losses_last_{n}"] = F.when(full, F.lit(n) - last["wins"] - last["draws"])
        if n != 3:
            out[f"{side}_points_last_{n}"] = F.when(full, last["wins"] * 3 + last["draws"])
    return out


def goal_columns(side: str) -> dict[str, Column]:
    out = {}
    for n in (5, 10):
        last, full = F.col("recent")[f"last_{n}"], F.col("recent")["seen"] >= n
        for d in ("for", "against"):
            out[f"{side}_goals_{d}_last_{n}"] = F.when(full, last[f"goals_{d}"])
            out[f"{side}_goals_{d}_mean_last_{n}"] = F.when(full, last[f"goals_{d}"] / F.lit(float(n)))
    return out


def split_columns(side: str) -> dict[str, Column]:
    state = F.col(f"at_{side}")
    last, full = state["last_5"], state["seen"] >= 5
    return {
        f"{side}_{side}_points_last_5": F.when(full, last["wins"] * 3 + last["draws"]),
        f"{side}_{side}_goals_for_last_5": F.when(full, last["goals_for"]),
        f"{side}_{side}_goals_against_last_5": F.when(full, last["goals_against"]),
    }


def rest_columns(side: str) -> dict[str, Column]:
    gap = F.col("at") - F.col("recent")["last_at"]
    return {f"{side}_rest_days": F.floor(gap / F.lit(X.DAY_MICROS)).cast("long")}


def elo_columns(side: str) -> dict[str, Column]:
    return {f"{side}_elo_pre_match": F.coalesce(F.col("elo")["rating"], F.lit(ratings.BASE_RATING))}


def xg_columns(side: str) -> dict[str, Column]:
    snap = F.col("snapshot")
    return {
        f"{side}_xg_season_asof": snap["xg"].cast("double"),
        f"{side}_xga_season_asof": snap["xga"].cast("double"),
        f"_{side}_has_snapshot": snap.isNotNull(),
    }


def table_columns(side: str) -> dict[str, Column]:
    t = F.col("table")
    return {
        f"{side}_table_position": t["position"],
        f"{side}_points_table": t["points"],
        f"{side}_goal_difference_table": t["goal_difference"],
    }


_FAMILY = {
    "form": (form_columns, ("recent",)),
    "goals": (goal_columns, ("recent",)),
    "split": (split_columns, ("at_home", "at_away")),
    "rest": (rest_columns, ("recent",)),
    "elo": (elo_columns, ("elo",)),
    "xg": (xg_columns, ("snapshot",)),
    "table": (table_columns, ("table",)),
}
FAMILIES = (*_FAMILY, "h2h")


def team_states(
    played: DataFrame, targets: DataFrame, team_stats: DataFrame | None, kinds: set[str]
) -> DataFrame:
    """(league season, team, at) of every target side with the requested state structs."""
    wanted = H.probes(targets)
    makers = {
        ("recent",): lambda: recent(played),
        ("at_home", "at_away"): lambda: venue(played),
        ("elo",): lambda: ratings.rating_states(played),
        ("snapshot",): lambda: snapshots(team_stats),
    }
    states = [make() for names, make in makers.items() if kinds & set(names)]
    wanted_kinds = [n for names in makers for n in names if n in kinds]
    out = H.as_of(wanted, states, N.TEAM, wanted_kinds) if states else wanted
    if "table" in kinds:
        place = standings.positions(played, wanted).select(
            *N.TEAM, "at", F.struct("position", "points", "goal_difference").alias("table")
        )
        out = out.join(place, [*N.TEAM, "at"], "left")
    return out


# --- the part of a history that targets can read -------------------------------------------

LISTED = 200


def in_leagues(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of the targets' league seasons. A short list of leagues is also a filter that reaches the scan."""
    leagues = targets.select(*N.LEAGUE).distinct()
    listed = leagues.limit(LISTED + 1).collect()
    if len(listed) <= LISTED:
        for c in N.LEAGUE:
            rows = rows.where(F.col(c).isin(sorted({r[c] for r in listed if r[c] is not None})))
    return rows.join(leagues, N.LEAGUE, "left_semi")


def of_pairs(played: DataFrame, targets: DataFrame) -> DataFrame:
    """The matches of the pairs of teams that meet in a target."""
    keys = ["pair_lo", "pair_hi"]
    return pair_key(played).join(pair_key(targets).select(*keys).distinct(), keys, "left_semi").drop(*keys)


# --- assembly -------------------------------------------------------------------------------


def _side(states: DataFrame, side: str, families: list[str]) -> DataFrame:
    cols: dict[str, Column] = {}
    for f in families:
        cols.update(_FAMILY[f][0](side))
    if "form" in families or "rest" in families:
        cols[f"_{side}_seen"] = F.coalesce(F.col("recent")["seen"], F.lit(0))
    at = F.col("at")
    return states.select(
        *N.LEAGUE, F.col("team_id").alias(f"{side}_team_id"), at.alias("_at"), H.block_of(at).alias("_block"), *[c.alias(n) for n, c in cols.items()]
    )


def with_families(
    targets: DataFrame,
    played: DataFrame,
    team_stats: DataFrame | None = None,
    families: tuple[str, ...] = FAMILIES,
    meetings_of: DataFrame | None = None,
) -> DataFrame:
    """``targets`` (match rows) plus the columns of the requested families; meetings may come from a history of their own.

    Meetings come first, while the rows are narrow. Both sides of a match share its league season and instant, so the rows are
    then dealt once by (league season, block of days): inside ``co_partitioned`` neither team join shuffles them again.
    """
    team_families = [f for f in families if f in _FAMILY]
    out = targets.withColumn("_at", X.instant("kickoff"))
    if "h2h" in families:
        out = _with_h2h(out, targets, played if meetings_of is None else meetings_of)
    if team_families:
        slot = [*N.LEAGUE, "_block"]
        out = out.withColumn("_block", H.block_of(F.col("_at"))).repartition(*slot)
        kinds = {k for f in team_families for k in _FAMILY[f][1]}
        # Written once: both sides of a match read it, and it is far smaller than the matches.
        states = materialise(team_states(played, targets, team_stats, kinds), "team-states")
        for side in N.SIDES:
            out = out.join(_side(states, side, team_families).repartition(*slot), [*slot, f"{side}_team_id", "_at"], "left")
        out = out.drop("_block")
        if "elo" in families:
            out = out.withColumn("elo_difference", F.col("home_elo_pre_match") - F.col("away_elo_pre_match"))
        if "table" in families:
            out = out.withColumns(
                {
                    "table_points_difference": F.col("home_points_table") - F.col("away_points_table"),
                    "table_goal_difference_difference": F.col("home_goal_difference_table")
                    - F.col("away_goal_difference_table"),
                }
            )
    return out.drop("_at")


def _with_h2h(out: DataFrame, targets: DataFrame, played: DataFrame) -> DataFrame:
    keys = ["pair_lo", "pair_hi"]
    wanted = pair_key(targets).select(*keys, X.instant("kickoff").alias("at")).distinct()
    state = H.as_of(wanted, [meetings(played)], keys, ["h2h"]).withColumnRenamed("at", "_at")
    out = pair_key(out).join(state, [*keys, "_at"], "left")
    h = F.col("h2h")
    size = F.coalesce(h["meetings"], F.lit(0))
    enough = size >= MIN_MEETINGS
    home_is_lo = F.col("home_team_id") == F.col("pair_lo")
    return out.withColumns(
        {
            "h2h_home_wins": F.when(enough, F.when(home_is_lo, h["lo_wins"]).otherwise(h["hi_wins"])),
            "h2h_away_wins": F.when(enough, F.when(home_is_lo, h["hi_wins"]).otherwise(h["lo_wins"])),
            "h2h_draws": F.when(enough, h["drawn"]),
            "h2h_total_goals_mean": F.when(enough, h["goals"] / size),
            "h2h_sample_size": size,
        }
    ).drop("h2h", *keys)


def target_columns() -> dict[str, Column]:
    hg, ag = F.col("home_goals"), F.col("away_goals")
    return {
        "home_win": (hg > ag).cast("int"),
        "draw": (hg == ag).cast("int"),
        "away_win": (hg < ag).cast("int"),
    }


def missing_report() -> Column:
    """Why features are missing, as a map; a family reports under one representative key."""
    entries: dict[str, Column] = {}
    for s in N.SIDES:
        for n in RECENT:
            entries[f"{s}_wins_last_{n}"] = _short(f"{s}_wins_last_{n}", n, "finished")
        for n in (5, 10):
            for c in (f"{s}_points_last_{n}", *[f"{s}_goals_{d}{m}_last_{n}" for d in ("for", "against") for m in ("", "_mean")]):
                entries[c] = _short(c, n, "finished")
        for what in ("points", "goals_for", "goals_against"):
            c = f"{s}_{s}_{what}_last_5"
            entries[c] = _short(c, 5, s)
        entries[f"{s}_table_position"] = F.when(
            F.col(f"{s}_table_position").isNull(), f"{s} team has no finished match before kickoff"
        )
        entries[f"{s}_rest_days"] = F.when(F.col(f"{s}_rest_days").isNull(), "no earlier match in this season")
        has = F.coalesce(F.col(f"_{s}_has_snapshot"), F.lit(False))
        entries[f"{s}_xg_season_asof"] = F.when(~has, "no snapshot before the kickoff date").when(
            F.col(f"{s}_xg_season_asof").isNull(), "latest snapshot has no xg"
        )
        entries[f"{s}_xga_season_asof"] = F.when(
            has & F.col(f"{s}_xga_season_asof").isNull(), "latest snapshot has no xga"
        )
    entries["h2h_home_wins"] = F.when(F.col("h2h_sample_size") < MIN_MEETINGS, f"fewer than {MIN_MEETINGS} earlier meetings")
    entries["table_points_difference"] = F.when(
        F.col("table_points_difference").isNull(), "a side has no finished match before kickoff"
    )
    pairs = F.create_map(*[x for name, why in entries.items() for x in (F.lit(name), why)])
    return F.map_filter(pairs, lambda _k, v: v.isNotNull())


def _short(name: str, n: int, what: str) -> Column:
    return F.when(F.col(name).isNull(), f"fewer than {n} {what} matches before kickoff")


def build_examples(
    targets: DataFrame, played: DataFrame, team_stats: DataFrame, with_report: bool = False, meetings_of: DataFrame | None = None
) -> DataFrame:
    """One row per target: identity, 66 features, 5 outcome targets."""
    rows = with_families(targets, played, team_stats, meetings_of=meetings_of).withColumns(target_columns())
    cols = [F.col(c) for c in N.IDENTITY]
    cols += [F.col(c).cast("double" if c in N.DOUBLE_FEATURES else "long").alias(c) for c in N.FEATURES]
    cols += [F.col(c).cast("int").alias(c) for c in N.TARGETS]
    if with_report:
        cols.append(missing_report().alias("missing_report"))
    return rows.select(*cols)
