"""Landed provider payloads (JSON text, one page per row) to typed staging rows.

Pages arrive as a DataFrame with a ``body`` column. Leaves are read as text and cast with ``try_cast``, so
one bad value never fails a job: a row that misses a required value goes to the rejects with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import scalars as X

_MATCH = """struct<
  fixture: struct<id: string, date: string, status: struct<short: string>, venue: struct<name: string>>,
  league: struct<id: string, season: string, round: string>,
  teams: struct<home: struct<id: string>, away: struct<id: string>>,
  goals: struct<home: string, away: string>>"""
_EVENT = """struct<id: string, league_id: string, season_id: string, season_year: string, event_date: string,
  kickoff_time: string, date: string, status: string, home_score: string, away_score: string,
  home_team_id: string, away_team_id: string, round_number: string, round_name: string>"""
_LEAGUE = """struct<league: struct<id: string, name: string, type: string, logo: string>,
  country: struct<name: string>,
  seasons: array<struct<year: string, start: string, end: string, current: boolean>>>"""
_TEAM = """struct<team: struct<id: string, name: string, code: string, country: string, founded: string,
  logo: string>, venue: struct<name: string>>"""
_TEAM_STATS = """struct<
  fixtures: struct<played: struct<total: string>, wins: struct<total: string>, draws: struct<total: string>,
    loses: struct<total: string>>,
  goals: struct<for: struct<total: string>, against: struct<total: string>>,
  clean_sheet: map<string, string>, failed_to_score: map<string, string>, shots: map<string, string>,
  form: string, xg: string, xga: string>"""
_PLAYER = """struct<id: string, name: string, photo: string, nationality: string, birth: struct<date: string>,
  height: string, weight: string, position: string,
  statistics: array<struct<team: struct<id: string>, league: struct<id: string>,
    games: struct<appearences: string, appearances: string, lineups: string, minutes: string, rating: string>,
    goals: struct<total: string>, assists: string, cards: struct<yellow: string, red: string>>>>"""
_INJURY = """struct<id: string, player: struct<id: string>, team: struct<id: string>, league: struct<id: string>,
  fixture: struct<id: string>, type: string, reason: string, status: string, date: string, updated_at: string>"""
_SLOT = """struct<player: struct<id: string>, pos: string, position: string, posX: string, posY: string,
  number: string>"""
_LINEUP = f"""struct<team: struct<id: string>, coach: struct<name: string>, formation: string, updated_at: string,
  startXI: struct<players: array<{_SLOT}>>, substitutes: struct<players: array<{_SLOT}>>>"""


def _entries(pages: DataFrame, item: str, field: str = "response", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per list entry of every page body, with its place in the landing order.

    Pages are ordered by their ``page`` column, or as they are read when there is none. A plain explode would be given a
    filter on the parsed list, for which every page is parsed again; the outer one is not, and pages without entries
    are dropped after it.
    """
    parsed = F.from_json("body", f"struct<{field}: array<{item}>>")[field]
    page = F.col("page").cast("long") if "page" in pages.columns else F.monotonically_increasing_id()
    listed = pages.select(*keep, page.alias("_page"), parsed.alias("_items"))
    found = listed.select(*keep, "_page", F.posexplode_outer("_items").alias("_pos", "e")).where(F.col("_pos").isNotNull())
    return found.select(*keep, F.struct(F.col("_page").alias("page"), F.col("_pos").alias("pos")).alias("landing"), "e")


def _reason(required: dict[str, Column]) -> Column:
    """Name of the first required value that is missing, else NULL."""
    out = F.lit(None).cast("string")
    for name, value in reversed(required.items()):
        out = F.when(value.isNull(), F.lit(f"missing {name}")).otherwise(out)
    return out


def split_rejects(staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows) of a staged DataFrame."""
    return staged.where(F.col("reject").isNull()).drop("reject"), staged.where(F.col("reject").isNotNull())


def _paired(a: Column, b: Column) -> list[Column]:
    both = a.isNotNull() & b.isNotNull()
    return [F.when(both, a), F.when(both, b)]


def _finish_matches(df: DataFrame) -> DataFrame:
    goals = _paired(X.to_long(F.col("_hg")), X.to_long(F.col("_ag")))
    required = {c: F.col(c) for c in (
        "external_id", "competition_external_id", "season_year", "home_team_external_id", "away_team_external_id", "kickoff_time"
    )}
    bad_goals = (F.col("_hg").isNotNull() & X.to_long(F.col("_hg")).isNull()) | (
        F.col("_ag").isNotNull() & X.to_long(F.col("_ag")).isNull()
    )
    return df.withColumns(
        {
            "home_goals": goals[0],
            "away_goals": goals[1],
            "finished_at": F.when(F.col("status") == "finished", F.col("kickoff_time")),
            "reject": F.coalesce(_reason(required), F.when(bad_goals, "goals are not numbers")),
        }
    ).drop("_hg", "_ag")


def matches_a(pages: DataFrame) -> DataFrame:
    """Match payload, first format."""
    e = F.col("e")
    fx, lg = e["fixture"], e["league"]
    season = F.nullif(X.to_long(lg["season"]), F.lit(0))
    short = fx["status"]["short"]
    rows = _entries(pages, _MATCH).select(
        "landing",
        X.to_long(fx["id"]).alias("external_id"),
        X.to_long(lg["id"]).alias("competition_external_id"),
        season.alias("season_external_id"),
        season.alias("season_year"),
        X.to_long(e["teams"]["home"]["id"]).alias("home_team_external_id"),
        X.to_long(e["teams"]["away"]["id"]).alias("away_team_external_id"),
        X.iso_timestamp(fx["date"]).alias("kickoff_time"),
        X.matchday(lg["round"]).alias("matchday"),
        F.nullif(lg["round"], F.lit("")).alias("round"),
        fx["venue"]["name"].alias("venue"),
        F.coalesce(F.try_element_at(X.code_map(N.STATUS_FORMAT_A), F.coalesce(short, F.lit("NS"))), F.lit("scheduled")).alias("status"),
        short.alias("status_short"),
        e["goals"]["home"].alias("_hg"),
        e["goals"]["away"].alias("_ag"),
    )
    return _finish_matches(rows)


def matches_b(pages: DataFrame, statuses: tuple[str, ...] = ()) -> DataFrame:
    """Match payload, second format, optionally only the given mapped statuses."""
    e = F.col("e")
    kickoff = X.iso_timestamp(
        F.coalesce(*[F.nullif(e[c], F.lit("")) for c in ("event_date", "kickoff_time", "date")])
    )
    raw = F.coalesce(F.nullif(e["status"], F.lit("")), F.lit("scheduled"))
    zero = F.lit(0).cast("long")
    rows = _entries(pages, _EVENT, "results").select(
        "landing",
        X.to_long(e["id"]).alias("external_id"),
        F.coalesce(X.to_long(e["league_id"]), zero).alias("competition_external_id"),
        F.coalesce(X.to_long(e["season_id"]), zero).alias("season_external_id"),
        F.coalesce(X.to_long(e["season_year"]), F.year(kickoff).cast("long")).alias("season_year"),
        F.coalesce(X.to_long(e["home_team_id"]), zero).alias("home_team_external_id"),
        F.coalesce(X.to_long(e["away_team_id"]), zero).alias("away_team_external_id"),
        kickoff.alias("kickoff_time"),
        e["round_number"].try_cast("int").alias("matchday"),
        e["round_name"].alias("round"),
        F.lit(None).cast("string").alias("venue"),
        F.coalesce(F.try_element_at(X.code_map(N.STATUS_FORMAT_B), F.lower(raw)), F.lit("scheduled")).alias("status"),
        raw.alias("status_short"),
        e["home_score"].alias("_hg"),
        e["away_score"].alias("_ag"),
    )
    out = _finish_matches(rows)
    return out.where(F.col("status").isin(*statuses)) if statuses else out


def in_window(staged: DataFrame, league: int, season: int, first: str, last: str) -> DataFrame:
    """Matches of one league season whose UTC date lies in the closed window."""
    day = F.to_date("kickoff_time")
    return staged.where(
        (F.col("competition_external_id") == league)
        & (F.col("season_year") == season)
        & day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    )


def competitions(pages: DataFrame) -> DataFrame:
    lg = F.col("e")["league"]
    kind = F.lower(F.coalesce(F.nullif(lg["type"], F.lit("")), F.lit("league")))
    rows = _entries(pages, _LEAGUE).select(
        "landing",
        X.to_long(lg["id"]).alias("external_id"),
        F.coalesce(lg["name"], F.lit("")).alias("name"),
        F.when(kind.isin(*N.COMPETITION_TYPES), kind).otherwise("league").alias("type"),
        F.col("e")["country"]["name"].alias("country"),
        lg["logo"].alias("logo"),
    )
    return rows.withColumn("reject", _reason({"external_id": F.col("external_id")}))


def seasons(pages: DataFrame) -> DataFrame:
    rows = _entries(pages, _LEAGUE).select(
        "landing", X.to_long(F.col("e")["league"]["id"]).alias("competition_external_id"), F.explode(F.col("e")["seasons"]).alias("s")
    )
    year = X.to_long(F.col("s")["year"])
    return rows.select(
        "landing",
        "competition_external_id",
        year.alias("external_id"),
        year.alias("year"),
        X.iso_date(F.col("s")["start"]).alias("start_date"),
        X.iso_date(F.col("s")["end"]).alias("end_date"),
        F.coalesce(F.col("s")["current"], F.lit(False)).alias("is_current"),
    ).withColumn("reject", _reason({c: F.col(c) for c in ("competition_external_id", "year")}))


def teams(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    t = F.col("e")["team"]
    return _entries(pages, _TEAM, keep=keep).select(
        "landing",
        *keep,
        X.to_long(t["id"]).alias("external_id"),
        F.coalesce(t["name"], F.lit("")).alias("name"),
        t["code"].alias("short_name"),
        t["code"].alias("code"),
        t["country"].alias("country"),
        t["logo"].alias("logo"),
        F.col("e")["venue"]["name"].alias("venue"),
        X.year_prefix(t["founded"]).alias("founded"),
    ).withColumn("reject", _reason({"external_id": F.col("external_id")}))


def first_integer(values: Column) -> Column:
    """The ``total`` entry when it is an integer, else the first all-digit value of the map."""
    digits = F.filter(F.map_values(values), lambda v: v.rlike(r"^-?\d+$"))
    return F.coalesce(F.try_element_at(values, F.lit("total")).try_cast("long"), F.get(digits, F.lit(0)).try_cast("long"))


def team_statistics(pages: DataFrame) -> DataFrame:
    """Season totals of one team per page; the request's keys and stamp date come with the page."""
    keys = ["team_external_id", "competition_external_id", "season_external_id", "as_of_date"]
    r = F.col("r")

    def total(value: Column) -> Column:
        return F.coalesce(X.to_long(value), F.lit(0).cast("long"))

    zero = F.lit(0).cast("long")
    body = F.from_json("body", f"struct<response: {_TEAM_STATS}>")["response"]
    rows = pages.select(*keys, body.alias("r")).select(*keys, F.explode(F.array("r")).alias("r"))  # the filter stays above the parsing
    return rows.where(r.isNotNull()).select(
        *keys,
        total(r["fixtures"]["played"]["total"]).alias("fixtures_played"),
        total(r["fixtures"]["wins"]["total"]).alias("wins"),
        total(r["fixtures"]["draws"]["total"]).alias("draws"),
        total(r["fixtures"]["loses"]["total"]).alias("losses"),
        total(r["goals"]["for"]["total"]).alias("goals_for"),
        total(r["goals"]["against"]["total"]).alias("goals_against"),
        F.coalesce(first_integer(r["clean_sheet"]), zero).alias("clean_sheets"),
        F.coalesce(first_integer(r["failed_to_score"]), zero).alias("failed_to_score"),
        F.nullif(r["form"], F.lit("")).alias("form"),
        first_integer(r["shots"]).alias("shots_total"),
        X.to_double(r["xg"]).alias("xg"),
        X.to_double(r["xga"]).alias("xga"),
    )


def players(pages: DataFrame) -> DataFrame:
    e = F.col("e")
    return _entries(pages, _PLAYER).select(
        "landing",
        X.to_long(e["id"]).alias("external_id"),
        F.coalesce(e["name"], F.lit("")).alias("name"),
        e["photo"].alias("photo"),
        e["nationality"].alias("nationality"),
        X.iso_date(e["birth"]["date"]).alias("birth_date"),
        X.leading_int(e["height"]).alias("height_cm"),
        X.leading_int(e["weight"]).alias("weight_kg"),
        F.try_element_at(X.code_map(N.POSITIONS), F.coalesce(F.nullif(e["position"], F.lit("")), F.lit("MF"))).alias("position"),
    ).withColumn("reject", _reason({"external_id": F.col("external_id")}))


def player_statistics(pages: DataFrame) -> DataFrame:
    """The first statistics entry of the requested league; a page without one gives no row."""
    keys = ["player_external_id", "competition_external_id", "season_external_id"]
    body = F.from_json("body", f"struct<response: array<{_PLAYER}>>")["response"]
    want = F.col("competition_external_id")
    rows = pages.select(*keys, F.get(body, F.lit(0))["statistics"].alias("stats")).withColumn(
        "s",
        F.get(
            F.filter(
                "stats", lambda s: s["league"]["id"].isNull() | F.coalesce(X.to_long(s["league"]["id"]) == want, F.lit(False))
            ),
            F.lit(0),
        ),
    )
    s = F.col("s")

    def number(value: Column) -> Column:
        return F.coalesce(X.to_long(value), F.lit(0).cast("long"))

    games = s["games"]
    return rows.where(s.isNotNull()).select(
        *keys,
        number(s["team"]["id"]).alias("team_external_id"),
        number(F.coalesce(games["appearences"], games["appearances"])).alias("appearances"),
        number(games["lineups"]).alias("starts"),
        number(games["minutes"]).alias("minutes_played"),
        number(s["goals"]["total"]).alias("goals"),
        number(s["assists"]).alias("assists"),
        number(s["cards"]["yellow"]).alias("yellow_cards"),
        number(s["cards"]["red"]).alias("red_cards"),
        X.to_double(games["rating"]).alias("rating"),
    )


def injuries(pages: DataFrame) -> DataFrame:
    e = F.col("e")
    status = F.lower(F.coalesce(F.nullif(e["status"], F.lit("")), F.lit("active")))
    rows = _entries(pages, _INJURY).select(
        "landing",
        X.to_long(e["id"]).alias("external_id"),
        X.to_long(e["player"]["id"]).alias("player_external_id"),
        X.to_long(e["team"]["id"]).alias("team_external_id"),
        X.to_long(e["league"]["id"]).alias("competition_external_id"),
        X.to_long(e["fixture"]["id"]).alias("fixture_external_id"),
        e["type"].alias("type"),
        e["reason"].alias("reason"),
        F.when(status.isin(*N.INJURY_STATUSES), status).otherwise("active").alias("status"),
        F.coalesce(X.iso_date(e["date"]), F.lit("1970-01-01").cast("date")).alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
        X.iso_timestamp(e["updated_at"]).alias("updated_external_at"),
    )
    return rows.withColumn(
        "reject", _reason({c: F.col(c) for c in ("external_id", "player_external_id", "team_external_id")})
    )


def lineups(pages: DataFrame) -> DataFrame:
    """One row per (match, team) with its player slots, starters first, in listed order."""
    e = F.col("e")

    def slots(listed: Column, starter: bool) -> Column:
        def one(s: Column) -> Column:
            pos = F.coalesce(F.nullif(s["pos"], F.lit("")), F.nullif(s["position"], F.lit("")), F.lit("MF"))
            return F.struct(
                F.coalesce(X.to_long(s["player"]["id"]), F.lit(0).cast("long")).alias("player_external_id"),
                F.try_element_at(X.code_map(N.POSITIONS), pos).alias("position"),
                s["posX"].try_cast("int").alias("position_x"),
                s["posY"].try_cast("int").alias("position_y"),
                s["number"].try_cast("int").alias("shirt_number"),
                F.lit(starter).alias("is_starter"),
            )

        empty = F.from_json(F.lit("[]"), f"array<{_SLOT}>")
        return F.transform(F.coalesce(listed, empty), one)

    return _entries(pages, _LINEUP, keep=("fixture_external_id",)).select(
        "landing",
        "fixture_external_id",
        X.to_long(e["team"]["id"]).alias("team_external_id"),
        e["formation"].alias("formation"),
        e["coach"]["name"].alias("coach"),
        X.iso_timestamp(e["updated_at"]).alias("updated_external_at"),
        F.concat(slots(e["startXI"]["players"], True), slots(e["substitutes"]["players"], False)).alias("players"),
    ).withColumn("reject", _reason({"team_external_id": F.col("team_external_id")}))
