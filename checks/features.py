"""Feature families: last-n windows, splits, rest, meetings, tables, ratings, snapshots, assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import FIN, LONG, MATCHES, TEAM_STATS, query, with_sql
from touchline.functions import names as N
from touchline.functions import scalars as X
from touchline.operators import features as Fe
from touchline.operators import history as H
from touchline.operators import ratings as R
from touchline.operators import standings as S
from touchline.sources import tables as T


def played(spark, folder):
    return H.finished(T.matches(spark, folder))


def family(*names):
    return lambda spark, folder: Fe.with_families(
        played(spark, folder), played(spark, folder), T.team_stats(spark, folder) if "xg" in names else None, names
    )


_LAST = [
    f"sum(CASE WHEN rn <= {n} AND outcome = '{o}' THEN 1 ELSE 0 END) AS {w}_{n}"
    for n in (3, 5, 10)
    for o, w in (("W", "wins"), ("D", "draws"), ("L", "losses"))
] + [
    f"sum(CASE WHEN rn <= {n} THEN {c} ELSE 0 END) AS {a}_{n}"
    for n in (5, 10)
    for c, a in (("points", "points"), ("gf", "goals_for"), ("ga", "goals_against"))
]
HIST = f"""
hist AS (
  SELECT p.fixture_id, p.is_home AS side, h.outcome, h.points, h.gf, h.ga, h.kickoff, h.is_home,
         row_number() OVER (PARTITION BY p.fixture_id, p.is_home ORDER BY h.kickoff DESC, h.fixture_id) AS rn,
         row_number() OVER (PARTITION BY p.fixture_id, p.is_home, h.is_home ORDER BY h.kickoff DESC, h.fixture_id) AS vn
  FROM long p JOIN long h ON h.competition_id = p.competition_id AND h.season_id = p.season_id
       AND h.team_id = p.team_id AND h.kickoff < p.kickoff),
agg AS (
  SELECT fixture_id, side, count(*) AS n, max(kickoff) AS last_at,
         sum(CASE WHEN is_home = side THEN 1 ELSE 0 END) AS vn,
         sum(CASE WHEN is_home = side AND vn <= 5 THEN points ELSE 0 END) AS v_points,
         sum(CASE WHEN is_home = side AND vn <= 5 THEN gf ELSE 0 END) AS v_gf,
         sum(CASE WHEN is_home = side AND vn <= 5 THEN ga ELSE 0 END) AS v_ga,
         {", ".join(_LAST)}
  FROM hist GROUP BY fixture_id, side)"""
SIDES_JOIN = "LEFT JOIN agg h ON h.fixture_id = f.fixture_id AND h.side LEFT JOIN agg a ON a.fixture_id = f.fixture_id AND NOT a.side"


def _form_sql() -> list[str]:
    out = []
    for s, t in (("home", "h"), ("away", "a")):
        for n in (3, 5, 10):
            out += [f"CASE WHEN {t}.n >= {n} THEN {t}.{w}_{n} END AS {s}_{w}_last_{n}" for w in ("wins", "draws", "losses")]
        out += [f"CASE WHEN {t}.n >= {n} THEN {t}.points_{n} END AS {s}_points_last_{n}" for n in (5, 10)]
    return out


def _goals_sql() -> list[str]:
    out = []
    for s, t in (("home", "h"), ("away", "a")):
        for n in (5, 10):
            for d in ("for", "against"):
                out.append(f"CASE WHEN {t}.n >= {n} THEN {t}.goals_{d}_{n} END AS {s}_goals_{d}_last_{n}")
                out.append(f"CASE WHEN {t}.n >= {n} THEN CAST({t}.goals_{d}_{n} AS DOUBLE) / {n} END AS {s}_goals_{d}_mean_last_{n}")
    return out


def _split_sql() -> list[str]:
    return [
        f"CASE WHEN {t}.vn >= 5 THEN {t}.v_{c} END AS {s}_{s}_{a}_last_5"
        for s, t in (("home", "h"), ("away", "a"))
        for c, a in (("points", "points"), ("gf", "goals_for"), ("ga", "goals_against"))
    ]


REST_SQL = [
    f"CAST(floor((epoch(f.kickoff) - epoch({t}.last_at)) / 86400) AS BIGINT) AS {s}_rest_days"
    for s, t in (("home", "h"), ("away", "a"))
]


def _typed(names) -> str:
    ints = [c for c in names if c not in N.DOUBLE_FEATURES]
    dbls = [c for c in names if c in N.DOUBLE_FEATURES]
    return " ".join(p for p in ("i:fixture_id" + "".join("," + c for c in ints), "d:" + ",".join(dbls) if dbls else "") if p)


def _side_query(name, families, cols, select):
    query(name, _typed(cols), with_sql(MATCHES, FIN, LONG, HIST, answer=f"SELECT f.fixture_id, {', '.join(select)} FROM fin f {SIDES_JOIN}"))(
        family(*families)
    )


_side_query("w3a_form_last_3_5_10", ("form",), N.FORM, _form_sql())
_side_query("w3b_goals_last_5_10", ("goals",), N.GOALS, _goals_sql())
_side_query("w3c_home_away_split", ("split",), N.SPLIT, _split_sql())
_side_query("w3d_rest_days", ("rest",), N.REST, REST_SQL)


@query(
    "w1_rolling_sum_last_5",
    "i:fixture_id,team_id,points_last_5,goals_last_5",
    with_sql(
        MATCHES, FIN, LONG, HIST,
        answer="""SELECT l.fixture_id, l.team_id, CASE WHEN a.n >= 5 THEN a.points_5 END AS points_last_5,
        CASE WHEN a.n >= 5 THEN a.goals_for_5 END AS goals_last_5
        FROM long l LEFT JOIN agg a ON a.fixture_id = l.fixture_id AND a.side = l.is_home""",
    ),
)
def rolling_sum(spark, folder):
    """Sum over the last five earlier matches of every team-match, NULL while the window is short."""
    p = played(spark, folder)
    long = H.team_matches(p)
    states = H.recent_states(long, N.TEAM, (5,), ["points", "goals_for"], "s")
    looked = H.as_of(H.probes(p), [states], N.TEAM, ["s"])
    full = F.col("s")["seen"] >= 5
    return long.join(looked, [*N.TEAM, "at"], "left").select(
        "fixture_id",
        "team_id",
        F.when(full, F.col("s")["last_5"]["points"]).alias("points_last_5"),
        F.when(full, F.col("s")["last_5"]["goals_for"]).alias("goals_last_5"),
    )


@query(
    "w2_rolling_mean_count_rate",
    "i:fixture_id,team_id,wins_partial,window_size d:mean_goals,win_rate",
    with_sql(
        MATCHES, FIN, LONG, HIST,
        answer="""SELECT l.fixture_id, l.team_id, coalesce(a.wins_5, 0) AS wins_partial,
        least(coalesce(a.n, 0), 5) AS window_size,
        CASE WHEN a.n >= 5 THEN CAST(a.goals_for_5 AS DOUBLE) / 5 END AS mean_goals,
        CASE WHEN a.n >= 5 THEN CAST(a.wins_5 AS DOUBLE) / 5 END AS win_rate
        FROM long l LEFT JOIN agg a ON a.fixture_id = l.fixture_id AND a.side = l.is_home""",
    ),
)
def rolling_mean_count_rate(spark, folder):
    """Mean and rate need a full window; the count and the window size accept a partial one."""
    p = played(spark, folder)
    long = H.team_matches(p).withColumn("wins", (F.col("outcome") == "W").cast("long"))
    looked = H.as_of(H.probes(p), [H.recent_states(long, N.TEAM, (5,), ["wins", "goals_for"], "s")], N.TEAM, ["s"])
    s, full = F.col("s"), F.col("s")["seen"] >= 5
    return long.join(looked, [*N.TEAM, "at"], "left").select(
        "fixture_id",
        "team_id",
        F.coalesce(s["last_5"]["wins"], F.lit(0)).alias("wins_partial"),
        F.least(F.coalesce(s["seen"], F.lit(0)), F.lit(5)).alias("window_size"),
        F.when(full, s["last_5"]["goals_for"] / 5.0).alias("mean_goals"),
        F.when(full, s["last_5"]["wins"] / 5.0).alias("win_rate"),
    )


H2H_CTE = """
met AS (
  SELECT f.fixture_id, count(h.fixture_id) AS n,
         sum(CASE WHEN (h.home_team_id = f.home_team_id AND h.home_goals > h.away_goals)
                    OR (h.away_team_id = f.home_team_id AND h.away_goals > h.home_goals) THEN 1 ELSE 0 END) AS hw,
         sum(CASE WHEN (h.home_team_id = f.away_team_id AND h.home_goals > h.away_goals)
                    OR (h.away_team_id = f.away_team_id AND h.away_goals > h.home_goals) THEN 1 ELSE 0 END) AS aw,
         sum(CASE WHEN h.home_goals = h.away_goals THEN 1 ELSE 0 END) AS d,
         sum(h.home_goals + h.away_goals) AS goals
  FROM fin f LEFT JOIN fin h ON least(h.home_team_id, h.away_team_id) = least(f.home_team_id, f.away_team_id)
       AND greatest(h.home_team_id, h.away_team_id) = greatest(f.home_team_id, f.away_team_id) AND h.kickoff < f.kickoff
  GROUP BY f.fixture_id)"""
H2H_SQL = [
    "CASE WHEN m.n >= 3 THEN m.hw END AS h2h_home_wins",
    "CASE WHEN m.n >= 3 THEN m.aw END AS h2h_away_wins",
    "CASE WHEN m.n >= 3 THEN m.d END AS h2h_draws",
    "CASE WHEN m.n >= 3 THEN CAST(m.goals AS DOUBLE) / m.n END AS h2h_total_goals_mean",
    "m.n AS h2h_sample_size",
]
query("w4_head_to_head", _typed(N.H2H), with_sql(MATCHES, FIN, H2H_CTE, answer=f"SELECT f.fixture_id, {', '.join(H2H_SQL)} FROM fin f JOIN met m USING (fixture_id)"))(
    family("h2h")
)

TABLE_CTE = """
tot AS (
  SELECT f.fixture_id, l.team_id, sum(l.points) AS points, sum(l.gf) AS gf, sum(l.gf) - sum(l.ga) AS gd
  FROM fin f JOIN long l ON l.competition_id = f.competition_id AND l.season_id = f.season_id AND l.kickoff < f.kickoff
  GROUP BY f.fixture_id, l.team_id),
tab AS (
  SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY points DESC, gd DESC, gf DESC, team_id) AS pos FROM tot)"""
TABLE_SQL = [
    "th.pos AS home_table_position",
    "ta.pos AS away_table_position",
    "th.points AS home_points_table",
    "ta.points AS away_points_table",
    "th.gd AS home_goal_difference_table",
    "ta.gd AS away_goal_difference_table",
    "th.points - ta.points AS table_points_difference",
    "th.gd - ta.gd AS table_goal_difference_difference",
]
TABLE_JOIN = (
    "LEFT JOIN tab th ON th.fixture_id = f.fixture_id AND th.team_id = f.home_team_id "
    "LEFT JOIN tab ta ON ta.fixture_id = f.fixture_id AND ta.team_id = f.away_team_id"
)
query("w5_table_position_before_kickoff", _typed(N.TABLE), with_sql(MATCHES, FIN, LONG, TABLE_CTE, answer=f"SELECT f.fixture_id, {', '.join(TABLE_SQL)} FROM fin f {TABLE_JOIN}"))(
    family("table")
)

ELO_CTE = """
num AS (
  SELECT *, row_number() OVER (PARTITION BY competition_id, season_id ORDER BY kickoff, fixture_id) AS rn,
         row_number() OVER (PARTITION BY competition_id, season_id ORDER BY kickoff, fixture_id)
           - row_number() OVER (PARTITION BY competition_id, season_id, kickoff ORDER BY fixture_id) AS before_rn
  FROM fin),
rec AS (
  SELECT DISTINCT competition_id, season_id, CAST(0 AS BIGINT) AS rn,
         list_transform(range(20), lambda i: CAST(1500.0 AS DOUBLE)) AS r FROM fin
  UNION ALL
  SELECT s.competition_id, s.season_id, s.rn,
         list_transform(range(1, 21), lambda i: CASE
           WHEN i = s.hi THEN s.r[i] + 20 * (s.sc - s.ex)
           WHEN i = s.ai THEN s.r[i] + 20 * ((1 - s.sc) - (1 - s.ex)) ELSE s.r[i] END)
  FROM (SELECT n.competition_id, n.season_id, n.rn, rec.r, n.home_team_id % 100 + 1 AS hi, n.away_team_id % 100 + 1 AS ai,
               CASE WHEN n.home_goals > n.away_goals THEN 1.0 WHEN n.home_goals < n.away_goals THEN 0.0 ELSE 0.5 END AS sc,
               1.0 / (1.0 + pow(10.0, (rec.r[n.away_team_id % 100 + 1] - (rec.r[n.home_team_id % 100 + 1] + 65.0)) / 400.0)) AS ex
        FROM rec JOIN num n ON n.competition_id = rec.competition_id AND n.season_id = rec.season_id AND n.rn = rec.rn + 1) s),
elo AS (
  SELECT n.fixture_id, rec.r[n.home_team_id % 100 + 1] AS eh, rec.r[n.away_team_id % 100 + 1] AS ea
  FROM num n JOIN rec ON rec.competition_id = n.competition_id AND rec.season_id = n.season_id AND rec.rn = n.before_rn)"""
ELO_SQL = ["e.eh AS home_elo_pre_match", "e.ea AS away_elo_pre_match", "e.eh - e.ea AS elo_difference"]
query("w6_elo_pre_match", _typed(N.ELO), with_sql(MATCHES, FIN, ELO_CTE, recursive=True, answer=f"SELECT e.fixture_id, {', '.join(ELO_SQL)} FROM elo e"))(
    family("elo")
)

XG_CTE = """
snap AS (
  SELECT l.fixture_id, l.is_home, t.as_of_date, t.xg, t.xga
  FROM (SELECT *, CAST(kickoff AS DATE) AS day FROM long) l ASOF LEFT JOIN team_stats t
    ON t.team_id = l.team_id AND t.competition_id = l.competition_id AND t.season_id = l.season_id AND l.day > t.as_of_date)"""
XG_SQL = [f"{t}.{x} AS {s}_{x}_season_asof" for s, t in (("home", "sh"), ("away", "sa")) for x in ("xg", "xga")]
XG_JOIN = "JOIN snap sh ON sh.fixture_id = f.fixture_id AND sh.is_home JOIN snap sa ON sa.fixture_id = f.fixture_id AND NOT sa.is_home"
XG_WHY = [
    f"CASE WHEN {t}.as_of_date IS NULL THEN 'no snapshot' WHEN {t}.xg IS NULL THEN 'no xg' ELSE 'present' END AS {s}_xg_state"
    for s, t in (("home", "sh"), ("away", "sa"))
]


@query(
    "j7_strict_snapshot_as_of",
    _typed(N.XG) + " s:home_xg_state,away_xg_state",
    with_sql(MATCHES, FIN, LONG, TEAM_STATS, XG_CTE, answer=f"SELECT f.fixture_id, {', '.join(XG_SQL + XG_WHY)} FROM fin f {XG_JOIN}"),
)
def strict_snapshot(spark, folder):
    """Latest statistics snapshot before the kickoff date; no snapshot and no value stay apart."""
    df = family("xg")(spark, folder)
    for s in N.SIDES:
        state = F.when(F.coalesce(F.col(f"_{s}_has_snapshot"), F.lit(False)), F.when(F.col(f"{s}_xg_season_asof").isNull(), "no xg").otherwise("present"))
        df = df.withColumn(f"{s}_xg_state", state.otherwise("no snapshot"))
    return df


ALL_SQL = _form_sql() + _goals_sql() + _split_sql() + H2H_SQL + TABLE_SQL + REST_SQL + ELO_SQL + XG_SQL
ALL_JOIN = f"{SIDES_JOIN} JOIN met m ON m.fixture_id = f.fixture_id {TABLE_JOIN} JOIN elo e ON e.fixture_id = f.fixture_id {XG_JOIN}"
TARGET_SQL = [
    "f.competition_id, f.season_id, f.home_team_id, f.away_team_id, f.kickoff",
    "CAST(f.home_goals > f.away_goals AS INT) AS home_win",
    "CAST(f.home_goals = f.away_goals AS INT) AS draw",
    "CAST(f.home_goals < f.away_goals AS INT) AS away_win",
    "f.home_goals, f.away_goals",
]
EXAMPLE_CTES = (MATCHES, FIN, LONG, TEAM_STATS, HIST, H2H_CTE, TABLE_CTE, ELO_CTE, XG_CTE)
EXAMPLES_SELECT = f"SELECT f.fixture_id, {', '.join(TARGET_SQL + ALL_SQL)} FROM fin f {ALL_JOIN}"
EXAMPLE_SPEC = _typed(N.FEATURES) + " i:competition_id,season_id,home_team_id,away_team_id," + ",".join(N.TARGETS) + " t:kickoff"


@query("j12_examples_66_features", EXAMPLE_SPEC, with_sql(*EXAMPLE_CTES, recursive=True, answer=EXAMPLES_SELECT))
def examples(spark, folder):
    """Every finished match with all 66 features and its targets."""
    p = played(spark, folder)
    return Fe.build_examples(p, p, T.team_stats(spark, folder))


def _missing_sql() -> str:
    keys = {}
    for s, t, v in (("home", "h", "sh"), ("away", "a", "sa")):
        for n in (3, 5, 10):
            keys[f"{s}_wins_last_{n}"] = f"coalesce({t}.n, 0) < {n}"
        for n in (5, 10):
            for c in [f"{s}_points_last_{n}"] + [f"{s}_goals_{d}{m}_last_{n}" for d in ("for", "against") for m in ("", "_mean")]:
                keys[c] = f"coalesce({t}.n, 0) < {n}"
        for w in ("points", "goals_for", "goals_against"):
            keys[f"{s}_{s}_{w}_last_5"] = f"coalesce({t}.vn, 0) < 5"
        keys[f"{s}_table_position"] = f"coalesce({t}.n, 0) = 0"
        keys[f"{s}_rest_days"] = f"coalesce({t}.n, 0) = 0"
        keys[f"{s}_xg_season_asof"] = f"{v}.xg IS NULL"
        keys[f"{s}_xga_season_asof"] = f"{v}.as_of_date IS NOT NULL AND {v}.xga IS NULL"
    keys["h2h_home_wins"] = "m.n < 3"
    keys["table_points_difference"] = "coalesce(h.n, 0) = 0 OR coalesce(a.n, 0) = 0"
    return "concat_ws(','" + "".join(f", CASE WHEN {c} THEN '{k}' END" for k, c in sorted(keys.items())) + ")"


@query(
    "x14_missing_report_keys",
    "i:fixture_id s:missing",
    with_sql(MATCHES, FIN, LONG, TEAM_STATS, HIST, H2H_CTE, XG_CTE, answer=f"SELECT f.fixture_id, {_missing_sql()} AS missing FROM fin f {SIDES_JOIN} JOIN met m ON m.fixture_id = f.fixture_id {XG_JOIN}"),
)
def missing_keys(spark, folder):
    """Which features are missing per match, under the family's reporting keys."""
    p = played(spark, folder)
    rows = Fe.build_examples(p, p, T.team_stats(spark, folder), with_report=True)
    return rows.select("fixture_id", F.array_join(F.array_sort(F.map_keys("missing_report")), ",").alias("missing"))


@query(
    "w0_strict_boundary",
    "i:fixture_id,team_id,earlier,earlier_or_same",
    with_sql(
        MATCHES, FIN, LONG,
        answer="""SELECT p.fixture_id, p.team_id, sum(CASE WHEN h.kickoff < p.kickoff THEN 1 ELSE 0 END) AS earlier,
        count(*) AS earlier_or_same FROM long p JOIN long h ON h.team_id = p.team_id AND h.competition_id = p.competition_id
        AND h.season_id = p.season_id AND h.kickoff <= p.kickoff GROUP BY p.fixture_id, p.team_id""",
    ),
)
def strict_boundary(spark, folder):
    """Matches strictly before kickoff next to those up to and including it: ties make them differ."""
    p = played(spark, folder)
    long = H.team_matches(p).withColumn("n", F.lit(1).cast("long"))
    states = H.running_states(H.instant_totals(long, N.TEAM, ["n"]), N.TEAM, ["n"], "s")
    strict = H.as_of(H.probes(p), [states], N.TEAM, ["s"]).select(*N.TEAM, "at", F.coalesce(F.col("s")["n"], F.lit(0)).alias("earlier"))
    upto = H.as_of(H.probes(p), [states], N.TEAM, ["s"], strict=False).select(*N.TEAM, "at", F.col("s")["n"].alias("earlier_or_same"))
    return long.join(strict, [*N.TEAM, "at"]).join(upto, [*N.TEAM, "at"]).select("fixture_id", "team_id", "earlier", "earlier_or_same")


LONG_SPEC = "i:fixture_id,team_id,opponent_id,goals_for,goals_against,points b:is_home s:outcome"


@query(
    "p1_team_match_long_form",
    LONG_SPEC,
    with_sql(MATCHES, FIN, LONG, answer="SELECT fixture_id, team_id, opponent_id, gf AS goals_for, ga AS goals_against, points, is_home, outcome FROM long"),
)
def long_form(spark, folder):
    """Two rows per finished match, one per side."""
    return H.team_matches(played(spark, folder))


CUTOFF = "1999-06-01 15:00:00"


@query(
    "p2_matches_before_instant",
    "i:fixture_id,competition_id,season_id t:kickoff",
    with_sql(MATCHES, FIN, answer=f"SELECT fixture_id, competition_id, season_id, kickoff FROM fin WHERE kickoff < TIMESTAMP '{CUTOFF}'"),
)
def matches_before(spark, folder):
    """Matches strictly before one instant, newest first."""
    rows = played(spark, folder).where(F.col("kickoff") < F.lit(CUTOFF).cast("timestamp"))
    return rows.orderBy(F.desc("kickoff"), F.asc("fixture_id"))


@query(
    "p3_team_history_counts",
    "i:fixture_id,team_id,matches_before t:last_kickoff",
    with_sql(
        MATCHES, FIN, LONG,
        answer="""SELECT p.fixture_id, p.team_id, count(h.fixture_id) AS matches_before, max(h.kickoff) AS last_kickoff
        FROM long p LEFT JOIN long h ON h.team_id = p.team_id AND h.competition_id = p.competition_id AND h.season_id = p.season_id
        AND h.kickoff < p.kickoff GROUP BY p.fixture_id, p.team_id""",
    ),
)
def team_history(spark, folder):
    """Size and newest kickoff of each team's history before every match."""
    p = played(spark, folder)
    long = H.team_matches(p).withColumn("n", F.lit(1).cast("long"))
    states = H.running_states(H.instant_totals(long, N.TEAM, ["n"]), N.TEAM, ["n"], "s")
    states = states.select(*N.TEAM, "at", F.struct(F.col("s")["n"].alias("n"), F.col("at").alias("last_at")).alias("s"))
    looked = H.as_of(H.probes(p), [states], N.TEAM, ["s"])
    return long.join(looked, [*N.TEAM, "at"]).select(
        "fixture_id",
        "team_id",
        F.coalesce(F.col("s")["n"], F.lit(0)).alias("matches_before"),
        F.timestamp_micros(F.col("s")["last_at"]).alias("last_kickoff"),
    )


@query(
    "a1_standings_as_of",
    "i:competition_id,season_id,team_id,played,wins,draws,losses,goals_for,goals_against,points,goal_difference,position",
    with_sql(
        MATCHES, FIN, LONG,
        answer=f"""SELECT *, row_number() OVER (PARTITION BY competition_id, season_id ORDER BY points DESC, goal_difference DESC,
        goals_for DESC, team_id) AS position FROM (SELECT competition_id, season_id, team_id, count(*) AS played,
        sum(CASE WHEN outcome = 'W' THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN outcome = 'D' THEN 1 ELSE 0 END) AS draws,
        sum(CASE WHEN outcome = 'L' THEN 1 ELSE 0 END) AS losses, sum(gf) AS goals_for, sum(ga) AS goals_against,
        sum(points) AS points, sum(gf) - sum(ga) AS goal_difference FROM long WHERE kickoff < TIMESTAMP '{CUTOFF}'
        GROUP BY competition_id, season_id, team_id)""",
    ),
)
def standings_as_of(spark, folder):
    """Every league table from matches strictly before one instant."""
    return S.table_as_of(played(spark, folder), CUTOFF)


@query(
    "o4_final_tables_tie_break",
    "i:competition_id,season_id,team_id,points,goal_difference,goals_for,position",
    with_sql(
        MATCHES, FIN, LONG,
        answer="""SELECT *, row_number() OVER (PARTITION BY competition_id, season_id ORDER BY points DESC, goal_difference DESC,
        goals_for DESC, team_id) AS position FROM (SELECT competition_id, season_id, team_id, sum(gf) AS goals_for,
        sum(points) AS points, sum(gf) - sum(ga) AS goal_difference FROM long GROUP BY competition_id, season_id, team_id)""",
    ),
)
def final_tables(spark, folder):
    """Final tables in the full order points, difference, goals, team."""
    return S.table_as_of(played(spark, folder), "2100-01-01 00:00:00")


@query(
    "a2_pair_totals",
    "i:pair_lo,pair_hi,meetings,lo_wins,hi_wins,drawn,goals",
    with_sql(
        MATCHES, FIN,
        answer="""SELECT least(home_team_id, away_team_id) AS pair_lo, greatest(home_team_id, away_team_id) AS pair_hi, count(*) AS meetings,
        sum(CASE WHEN (home_team_id < away_team_id AND home_goals > away_goals) OR (home_team_id > away_team_id AND away_goals > home_goals) THEN 1 ELSE 0 END) AS lo_wins,
        sum(CASE WHEN (home_team_id < away_team_id AND home_goals < away_goals) OR (home_team_id > away_team_id AND away_goals < home_goals) THEN 1 ELSE 0 END) AS hi_wins,
        sum(CASE WHEN home_goals = away_goals THEN 1 ELSE 0 END) AS drawn, sum(home_goals + away_goals) AS goals
        FROM fin GROUP BY 1, 2""",
    ),
)
def pair_totals(spark, folder):
    """Totals of every pair after its last meeting, read from the running states."""
    states = Fe.meetings(played(spark, folder))
    last = states.groupBy("pair_lo", "pair_hi").agg(F.max_by("h2h", "at").alias("h"))
    return last.select("pair_lo", "pair_hi", "h.*")


@query(
    "s2_pair_history_scan",
    "i:pair_lo,pair_hi,fixture_id,home_goals,away_goals t:kickoff",
    with_sql(
        MATCHES, FIN,
        answer="SELECT least(home_team_id, away_team_id) AS pair_lo, greatest(home_team_id, away_team_id) AS pair_hi, fixture_id, kickoff, home_goals, away_goals FROM fin",
    ),
)
def pair_history(spark, folder):
    """All meetings of all pairs under one unordered key."""
    return Fe.pair_key(played(spark, folder))


@query(
    "j9_pair_self_history",
    "i:fixture_id,meetings t:last_met",
    with_sql(
        MATCHES, FIN,
        answer="""SELECT f.fixture_id, count(h.fixture_id) AS meetings, max(h.kickoff) AS last_met FROM fin f LEFT JOIN fin h
        ON least(h.home_team_id, h.away_team_id) = least(f.home_team_id, f.away_team_id)
        AND greatest(h.home_team_id, h.away_team_id) = greatest(f.home_team_id, f.away_team_id) AND h.kickoff < f.kickoff
        GROUP BY f.fixture_id""",
    ),
)
def pair_self_history(spark, folder):
    """Number and time of earlier meetings of each match's pair, without a self-join."""
    p = Fe.pair_key(played(spark, folder))
    keys = ["pair_lo", "pair_hi"]
    rows = p.select("fixture_id", *keys, X.instant("kickoff").alias("at"), F.lit(1).cast("long").alias("n"))
    states = H.running_states(H.instant_totals(rows, keys, ["n"]), keys, ["n"], "s")
    states = states.select(*keys, "at", F.struct(F.col("s")["n"].alias("n"), F.col("at").alias("met")).alias("s"))
    looked = H.as_of(rows.select(*keys, "at").distinct(), [states], keys, ["s"])
    return rows.join(looked, [*keys, "at"]).select(
        "fixture_id", F.coalesce(F.col("s")["n"], F.lit(0)).alias("meetings"), F.timestamp_micros(F.col("s")["met"]).alias("last_met")
    )


@query(
    "o2_newest_n_per_team",
    "i:competition_id,season_id,team_id,fixture_id,seq",
    with_sql(
        MATCHES, FIN, LONG,
        answer="""SELECT competition_id, season_id, team_id, fixture_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY competition_id,
        season_id, team_id ORDER BY kickoff DESC, fixture_id) AS seq FROM long) WHERE seq <= 5""",
    ),
)
def newest_per_team(spark, folder):
    """The five newest matches of every team and season; the rank limit runs before the shuffle."""
    w = Window.partitionBy(*N.TEAM).orderBy(F.desc("kickoff"), F.asc("fixture_id"))
    return H.team_matches(played(spark, folder)).withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= 5)


@query(
    "x6_elo_expected_score",
    "i:fixture_id d:expected,result",
    with_sql(
        MATCHES, FIN, ELO_CTE, recursive=True,
        answer="""SELECT e.fixture_id, 1.0 / (1.0 + pow(10.0, (e.ea - (e.eh + 65.0)) / 400.0)) AS expected,
        CASE WHEN f.home_goals > f.away_goals THEN 1.0 WHEN f.home_goals < f.away_goals THEN 0.0 ELSE 0.5 END AS result
        FROM elo e JOIN fin f USING (fixture_id)""",
    ),
)
def elo_expected(spark, folder):
    """Expected and actual home score of every match."""
    df = family("elo")(spark, folder)
    return df.select(
        "fixture_id",
        X.elo_expected(F.col("home_elo_pre_match"), F.col("away_elo_pre_match"), R.HOME_ADVANTAGE).alias("expected"),
        X.elo_result(F.col("home_goals"), F.col("away_goals")).alias("result"),
    )
