"""Scans, filters, pages, lookups, the match feed and match detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIN, MATCHES, PREDICTIONS, TEAM_STATS, query, with_sql
from checks.scores import EVAL_CTES, done_outcomes, stored_predictions
from touchline.functions import names as N
from touchline.functions import scalars as X
from touchline.operators import history as H
from touchline.operators import reads as Rd
from touchline.plans import dataset as Ds
from touchline.sources import tables as T

TODAY = "1999-03-01"
NOW = "1999-03-01 12:00:00"
M = "i:fixture_id,competition_id,season_id,home_team_id,away_team_id s:status t:kickoff"
MCOLS = "fixture_id, competition_id, season_id, home_team_id, away_team_id, status, kickoff"


def table(name):
    return lambda spark, folder: T.table(spark, folder, name)


def dims(spark, folder):
    """Competitions from the regions; seasons and teams from the matches."""
    m = T.matches(spark, folder)
    comps = T.table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    seasons = m.select("competition_id", F.col("season_id").alias("id"), F.col("season_id").alias("year")).distinct()
    teams = m.select(F.explode(F.array("home_team_id", "away_team_id")).alias("id")).distinct()
    return comps, seasons, teams.withColumn("name", F.concat(F.lit("Team "), F.col("id")))


FULL_STATS = """
full_stats AS (
  SELECT m.home_team_id AS team_id, m.competition_id, m.season_id, CAST(l.l_shipdate AS DATE) AS as_of_date,
         max(CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE l.l_quantity / 10 END) AS xg, max(l.l_discount * 20) AS xga,
         sum(CASE WHEN l.l_linenumber > 1 THEN 1 ELSE 0 END) AS fixtures_played, sum(l.l_quantity) AS corners,
         sum(l.l_linenumber) AS yellow_cards, sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS red_cards
  FROM lineitem l JOIN matches m ON m.fixture_id = l.l_orderkey GROUP BY 1, 2, 3, 4)"""


def full_stats(spark, folder):
    """Snapshots with more totals; some have no played match."""
    li = T.table(spark, folder, "lineitem")
    m = T.matches(spark, folder).select("fixture_id", "home_team_id", "competition_id", "season_id")
    return (
        li.join(m, li.l_orderkey == m.fixture_id)
        .groupBy(F.col("home_team_id").alias("team_id"), *N.LEAGUE, F.col("l_shipdate").cast("date").alias("as_of_date"))
        .agg(
            F.max(F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 10)).alias("xg"),
            F.max(F.col("l_discount") * 20).alias("xga"),
            F.count_if(F.col("l_linenumber") > 1).alias("fixtures_played"),
            F.sum("l_quantity").alias("corners"),
            F.sum("l_linenumber").alias("yellow_cards"),
            F.count_if(F.col("l_returnflag") == "R").alias("red_cards"),
        )
    )


@query("s1_finished_match_scan", "i:fixture_id,competition_id,season_id,home_goals,away_goals t:kickoff", with_sql(MATCHES, answer="SELECT * FROM matches WHERE status = 'finished' AND home_goals IS NOT NULL AND away_goals IS NOT NULL"))
def finished_scan(spark, folder):
    """Finished matches with both goals, in kickoff order; the status filter reaches the scan."""
    return H.finished(T.matches(spark, folder)).orderBy("kickoff", "fixture_id")


@query(
    "s3_snapshot_scan_for_teams",
    "i:team_id,competition_id,season_id d:xg,xga D:as_of_date",
    with_sql(MATCHES, TEAM_STATS, answer="SELECT * FROM team_stats WHERE team_id IN (SELECT away_team_id FROM matches WHERE status = 'scheduled')"),
)
def snapshot_scan(spark, folder):
    """Snapshots of the teams that still play away."""
    wanted = T.matches(spark, folder).where("status = 'scheduled'").select(F.col("away_team_id").alias("team_id")).distinct()
    return T.team_stats(spark, folder).join(wanted, "team_id", "left_semi")


@query(
    "p4_build_window_and_cutoff",
    M,
    with_sql(MATCHES, FIN, answer=f"""SELECT {MCOLS} FROM fin WHERE kickoff >= TIMESTAMP '1996-02-01 00:00:00' AND kickoff <= TIMESTAMP '2000-05-31 18:00:00'
    AND kickoff < TIMESTAMP '2000-05-31 18:00:00' AND competition_id IN (SELECT r_regionkey FROM region) AND season_id IN (1996, 1997, 1998, 1999, 2000)"""),
)
def build_window(spark, folder):
    """Targets of a build: a match exactly at the end drops out because the cutoff defaults to the end."""
    end = "2000-05-31 18:00:00"
    cutoff = Ds.resolve_cutoff(None, end)
    targets, _ = Ds.build_window(T.matches(spark, folder), range(5), range(1996, 2001), "1996-02-01 00:00:00", end, cutoff)
    return targets


@query("p5_requested_keys_unknown", "i:custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unknown_keys(spark, folder):
    """Requested keys that the stored table does not know."""
    wanted = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"))
    known = T.table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey"))
    return Rd.missing_keys(wanted, known, "custkey")


@query("o6_set_difference", "i:custkey", "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, folder):
    """Customers without an open order, as a set difference."""
    wanted = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"))
    return wanted.subtract(T.table(spark, folder, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query(
    "p6_target_flags",
    "i:fixture_id,home_win,draw,away_win,home_goals,away_goals",
    with_sql(MATCHES, FIN, answer="""SELECT fixture_id, home_goals, away_goals, CAST(home_goals > away_goals AS INT) AS home_win,
    CAST(home_goals = away_goals AS INT) AS draw, CAST(home_goals < away_goals AS INT) AS away_win FROM fin"""),
)
def target_flags(spark, folder):
    """Outcome flags and goals."""
    from touchline.operators.features import target_columns

    return H.finished(T.matches(spark, folder)).withColumns(target_columns())


@query(
    "p8_upcoming_list",
    M,
    with_sql(MATCHES, answer=f"""SELECT {MCOLS} FROM matches WHERE status IN ('scheduled', 'in_play') AND kickoff >= TIMESTAMP '{NOW}'
    ORDER BY kickoff, fixture_id LIMIT 400"""),
)
def upcoming(spark, folder):
    """The next 400 scheduled or running matches."""
    return Rd.page(Rd.upcoming(T.matches(spark, folder), first=NOW), ["kickoff", "fixture_id"], 400)


@query(
    "p9_feed_day_page_with_total",
    M + " i:total",
    with_sql(MATCHES, answer=f"""SELECT {MCOLS}, count(*) OVER () AS total FROM matches WHERE kickoff >= TIMESTAMP '{TODAY} 00:00:00'
    AND kickoff < TIMESTAMP '1999-03-02 00:00:00' ORDER BY kickoff, fixture_id LIMIT 50 OFFSET 2"""),
)
def feed_day(spark, folder):
    """One page of one UTC day with the day's total."""
    rows = Rd.feed_window(T.matches(spark, folder), day=TODAY)
    return Rd.page_with_total(rows, ["kickoff", "fixture_id"], 50, 2)


@query(
    "p9_feed_window_for_team",
    M,
    with_sql(MATCHES, answer=f"""SELECT {MCOLS} FROM matches WHERE kickoff >= TIMESTAMP '{NOW}' AND kickoff <= TIMESTAMP '{NOW}' + INTERVAL 7 DAY
    AND (home_team_id = 205 OR away_team_id = 205)"""),
)
def feed_team(spark, folder):
    """One team's matches on either side in the seven days from now."""
    return Rd.feed_window(T.matches(spark, folder), now=NOW, team_id=205)


@query(
    "o3_page_with_total",
    "i:custkey,total s:name",
    "SELECT c_custkey AS custkey, c_name AS name, count(*) OVER () AS total FROM customer ORDER BY c_name, c_custkey LIMIT 40 OFFSET 25",
)
def named_page(spark, folder):
    """A page by name with the number of rows before paging."""
    rows = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    return Rd.page_with_total(rows, ["name", "custkey"], 40, 25)


@query("p16_page_by_primary_key", "i:custkey d:balance", "SELECT c_custkey AS custkey, c_acctbal AS balance FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 30")
def pk_page(spark, folder):
    """A page by primary key."""
    rows = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("balance"))
    return Rd.page(rows, ["custkey"], 100, 30)


@query(
    "p10_finished_without_outcome",
    "i:fixture_id t:kickoff",
    with_sql(*EVAL_CTES, answer="""SELECT fixture_id, kickoff FROM fin WHERE fixture_id NOT IN
    (SELECT s.fixture_id FROM stored s JOIN done d USING (prediction_id)) ORDER BY kickoff DESC, fixture_id LIMIT 500"""),
)
def finished_without_outcome(spark, folder):
    """The 500 newest finished matches without any outcome."""
    rows = Rd.finished_without_outcome(T.matches(spark, folder), done_outcomes(spark, folder))
    return Rd.page(rows, [F.desc("kickoff"), F.asc("fixture_id")], 500)


@query(
    "p11_finished_since",
    "i:fixture_id t:finished_at",
    with_sql(MATCHES, FIN, answer=f"SELECT fixture_id, kickoff AS finished_at FROM fin WHERE kickoff >= TIMESTAMP '{NOW}' AND competition_id = 2 ORDER BY kickoff DESC, fixture_id LIMIT 300"),
)
def finished_since(spark, folder):
    """Newest finished matches of one competition since an instant."""
    m = T.matches(spark, folder).withColumn("finished_at", F.col("kickoff"))
    return Rd.page(Rd.finished_since(m, NOW, 2), [F.desc("finished_at"), F.asc("fixture_id")], 300)


@query(
    "p12_overdue_matches",
    "i:fixture_id t:kickoff",
    with_sql(MATCHES, answer=f"SELECT fixture_id, kickoff FROM matches WHERE kickoff >= TIMESTAMP '1995-01-01 00:00:00' AND kickoff <= TIMESTAMP '{NOW}' AND status <> 'finished' ORDER BY kickoff DESC, fixture_id LIMIT 1000"),
)
def overdue(spark, folder):
    """Matches whose kickoff has passed without a result."""
    return Rd.page(Rd.overdue(T.matches(spark, folder), "1995-01-01 00:00:00", NOW), [F.desc("kickoff"), F.asc("fixture_id")], 1000)


INJ = """
inj AS (
  SELECT event_id AS injury_id, user_id AS player_id, (user_id % 5) * 100 + event_id % 20 AS team_id, user_id % 5 AS competition_id,
         CASE event_type WHEN 'error' THEN 'active' WHEN 'view' THEN 'doubtful' WHEN 'click' THEN 'recovered' ELSE 'suspended' END AS status,
         CAST(ts - INTERVAL 9131 DAY AS DATE) AS start_date FROM events)"""


def injuries(spark, folder):
    """One injury per event, moved back into the seasons of the matches."""
    e = T.table(spark, folder, "events")
    kind = F.col("event_type")
    status = F.when(kind == "error", "active").when(kind == "view", "doubtful").when(kind == "click", "recovered").otherwise("suspended")
    return e.select(
        F.col("event_id").alias("injury_id"),
        F.col("user_id").alias("player_id"),
        ((F.col("user_id") % 5) * 100 + F.col("event_id") % 20).alias("team_id"),
        (F.col("user_id") % 5).alias("competition_id"),
        status.alias("status"),
        F.date_sub(F.col("ts").cast("date"), 9131).alias("start_date"),
    )


@query("p13_active_injuries", "i:injury_id,player_id,team_id s:status", with_sql(INJ, answer="SELECT * FROM inj WHERE status IN ('active', 'doubtful') AND competition_id = 3"))
def active_injuries(spark, folder):
    """Active or doubtful injuries of one competition."""
    return Rd.active_injuries(injuries(spark, folder), 3)


@query(
    "p14_predictions_newest_first",
    "i:prediction_id,fixture_id,model_version_id t:created_at",
    with_sql(*EVAL_CTES, answer="SELECT prediction_id, fixture_id, model_version_id, created_at FROM stored ORDER BY created_at DESC, prediction_id DESC LIMIT 200 OFFSET 100"),
)
def predictions_page(spark, folder):
    """A page of predictions, newest first."""
    return Rd.page(stored_predictions(spark, folder), [F.desc("created_at"), F.desc("prediction_id")], 200, 100)


@query(
    "p14_predictions_of_match_and_model",
    "i:prediction_id,fixture_id,model_version_id t:created_at",
    with_sql(*EVAL_CTES, answer="""SELECT prediction_id, fixture_id, model_version_id, created_at FROM stored
    WHERE (fixture_id, model_version_id) IN (SELECT (l_orderkey, l_linenumber % 3) FROM lineitem)"""),
)
def predictions_of_model(spark, folder):
    """The predictions of every asked (match, model version); the pairs come from the line items."""
    asked = T.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("fixture_id"), (F.col("l_linenumber") % 3).cast("long").alias("model_version_id")).distinct()
    return stored_predictions(spark, folder).join(asked, ["fixture_id", "model_version_id"], "left_semi")


@query(
    "p15_outcomes_page",
    "i:prediction_id b:correct",
    with_sql(*EVAL_CTES, answer="SELECT prediction_id, correct FROM outcomes WHERE correct ORDER BY prediction_id LIMIT 150 OFFSET 10"),
)
def outcomes_page(spark, folder):
    """A page of right outcomes."""
    from checks.scores import evaluated

    return Rd.page(evaluated(spark, folder).where("correct"), ["prediction_id"], 150, 10)


@query("p17_bulk_key_lookup", "i:custkey s:name", "SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def bulk_lookup(spark, folder):
    """Rows of every requested key."""
    rows = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    keys = T.table(spark, folder, "events").select(F.col("user_id").alias("custkey")).distinct()
    return rows.join(keys, "custkey", "left_semi")


@query("p17_list_key_lookup", "i:custkey s:name", "SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_custkey IN (3, 7, 1000000007)")
def list_lookup(spark, folder):
    """Rows of a short key list; an unknown key gives no row."""
    rows = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    return Rd.by_keys(rows, "custkey", [3, 7, 1000000007])


_SEASON_ROWS = """seasons AS (SELECT DISTINCT competition_id, season_id AS year, season_id * 10 + competition_id AS id, season_id IN (1996, 1997) AS is_current FROM matches)"""


@query(
    "p17_season_lookups",
    "i:id,year s:asked",
    with_sql(MATCHES, _SEASON_ROWS, answer="""SELECT id, year, 'current' AS asked FROM seasons WHERE competition_id = 3 AND is_current AND year = 1997
    UNION ALL SELECT id, year, 'by year' FROM seasons WHERE competition_id = 2 AND year = 1995 UNION ALL SELECT id, year, 'by year' FROM seasons WHERE competition_id = 2 AND year = 1900"""),
)
def season_lookups(spark, folder):
    """The current season of a competition, and a season by its year; an unknown year gives no row."""
    m = T.matches(spark, folder)
    s = m.select("competition_id", F.col("season_id").alias("year")).distinct().withColumn("id", F.col("year") * 10 + F.col("competition_id")).withColumn("is_current", F.col("year").isin(1996, 1997))
    parts = [(Rd.current_season(s, 3), "current"), (Rd.season_of_year(s, 2, 1995), "by year"), (Rd.season_of_year(s, 2, 1900), "by year")]
    first, *rest = [df.select("id", "year", F.lit(asked).alias("asked")) for df, asked in parts]
    for df in rest:
        first = first.unionByName(df)
    return first


@query(
    "p17_active_version_and_match_rows",
    "i:id s:asked",
    """SELECT max(c_custkey) AS id, 'active' AS asked FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0
    UNION ALL SELECT l_linenumber, 'match' FROM lineitem WHERE l_orderkey = 7""",
)
def version_and_match(spark, folder):
    """The active version of a model name, and all rows of one match."""
    v = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), (F.col("c_acctbal") > 0).alias("is_active"))
    li = T.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("fixture_id"), F.col("l_linenumber").alias("id"))
    return Rd.active_version(v, "BUILDING").select("id", F.lit("active").alias("asked")).unionByName(Rd.of_match(li, 7).select("id", F.lit("match").alias("asked")))


@query(
    "p26_per_match_averages",
    "i:team_id,season_id D:as_of_date d:corners_avg,yellow_cards_avg,red_cards_avg",
    with_sql(MATCHES, FULL_STATS, answer="""SELECT team_id, season_id, as_of_date,
    CASE WHEN fixtures_played > 0 THEN round(corners / fixtures_played, 2) END AS corners_avg,
    CASE WHEN fixtures_played > 0 THEN round(CAST(yellow_cards AS DOUBLE) / fixtures_played, 2) END AS yellow_cards_avg,
    CASE WHEN fixtures_played > 0 THEN round(CAST(red_cards AS DOUBLE) / fixtures_played, 2) END AS red_cards_avg FROM full_stats"""),
)
def averages(spark, folder):
    """Per-match averages with two decimals, NULL without a played match."""
    return full_stats(spark, folder).withColumns({f"{c}_avg": Rd.per_match(c) for c in ("corners", "yellow_cards", "red_cards")})


@query(
    "p27_prediction_eligibility",
    "i:fixture_id t:kickoff",
    with_sql(*EVAL_CTES, answer=f"""SELECT fixture_id, kickoff FROM matches WHERE status = 'scheduled' AND kickoff >= TIMESTAMP '{NOW}' + INTERVAL 1 HOUR
    AND fixture_id NOT IN (SELECT fixture_id FROM predictions WHERE model_version_id = 2 AND w_d > 2)"""),
)
def eligibility(spark, folder):
    """Matches at least an hour ahead without a prediction by this version."""
    p = T.predictions(spark, folder).where(F.col("w_d") > 2)
    return Rd.eligible(T.matches(spark, folder), p, 2, NOW)


@query(
    "p28_snapshot_leak_guards",
    "i:fixture_id,home_injuries,away_injuries,lineups",
    with_sql(MATCHES, INJ, answer="""SELECT m.fixture_id, coalesce(h.n, 0) AS home_injuries, coalesce(a.n, 0) AS away_injuries, coalesce(l.n, 0) AS lineups FROM matches m
    LEFT JOIN (SELECT x.fixture_id, count(*) AS n FROM matches x JOIN inj i ON i.team_id = x.home_team_id AND i.start_date < x.kickoff GROUP BY 1) h ON h.fixture_id = m.fixture_id
    LEFT JOIN (SELECT x.fixture_id, count(*) AS n FROM matches x JOIN inj i ON i.team_id = x.away_team_id AND i.start_date < x.kickoff GROUP BY 1) a ON a.fixture_id = m.fixture_id
    LEFT JOIN (SELECT x.fixture_id, count(*) AS n FROM matches x JOIN lineitem l ON l.l_orderkey = x.fixture_id AND l.l_shipdate < x.kickoff GROUP BY 1) l ON l.fixture_id = m.fixture_id"""),
)
def leak_guards(spark, folder):
    """Injuries begun and lineups published strictly before kickoff."""
    lineups = T.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("fixture_id"), F.col("l_shipdate").cast("timestamp").alias("updated_external_at"))
    return Rd.known_before_kickoff(T.matches(spark, folder), injuries(spark, folder), lineups)


ASOF_DAY = "SELECT p.fixture_id, p.side, t.as_of_date, t.xg, t.xga FROM probes p ASOF LEFT JOIN team_stats t ON t.team_id = p.team_id AND t.competition_id = p.competition_id AND t.season_id = p.season_id AND p.day >= t.as_of_date"
PROBES = """
probes AS (SELECT fixture_id, 'home' AS side, home_team_id AS team_id, competition_id, season_id, CAST(kickoff AS DATE) AS day FROM matches
  UNION ALL SELECT fixture_id, 'away', away_team_id, competition_id, season_id, CAST(kickoff AS DATE) FROM matches)"""


@query("j8_inclusive_snapshot_as_of", "i:fixture_id s:side D:as_of_date d:xg,xga", with_sql(MATCHES, TEAM_STATS, PROBES, answer=ASOF_DAY))
def inclusive_snapshot(spark, folder):
    """Latest snapshot up to and including the kickoff date, for both sides of every match."""
    m = T.matches(spark, folder).select("fixture_id", *N.LEAGUE, F.to_date("kickoff").alias("day"), "home_team_id", "away_team_id")
    sides = m.select(
        "fixture_id", *N.LEAGUE, "day",
        F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_team_id").alias("team_id")) for s in N.SIDES])).alias("s"),
    ).select("fixture_id", *N.LEAGUE, "day", "s.*")
    found = Rd.snapshot_as_of(sides, T.team_stats(spark, folder), ["xg", "xga"], strict=False)
    return sides.join(found, [*N.LEAGUE, "team_id", "day"], "left").select("fixture_id", "side", "stats.*")


LATEST_STATS = f"""
latest_stats AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id, competition_id, season_id ORDER BY as_of_date DESC) AS rn
  FROM team_stats WHERE as_of_date <= DATE '{TODAY}') WHERE rn = 1)"""


@query(
    "w7_latest_snapshot_per_team",
    "i:team_id,competition_id,season_id D:as_of_date d:xg,xga",
    with_sql(MATCHES, TEAM_STATS, LATEST_STATS, answer="SELECT * FROM latest_stats"),
)
def latest_snapshot(spark, folder):
    """Latest snapshot per team and league season up to one day, as one aggregate."""
    return Rd.latest_snapshot(T.team_stats(spark, folder), TODAY, ["xg", "xga"])


PRED = """
pred AS (SELECT s.*, p.w_h * 0.2 * CASE WHEN p.w_h = 7 THEN 0 ELSE 1 END AS eg_h, CASE WHEN p.w_a = 6 THEN NULL ELSE p.w_a * 0.2 END AS eg_a
  FROM stored s JOIN predictions p ON p.fixture_id = s.fixture_id AND p.model_version_id = s.model_version_id WHERE p.w_d <> 5),
last_pred AS (SELECT *, CASE model_version_id WHEN 0 THEN 'elo_baseline v1' WHEN 1 THEN 'poisson v1' ELSE 'gradient_boosting v1' END AS model_label
  FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY created_at DESC, prediction_id DESC) AS rn FROM pred) WHERE rn = 1)"""


def predictions_with_goals(spark, folder):
    """Predictions with expected goals; some rates are zero or absent, some matches lack a prediction."""
    w = T.predictions(spark, folder).where(F.col("w_d") != 5).select(
        "fixture_id",
        "model_version_id",
        F.when(F.col("w_h") == 7, F.lit(0.0)).otherwise(F.col("w_h") * 0.2).alias("expected_home_goals"),
        F.when(F.col("w_a") != 6, F.col("w_a") * 0.2).alias("expected_away_goals"),
    )
    return stored_predictions(spark, folder).join(w, ["fixture_id", "model_version_id"])


def versions(spark):
    rows = [(0, "elo_baseline", "1"), (1, "poisson", "1"), (2, "gradient_boosting", "1")]
    return spark.createDataFrame(rows, "id long, name string, version string")


@query(
    "j11_latest_prediction_with_model",
    "i:fixture_id,prediction_id s:model_label d:p_home_win t:created_at",
    with_sql(*EVAL_CTES, PRED, answer="SELECT * FROM last_pred"),
)
def latest_prediction(spark, folder):
    """Newest prediction per match with its model label."""
    return Rd.latest_prediction(predictions_with_goals(spark, folder), versions(spark))


FEED = """
feed AS (
  SELECT m.fixture_id, m.competition_id, m.season_id, m.kickoff, r.r_name AS competition, m.season_id AS season,
         'Team ' || m.home_team_id AS home_team, 'Team ' || m.away_team_id AS away_team,
         hs.xg AS home_xg, hs.xga AS home_xga, aw.xg AS away_xg, aw.xga AS away_xga, p.model_label, p.p_home_win, p.p_draw, p.p_away_win,
         nullif(coalesce(nullif(p.eg_h, 0), hs.xg), 0) AS lh, nullif(coalesce(nullif(p.eg_a, 0), aw.xg), 0) AS la
  FROM matches m LEFT JOIN region r ON r.r_regionkey = m.competition_id
  LEFT JOIN latest_stats hs ON hs.team_id = m.home_team_id AND hs.competition_id = m.competition_id AND hs.season_id = m.season_id
  LEFT JOIN latest_stats aw ON aw.team_id = m.away_team_id AND aw.competition_id = m.competition_id AND aw.season_id = m.season_id
  LEFT JOIN last_pred p ON p.fixture_id = m.fixture_id),
markets AS (
  SELECT *, CASE WHEN lh > 0 AND la > 0 THEN exp(-lh - la) * (1 + lh + la + (lh + la) * (lh + la) / 2) END AS under_2_5,
         CASE WHEN lh > 0 AND la > 0 THEN (1 - exp(-lh)) * (1 - exp(-la)) END AS btts_yes FROM feed)"""
FEED_CTES = (*EVAL_CTES, TEAM_STATS, LATEST_STATS, PRED, FEED)


def feed(spark, folder):
    comps, seasons, teams = dims(spark, folder)
    return Rd.hydrate(
        T.matches(spark, folder),
        comps,
        seasons,
        teams,
        Rd.latest_snapshot(T.team_stats(spark, folder), TODAY, ["xg", "xga"]),
        Rd.latest_prediction(predictions_with_goals(spark, folder), versions(spark)),
    )


@query(
    "j10_feed_hydration",
    "i:fixture_id,season s:competition,home_team,away_team,model_label d:p_home_win,p_draw,p_away_win,home_xg,home_xga,away_xg,away_xga",
    with_sql(*FEED_CTES, answer="SELECT * FROM markets"),
)
def feed_hydration(spark, folder):
    """Every match with its dimensions, statistics and latest prediction in one plan."""
    return feed(spark, folder)


@query(
    "x5_market_assembly",
    "i:fixture_id d:over_2_5,under_2_5,btts_yes,btts_no",
    with_sql(*FEED_CTES, answer="SELECT fixture_id, 1 - under_2_5 AS over_2_5, under_2_5, btts_yes, 1 - btts_yes AS btts_no FROM markets"),
)
def markets(spark, folder):
    """Goal markets from expected goals, else team xG, per side."""
    return feed(spark, folder)


@query(
    "j10_nested_feed_items",
    "i:fixture_id,competition_id b:has_w1x2,has_goals s:home_name",
    with_sql(*FEED_CTES, answer="""SELECT fixture_id, competition_id, model_label IS NOT NULL AS has_w1x2, under_2_5 IS NOT NULL AS has_goals,
    home_team AS home_name FROM markets"""),
)
def nested_feed(spark, folder):
    """The nested feed item, read back through its structs."""
    item = Rd.nested_response(feed(spark, folder))
    return item.select(
        "fixture_id",
        F.col("item.competition.id").alias("competition_id"),
        F.col("item.w1x2").isNotNull().alias("has_w1x2"),
        F.col("item.goals").isNotNull().alias("has_goals"),
        F.col("item.home_team.name").alias("home_name"),
    )


@query(
    "a25_feed_grouped_by_competition",
    "i:competition_id,matches s:ids",
    with_sql(MATCHES, answer=f"""SELECT competition_id, count(*) AS matches, string_agg(fixture_id, ',' ORDER BY kickoff, fixture_id) AS ids FROM
    (SELECT * FROM matches WHERE kickoff >= TIMESTAMP '{TODAY} 00:00:00' AND kickoff < TIMESTAMP '1999-03-02 00:00:00' ORDER BY kickoff, fixture_id LIMIT 100) GROUP BY 1"""),
)
def grouped_feed(spark, folder):
    """One feed page grouped by competition, in kickoff order."""
    items = Rd.page(Rd.feed_window(T.matches(spark, folder), day=TODAY), ["kickoff", "fixture_id"], 100)
    return Rd.group_feed(items).select("competition_id", "matches", F.array_join(F.transform("fixture_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "j16_match_detail",
    "i:fixture_id,meetings,injuries,lineups,prediction_id s:met_ids,summary",
    with_sql(*FEED_CTES, INJ, FIN.replace("fin AS", "fin2 AS"), answer="""SELECT m.fixture_id, h.meetings, h.met_ids, coalesce(i.injuries, 0) AS injuries, l.lineups, p.prediction_id,
    CASE WHEN p.p_home_win > 0.5 THEN 'home favoured' END AS summary FROM matches m
    LEFT JOIN (SELECT fixture_id, count(*) AS meetings, string_agg(met_id, ',' ORDER BY rn) AS met_ids FROM
      (SELECT w.fixture_id, f.fixture_id AS met_id, row_number() OVER (PARTITION BY w.fixture_id ORDER BY f.kickoff DESC, f.fixture_id) AS rn
       FROM matches w JOIN fin2 f ON least(f.home_team_id, f.away_team_id) = least(w.home_team_id, w.away_team_id)
       AND greatest(f.home_team_id, f.away_team_id) = greatest(w.home_team_id, w.away_team_id) AND f.kickoff < w.kickoff WHERE w.status = 'scheduled') WHERE rn <= 5 GROUP BY 1) h USING (fixture_id)
    LEFT JOIN (SELECT w.fixture_id, count(*) AS injuries FROM matches w JOIN inj i ON i.team_id IN (w.home_team_id, w.away_team_id) AND i.status IN ('active', 'doubtful') GROUP BY 1) i USING (fixture_id)
    LEFT JOIN (SELECT l_orderkey AS fixture_id, count(*) AS lineups FROM lineitem GROUP BY 1) l USING (fixture_id)
    LEFT JOIN last_pred p USING (fixture_id) WHERE m.status = 'scheduled'"""),
)
def match_detail(spark, folder):
    """Detail of every unplayed match: last meetings, injuries, lineup, prediction and explanation."""
    m = T.matches(spark, folder)
    lineups = T.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("fixture_id"))
    last = Rd.latest_prediction(predictions_with_goals(spark, folder), versions(spark))
    why = stored_predictions(spark, folder).where(F.col("p_home_win") > 0.5).select("prediction_id", F.lit("home favoured").alias("summary"))
    out = Rd.detail(m.where("status = 'scheduled'"), H.finished(m), injuries(spark, folder), lineups, last, why)
    return out.select(
        "fixture_id",
        F.size("h2h").alias("meetings"),
        F.array_join(F.transform("h2h", lambda x: x["fixture_id"].cast("string")), ",").alias("met_ids"),
        (F.col("home_injuries") + F.col("away_injuries")).alias("injuries"),
        "lineups",
        "prediction_id",
        "summary",
    ).withColumn("meetings", F.when(F.col("meetings") > 0, F.col("meetings")))


@query(
    "x11_kickoff_date_utc",
    "i:fixture_id D:day i:snapshot_visible_from",
    with_sql(MATCHES, answer="SELECT fixture_id, CAST(kickoff AS DATE) AS day, CAST(epoch_us(CAST(CAST(kickoff AS DATE) AS TIMESTAMP)) AS BIGINT) + 86400000000 - 1 AS snapshot_visible_from FROM matches"),
)
def kickoff_date(spark, folder):
    """UTC date of kickoff and the instant from which a snapshot of that day counts."""
    day = F.to_date("kickoff")
    return T.matches(spark, folder).select("fixture_id", day.alias("day"), X.end_of_day(day).alias("snapshot_visible_from"))


@query("o1_total_order", "i:fixture_id t:kickoff", with_sql(MATCHES, FIN, answer="SELECT fixture_id, kickoff FROM fin ORDER BY kickoff, fixture_id"))
def total_order(spark, folder):
    """Rows in the dataset order, range-partitioned by (kickoff, id)."""
    return H.finished(T.matches(spark, folder)).orderBy("kickoff", "fixture_id")
