"""Payload parsing, key resolution, upserts, expectations, run tables and streams.

Payload pages are built from the given tables; the SQL states the expected rows directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIN, MATCHES, PREDICTIONS, query, with_sql
from checks.features import ELO_CTE
from checks.scores import EVAL_CTES, done_outcomes, fold_metrics, stored_predictions
from touchline.functions import names as N
from touchline.functions import scalars as X
from touchline.operators import expectations as Ex
from touchline.operators import history as H
from touchline.operators import metrics as Mx
from touchline.operators import upsert as U
from touchline.plans import ingest as In
from touchline.session import materialise, scratch_path
from touchline.sources import payloads as P
from touchline.sources import runs as R
from touchline.sources import tables as T
from touchline.streaming import elo as SE
from touchline.streaming import ingest as SI

PER_PAGE = 100
CODES_A = [*N.STATUS_FORMAT_A, "HT", "XX"]
CODES_B = [*N.STATUS_FORMAT_B, "later", "WO"]


def pages(entries, key, field="response", keep=()):
    """JSON bodies of at most PER_PAGE entries, grouped by id range. Entries move to their page before they are listed."""
    body = F.to_json(F.struct(F.collect_list("e").alias(field)))
    dealt = entries.withColumn("page", F.floor(F.col(key) / PER_PAGE)).repartition(*keep, "page")
    return dealt.groupBy(*keep, "page").agg(body.alias("body"))


def _sql_pick(values, index):
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST({index} AS INT) + 1)"


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _in(names):
    return ", ".join(f"'{n}'" for n in names)


def _status_sql(mapping, code):
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {code} {cases} ELSE 'scheduled' END"


# --- payloads -------------------------------------------------------------------------------

def order_key():
    return F.col("o_orderkey")


def payload_a(spark, folder):
    """First match format: every status code, three time notations, broken and one-sided entries."""
    o = T.table(spark, folder, "orders")
    m = T.matches(spark, folder).select("fixture_id", "competition_id", "season_id", "home_team_id", "away_team_id", "kickoff")
    price = F.floor("o_totalprice").cast("long")
    iso = F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(order_key() % 3 == 0, F.concat(iso, F.lit("Z"))).when(order_key() % 3 == 1, F.concat(iso, F.lit("+00:00"))).otherwise(iso)
    unset = F.lit(None).cast("string")
    x = o.join(m, o.o_orderkey == m.fixture_id)
    entry = F.struct(
        F.struct(
            F.when(order_key() % 101 != 0, order_key().cast("string")).otherwise(F.lit("n/a")).alias("id"),
            F.when(order_key() % 97 != 0, written).alias("date"),
            F.struct(_pick(CODES_A, order_key() % len(CODES_A)).alias("short")).alias("status"),
            F.struct(F.concat(F.lit("Ground "), F.col("home_team_id")).alias("name")).alias("venue"),
        ).alias("fixture"),
        F.struct(
            F.col("competition_id").alias("id"),
            F.when(order_key() % 103 != 0, F.col("season_id")).otherwise(F.lit(0)).alias("season"),
            F.when(order_key() % 7 != 0, F.concat(F.lit("Regular Season - "), order_key() % 38 + 1)).otherwise(F.lit("Final")).alias("round"),
        ).alias("league"),
        F.struct(F.struct(F.col("home_team_id").alias("id")).alias("home"), F.struct(F.col("away_team_id").alias("id")).alias("away")).alias("teams"),
        F.struct(
            F.when(F.col("o_orderstatus") != "P", price % 5).alias("home"),
            F.when((F.col("o_orderstatus") != "P") & (order_key() % 11 != 0), (price + order_key()) % 4).alias("away"),
        ).alias("goals"),
    )
    return pages(x.select("o_orderkey", entry.alias("e")), "o_orderkey")


STAGED_A = f"""
staged AS (
  SELECT m.fixture_id AS external_id, m.competition_id AS competition_external_id, m.season_id AS season_year, m.home_team_id AS home_team_external_id,
         m.away_team_id AS away_team_external_id, m.kickoff AS kickoff_time,
         CASE WHEN m.fixture_id % 7 <> 0 THEN m.fixture_id % 38 + 1 END AS matchday,
         {_status_sql(N.STATUS_FORMAT_A, _sql_pick(CODES_A, f"m.fixture_id % {len(CODES_A)}"))} AS status,
         CASE WHEN m.fixture_id % 11 <> 0 THEN m.home_goals END AS home_goals, CASE WHEN m.fixture_id % 11 <> 0 THEN m.away_goals END AS away_goals,
         CASE WHEN m.fixture_id % 101 = 0 THEN 'missing external_id' WHEN m.fixture_id % 103 = 0 THEN 'missing season_year'
              WHEN m.fixture_id % 97 = 0 THEN 'missing kickoff_time' END AS reject
  FROM matches m)"""
_STAGED_SPEC = (
    "i:external_id,competition_external_id,season_year,home_team_external_id,away_team_external_id,matchday,home_goals,away_goals "
    "s:status t:kickoff_time,finished_at"
)
_STAGED_OK = "SELECT *, CASE WHEN status = 'finished' THEN kickoff_time END AS finished_at FROM staged WHERE reject IS NULL"


def staged_a(spark, folder):
    return P.matches_a(payload_a(spark, folder))


@query("s4_match_payload", _STAGED_SPEC, with_sql(MATCHES, STAGED_A, answer=_STAGED_OK))
def match_payload(spark, folder):
    """Accepted rows of the first match format."""
    return P.split_rejects(staged_a(spark, folder))[0]


@query("s4_match_payload_rejects", "i:n s:reject", with_sql(MATCHES, STAGED_A, answer="SELECT reject, count(*) AS n FROM staged WHERE reject IS NOT NULL GROUP BY reject"))
def match_rejects(spark, folder):
    """Rejected entries by reason."""
    return P.split_rejects(staged_a(spark, folder))[1].groupBy("reject").agg(F.count("*").alias("n"))


@query(
    "s14_league_season_window",
    "i:external_id t:kickoff_time",
    with_sql(MATCHES, STAGED_A, answer=f"""SELECT external_id, kickoff_time FROM ({_STAGED_OK}) WHERE competition_external_id = 4 AND season_year = 1998
    AND CAST(kickoff_time AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-09-30'"""),
)
def season_window(spark, folder):
    """One league season's matches in a closed date window."""
    return P.in_window(P.split_rejects(staged_a(spark, folder))[0], 4, 1998, "1998-03-01", "1998-09-30")


def payload_b(spark, folder):
    """Second match format."""
    o = T.table(spark, folder, "orders")
    m = T.matches(spark, folder)
    code = _pick(CODES_B, order_key() % len(CODES_B))
    entry = F.struct(
        order_key().alias("id"),
        F.col("competition_id").alias("league_id"),
        (F.col("season_id") + 100).alias("season_id"),
        F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("event_date"),
        F.when(order_key() % 2 == 0, F.upper(code)).otherwise(code).alias("status"),
        F.col("home_goals").alias("home_score"),
        F.when(order_key() % 13 != 0, F.col("away_goals")).alias("away_score"),
        F.col("home_team_id"),
        F.col("away_team_id"),
        (order_key() % 38 + 1).alias("round_number"),
        F.when(order_key() % 5 == 0, F.lit("2031")).alias("season_year"),
    )
    x = o.select("o_orderkey").join(m, o.o_orderkey == m.fixture_id)
    return pages(x.select("o_orderkey", entry.alias("e")), "o_orderkey", "results")


STAGED_B = f"""
staged_b AS (
  SELECT fixture_id AS external_id, competition_id AS competition_external_id, season_id + 100 AS season_external_id,
         CASE WHEN fixture_id % 5 = 0 THEN 2031 ELSE season_id END AS season_year, home_team_id AS home_team_external_id,
         away_team_id AS away_team_external_id, kickoff AS kickoff_time, fixture_id % 38 + 1 AS matchday,
         {_status_sql(N.STATUS_FORMAT_B, "lower(" + _sql_pick(CODES_B, f"fixture_id % {len(CODES_B)}") + ")")} AS status,
         CASE WHEN fixture_id % 13 <> 0 THEN home_goals END AS home_goals, CASE WHEN fixture_id % 13 <> 0 THEN away_goals END AS away_goals
  FROM matches)"""


@query(
    "s13_second_match_format",
    _STAGED_SPEC + " i:season_external_id",
    with_sql(MATCHES, STAGED_B, answer="SELECT *, CASE WHEN status = 'finished' THEN kickoff_time END AS finished_at FROM staged_b"),
)
def second_format(spark, folder):
    """All rows of the second match format."""
    return P.split_rejects(P.matches_b(payload_b(spark, folder)))[0]


@query(
    "o5_s13_union_of_formats",
    "s:status i:n",
    with_sql(MATCHES, STAGED_A, STAGED_B, answer="SELECT status, count(*) AS n FROM (SELECT status FROM staged WHERE reject IS NULL UNION ALL SELECT status FROM staged_b WHERE status IN ('finished', 'scheduled')) GROUP BY status"),
)
def union_of_formats(spark, folder):
    """Both formats in one staged table; of the second only finished and scheduled ones."""
    a = P.split_rejects(staged_a(spark, folder))[0]
    b = P.split_rejects(P.matches_b(payload_b(spark, folder), ("finished", "scheduled")))[0]
    return a.unionByName(b).groupBy("status").agg(F.count("*").alias("n"))


KINDS = ["League", "Cup", "PLAYOFF", "super_cup", "friendly"]


def league_payload(spark, folder):
    """Suppliers as leagues with three seasons each."""
    s = T.table(spark, folder, "supplier").join(T.table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey")

    def season(i):
        year = (key % 10 + 2000 + i).cast("int")
        return F.struct(
            year.alias("year"),
            F.concat(year, F.lit("-08-01")).alias("start"),
            F.when(key % 4 != 0, F.concat(year + 1, F.lit("-05-31T00:00:00"))).alias("end"),
            (F.lit(i) == 1).alias("current"),
        )

    entry = F.struct(
        F.struct(key.alias("id"), F.col("s_name").alias("name"), F.when(key % 6 != 5, _pick(KINDS, key % 5)).alias("type"), F.concat(F.lit("logo/"), key).alias("logo")).alias("league"),
        F.struct(F.col("n_name").alias("name")).alias("country"),
        F.array(*[season(i) for i in range(3)]).alias("seasons"),
    )
    return pages(s.select("s_suppkey", entry.alias("e")), "s_suppkey")


@query(
    "s5_competition_payload",
    "i:external_id s:name,type,country,logo",
    f"""SELECT s_suppkey AS external_id, s_name AS name, n_name AS country, 'logo/' || s_suppkey AS logo,
    CASE WHEN s_suppkey % 6 = 5 THEN 'league' ELSE {_sql_pick(["league", "cup", "playoff", "super_cup", "league"], "s_suppkey % 5")} END AS type
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def competition_payload(spark, folder):
    """Competitions; an unknown type is a league."""
    return P.split_rejects(P.competitions(league_payload(spark, folder)))[0]


SEASONS = """
listed AS (SELECT s_suppkey AS competition_external_id, s_suppkey % 10 + 2000 + i AS year, CAST(s_suppkey % 10 + 2000 + i || '-08-01' AS DATE) AS start_date,
  CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 10 + 2001 + i || '-05-31' AS DATE) END AS end_date, i = 1 AS is_current, i
  FROM supplier CROSS JOIN range(0, 3) AS r(i))"""


@query(
    "s6_season_payload",
    "i:competition_external_id,external_id,year b:is_current D:start_date,end_date",
    with_sql(SEASONS, answer="SELECT *, year AS external_id FROM listed"),
)
def season_payload(spark, folder):
    """Seasons nested in the league payload."""
    return P.split_rejects(P.seasons(league_payload(spark, folder)))[0]


def team_payload(spark, folder):
    c = T.table(spark, folder, "customer").join(T.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    entry = F.struct(
        F.struct(
            F.when(key % 50 != 7, key).alias("id"),
            F.col("c_name").alias("name"),
            F.substring("c_mktsegment", 1, 3).alias("code"),
            F.col("n_name").alias("country"),
            F.when(key % 3 == 0, F.concat(1850 + key % 100, F.lit("-01-01"))).when(key % 3 == 1, (1850 + key % 100).cast("string")).otherwise(F.lit("old")).alias("founded"),
        ).alias("team"),
        F.struct(F.concat(F.lit("Park "), key).alias("name")).alias("venue"),
    )
    return pages(c.select("c_custkey", entry.alias("e")), "c_custkey")


@query(
    "s7_team_payload",
    "i:external_id,founded s:name,short_name,code,country,venue",
    """SELECT c_custkey AS external_id, c_name AS name, substr(c_mktsegment, 1, 3) AS short_name, substr(c_mktsegment, 1, 3) AS code, n_name AS country,
    'Park ' || c_custkey AS venue, CASE WHEN c_custkey % 3 < 2 THEN 1850 + c_custkey % 100 END AS founded
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 <> 7""",
)
def team_rows(spark, folder):
    """Teams; the founding year is the leading four digits."""
    return P.split_rejects(P.teams(team_payload(spark, folder)))[0]


_CUST = "SELECT o_custkey AS k, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS w, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS d, sum(o_orderkey % 4) AS gf FROM orders GROUP BY o_custkey"


def team_stat_payload(spark, folder):
    """One page per customer; totals from its orders, several of them unset or oddly typed."""
    o = T.table(spark, folder, "orders")
    c = o.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("w"), F.count_if(F.col("o_orderstatus") == "O").alias("d"), F.sum(F.col("o_orderkey") % 4).alias("gf")
    )
    k = F.col("o_custkey")

    def total(x):
        return F.struct(x.alias("total"))

    body = F.struct(
        F.struct(
            F.struct(total(F.col("n")).alias("played"), total(F.col("w")).alias("wins"), total(F.when(k % 4 != 0, F.col("d"))).alias("draws")).alias("fixtures"),
            F.struct(total(F.col("gf")).alias("for")).alias("goals"),
            F.create_map(F.lit("percentage"), F.concat(k % 10, F.lit("%")), F.lit("home"), (k % 6).cast("string")).alias("clean_sheet"),
            F.create_map(F.lit("total"), (k % 9).cast("string")).alias("shots"),
            F.when(k % 5 != 0, F.lit("WWDL")).otherwise(F.lit("")).alias("form"),
            F.when(k % 2 == 0, F.lit("1.25")).otherwise(F.lit("none")).alias("xg"),
        ).alias("response")
    )
    return c.select(k.alias("team_external_id"), (k % 5).alias("competition_external_id"), F.lit(1998).cast("long").alias("season_external_id"), F.lit("1999-01-01").cast("date").alias("as_of_date"), F.to_json(body).alias("body"))


_TS = f"""ts AS (SELECT k AS team_external_id, k % 5 AS competition_external_id, n AS fixtures_played, w AS wins, CASE WHEN k % 4 <> 0 THEN d ELSE 0 END AS draws, 0 AS losses,
 gf AS goals_for, 0 AS goals_against, k % 6 AS clean_sheets, 0 AS failed_to_score, k % 9 AS shots_total, CASE WHEN k % 5 <> 0 THEN 'WWDL' END AS form,
 CASE WHEN k % 2 = 0 THEN 1.25 END AS xg FROM ({_CUST}))"""


@query(
    "s8_team_statistics_payload",
    "i:team_external_id,fixtures_played,wins,draws,losses,goals_for,goals_against,clean_sheets,failed_to_score,shots_total s:form d:xg",
    with_sql(_TS, answer="SELECT * FROM ts"),
)
def team_statistics(spark, folder):
    """Season totals; absent totals are 0 and the first integer of a block counts."""
    return P.team_statistics(team_stat_payload(spark, folder))


SLOTS = ["Goalkeeper", "Defender", "MF", "Attacker", "Coach"]


def player_payload(spark, folder):
    c = T.table(spark, folder, "customer")
    k = F.col("c_custkey")

    def stat(i):
        return F.struct(
            F.struct((k % 7).alias("id")).alias("team"),
            F.struct(F.when((k + i) % 5 != 4, (k + i) % 5).otherwise(F.lit(77)).cast("string").alias("id")).alias("league"),
            F.struct((k % 30 + i).alias("appearences"), (k % 20).alias("lineups"), F.when(k % 3 == 0, F.lit("6.85")).alias("rating")).alias("games"),
            F.struct((k % 11 + i).alias("total")).alias("goals"),
            F.struct((k % 4).alias("yellow")).alias("cards"),
        )

    entry = F.struct(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("nationality"),
        F.struct(F.concat(1980 + k % 20, F.lit("-0"), k % 9 + 1, F.lit("-15")).alias("date")).alias("birth"),
        F.when(k % 4 != 0, F.concat(160 + k % 40, F.lit(" cm"))).otherwise(F.lit("tall")).alias("height"),
        F.when(k % 5 != 0, F.concat(60 + k % 35, F.lit(" kg"))).alias("weight"),
        F.when(k % 6 != 0, _pick(SLOTS, k % 5)).alias("position"),
        F.array(*[stat(i) for i in range(3)]).alias("statistics"),
    )
    return c.select("c_custkey", entry.alias("e"))


_PL = """pl AS (SELECT c_custkey AS external_id, c_name AS name, c_mktsegment AS nationality, CAST((1980 + c_custkey % 20) || '-0' || (c_custkey % 9 + 1) || '-15' AS DATE) AS birth_date,
 CASE WHEN c_custkey % 4 <> 0 THEN 160 + c_custkey % 40 END AS height_cm, CASE WHEN c_custkey % 5 <> 0 THEN 60 + c_custkey % 35 END AS weight_kg,
 CASE WHEN c_custkey % 6 = 0 THEN 'MF' WHEN c_custkey % 5 = 0 THEN 'GK' WHEN c_custkey % 5 = 1 THEN 'DF' WHEN c_custkey % 5 = 2 THEN 'MF' WHEN c_custkey % 5 = 3 THEN 'FW' END AS position FROM customer)"""


@query("s9_player_payload", "i:external_id,height_cm,weight_kg s:name,nationality,position D:birth_date", with_sql(_PL, answer="SELECT * FROM pl"))
def player_rows(spark, folder):
    """Players across pages, with numbers cut out of texts."""
    return P.split_rejects(P.players(pages(player_payload(spark, folder), "c_custkey")))[0]


def player_stat_pages(spark, folder):
    """One page per player, asked for one league."""
    x = player_payload(spark, folder)
    return x.select(
        F.col("c_custkey").alias("player_external_id"),
        F.lit(3).cast("long").alias("competition_external_id"),
        F.lit(1998).cast("long").alias("season_external_id"),
        F.to_json(F.struct(F.array("e").alias("response"))).alias("body"),
    )


_PS = """ps AS (SELECT c_custkey AS player_external_id, c_custkey % 7 AS team_external_id, c_custkey % 30 + i AS appearances, c_custkey % 20 AS starts, 0 AS minutes_played,
 c_custkey % 11 + i AS goals, 0 AS assists, c_custkey % 4 AS yellow_cards, 0 AS red_cards, CASE WHEN c_custkey % 3 = 0 THEN 6.85 END AS rating
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN 0 WHEN (c_custkey + 1) % 5 = 3 THEN 1 WHEN (c_custkey + 2) % 5 = 3 THEN 2 END AS i FROM customer) WHERE i IS NOT NULL)"""


@query(
    "s10_player_statistics_payload",
    "i:player_external_id,team_external_id,appearances,starts,minutes_played,goals,assists,yellow_cards,red_cards d:rating",
    with_sql(_PS, answer="SELECT * FROM ps"),
)
def player_statistics(spark, folder):
    """The first statistics entry of the requested league."""
    return P.player_statistics(player_stat_pages(spark, folder))


def injury_payload(spark, folder):
    e = T.table(spark, folder, "events")
    k = F.col("event_id")
    entry = F.struct(
        k.alias("id"),
        F.struct(F.when(k % 61 != 0, F.col("user_id")).alias("id")).alias("player"),
        F.struct(((F.col("user_id") % 5) * 100 + k % 20).alias("id")).alias("team"),
        F.when(k % 3 != 0, F.struct((F.col("user_id") % 5).alias("id"))).alias("league"),
        F.struct(F.when(k % 4 != 0, k).alias("id")).alias("fixture"),
        F.col("event_type").alias("type"),
        F.when(k % 5 == 0, F.lit("Doubtful")).when(k % 5 == 1, F.lit("unclear")).when(k % 5 == 2, F.lit("recovered")).alias("status"),
        F.when(k % 6 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("date"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    )
    return pages(e.select("event_id", entry.alias("e")), "event_id")


_IN = """ip AS (SELECT event_id AS external_id, user_id AS player_external_id, (user_id % 5) * 100 + event_id % 20 AS team_external_id,
 CASE WHEN event_id % 3 <> 0 THEN user_id % 5 END AS competition_external_id, CASE WHEN event_id % 4 <> 0 THEN event_id END AS fixture_external_id, event_type AS type,
 CASE WHEN event_id % 5 = 0 THEN 'doubtful' WHEN event_id % 5 = 2 THEN 'recovered' ELSE 'active' END AS status,
 CASE WHEN event_id % 6 <> 0 THEN CAST(ts AS DATE) ELSE DATE '1970-01-01' END AS start_date, date_trunc('second', ts) AS updated_external_at
 FROM events WHERE event_id % 61 <> 0)"""


@query(
    "s11_injury_payload",
    "i:external_id,player_external_id,team_external_id,competition_external_id,fixture_external_id s:type,status D:start_date t:updated_external_at",
    with_sql(_IN, answer="SELECT * FROM ip"),
)
def injury_payload_rows(spark, folder):
    """Injuries with default status and start date, optional league and match."""
    return P.split_rejects(P.injuries(injury_payload(spark, folder)))[0]


def lineup_pages(spark, folder):
    """One page per order: two teams, line items as player slots (at most seven).

    The line items are dealt by order before they meet the matches, in a merge, so that a task holds the slots and
    matches of one shuffle partition, not all it scanned and all matches.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    li = T.table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "fixture_id").repartition(parts, "fixture_id")
    m = T.matches(spark, folder).select("fixture_id", "home_team_id", "away_team_id")
    slot = F.struct(
        F.col("l_linenumber").alias("n"),
        F.struct(
            F.struct(F.col("l_partkey").alias("id")).alias("player"),
            F.when(F.col("l_linenumber") % 2 == 0, _pick(SLOTS, F.col("l_linenumber") % 5)).alias("pos"),
            F.col("l_linenumber").alias("number"),
        ).alias("s"),
        (F.col("l_returnflag") == "N").alias("sub"),
    )
    per = li.join(m.hint("merge"), "fixture_id").groupBy("fixture_id", "home_team_id", "away_team_id").agg(F.sort_array(F.collect_list(slot)).alias("all"))

    def part(sub):
        return F.struct(F.transform(F.filter("all", lambda x: x["sub"] == sub), lambda x: x["s"]).alias("players"))

    def team(side, formation):
        return F.struct(
            F.struct(F.col(f"{side}_team_id").alias("id")).alias("team"), F.lit(formation).alias("formation"), part(False).alias("startXI"), part(True).alias("substitutes")
        )

    body = F.to_json(F.struct(F.array(team("home", "4-4-2"), team("away", "4-3-3")).alias("response")))
    return per.select(F.col("fixture_id").alias("fixture_external_id"), body.alias("body"))


_LU = """lu AS (SELECT m.fixture_id AS fixture_external_id, t.team_id AS team_external_id, t.is_home, t.formation, l.l_partkey AS player_external_id, l.l_linenumber AS shirt_number,
 CASE WHEN l.l_linenumber % 2 <> 0 THEN 'MF' WHEN l.l_linenumber % 5 = 0 THEN 'GK' WHEN l.l_linenumber % 5 = 1 THEN 'DF' WHEN l.l_linenumber % 5 = 2 THEN 'MF' WHEN l.l_linenumber % 5 = 3 THEN 'FW' END AS position,
 l.l_returnflag <> 'N' AS is_starter,
 row_number() OVER (PARTITION BY m.fixture_id, t.team_id ORDER BY CASE WHEN l.l_returnflag = 'N' THEN 1 ELSE 0 END, l.l_linenumber, l.l_partkey) - 1 AS slot
 FROM matches m JOIN lineitem l ON l.l_orderkey = m.fixture_id
 CROSS JOIN LATERAL (SELECT m.home_team_id AS team_id, TRUE AS is_home, '4-4-2' AS formation UNION ALL SELECT m.away_team_id, FALSE, '4-3-3') t)"""


@query(
    "s12_lineup_payload",
    "i:fixture_external_id,team_external_id,player_external_id,shirt_number s:formation,position b:is_starter",
    with_sql(MATCHES, _LU, answer="SELECT * FROM lu"),
)
def lineup_rows(spark, folder):
    """Lineup slots, starters and substitutes flattened."""
    rows = P.split_rejects(P.lineups(lineup_pages(spark, folder)))[0]
    return rows.select("fixture_external_id", "team_external_id", "formation", F.explode("players").alias("p")).select("*", "p.*")


@query("x9_x10_safe_parsing", "i:order_key,number t:at D:day", """SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS number,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate - INTERVAL 2 HOUR END AS at, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def safe_parsing(spark, folder):
    """Integers, offset timestamps and date prefixes out of text; anything else is NULL."""
    o = T.table(spark, folder, "orders")
    text = F.when(order_key() % 5 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.lit("soon"))
    number = F.when(order_key() % 4 != 0, order_key().cast("string")).otherwise(F.lit("n/a"))
    return o.select(order_key().alias("order_key"), X.to_long(number).alias("number"), X.iso_timestamp(text).alias("at"), X.iso_date(text).alias("day"))


# --- resolution -----------------------------------------------------------------------------

OFFSET = 10_000


def stored_dims(spark, folder):
    """Stored dimensions with internal ids; the teams at home in 2001 only are not stored."""
    m = T.matches(spark, folder)
    comps = T.table(spark, folder, "region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").cast("long").alias("external_id"), (F.col("r_regionkey") + OFFSET).cast("long").alias("id"))
    seasons = m.where("season_id < 2001").select((F.col("competition_id") + OFFSET).alias("competition_id"), F.col("season_id").alias("year"), F.col("season_id").alias("external_id"), (F.col("season_id") + F.col("competition_id") * 10000).alias("id")).distinct()
    teams = m.where("home_goals = 4").select(F.col("home_team_id").alias("external_id"), (F.col("home_team_id") + OFFSET).alias("id")).distinct()
    players = T.table(spark, folder, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("external_id"), (F.col("c_custkey") + OFFSET).alias("id"))
    fixtures = m.where("status = 'finished'").select(F.col("fixture_id").alias("external_id"), (F.col("fixture_id") + OFFSET).alias("id"), (F.col("home_team_id") + OFFSET).alias("home_team_id"))
    return comps, seasons, teams, players, fixtures


DIMS = """
comps AS (SELECT r_regionkey AS e, r_regionkey + 10000 AS id FROM region WHERE r_name <> 'ASIA'),
teams AS (SELECT DISTINCT home_team_id AS e, home_team_id + 10000 AS id FROM matches WHERE home_goals = 4),
players AS (SELECT c_custkey AS e, c_custkey + 10000 AS id FROM customer WHERE c_acctbal >= 0)"""


@query(
    "j1_match_key_resolution",
    "i:external_id,home_team_id,away_team_id,season_id s:skip",
    with_sql(MATCHES, STAGED_A, DIMS, answer="""SELECT s.external_id, h.id AS home_team_id, a.id AS away_team_id,
    CASE WHEN c.id IS NOT NULL AND season_year < 2001 THEN season_year + competition_external_id * 10000 END AS season_id,
    CASE WHEN c.id IS NULL THEN 'unknown competition' WHEN season_year >= 2001 THEN 'unknown season' WHEN h.id IS NULL OR a.id IS NULL THEN 'unknown team' END AS skip
    FROM staged s LEFT JOIN comps c ON c.e = s.competition_external_id LEFT JOIN teams h ON h.e = s.home_team_external_id LEFT JOIN teams a ON a.e = s.away_team_external_id
    WHERE s.reject IS NULL"""),
)
def match_resolution(spark, folder):
    """Internal ids of staged matches, with the reason for every skipped one."""
    comps, seasons, teams, _, _ = stored_dims(spark, folder)
    return In.resolve_matches(P.split_rejects(staged_a(spark, folder))[0], teams, comps, seasons)


@query(
    "j2_injury_resolution",
    "i:external_id,player_id,team_id,competition_id,fixture_id s:skip",
    with_sql(MATCHES, DIMS, _IN, answer="""SELECT external_id, p.id AS player_id, t.id AS team_id, c.id AS competition_id, m.fixture_id + 10000 AS fixture_id,
    CASE WHEN p.id IS NULL OR t.id IS NULL THEN 'unknown player or team' END AS skip FROM ip LEFT JOIN players p ON p.e = player_external_id
    LEFT JOIN teams t ON t.e = team_external_id LEFT JOIN comps c ON c.e = competition_external_id LEFT JOIN matches m ON m.fixture_id = fixture_external_id AND m.status = 'finished'"""),
)
def injury_resolution(spark, folder):
    """Injuries with player and team required, competition and match optional."""
    comps, _, teams, players, fixtures = stored_dims(spark, folder)
    return In.resolve_injuries(P.split_rejects(P.injuries(injury_payload(spark, folder)))[0], players, teams, comps, fixtures.drop("home_team_id"))


@query(
    "j3_lineup_resolution",
    "i:fixture_id,team_id,player_id,shirt_number,slot s:skip",
    with_sql(MATCHES, DIMS, _LU, answer="""SELECT m.fixture_id + 10000 AS fixture_id, t.id AS team_id, p.id AS player_id, shirt_number, slot,
    CASE WHEN p.id IS NULL THEN 'unknown player' END AS skip FROM lu JOIN matches m ON m.fixture_id = fixture_external_id AND m.status = 'finished'
    JOIN teams t ON t.e = team_external_id LEFT JOIN players p ON p.e = player_external_id"""),
)
def lineup_resolution(spark, folder):
    """Slots of resolved lineups; an unknown player loses only its slot."""
    _, _, teams, players, fixtures = stored_dims(spark, folder)
    return In.resolve_lineups(P.split_rejects(P.lineups(lineup_pages(spark, folder)))[0], fixtures, teams, players)[1]


@query(
    "j3_lineup_sides",
    "i:fixture_external_id,team_external_id b:is_home s:skip",
    with_sql(MATCHES, DIMS, _LU, answer="""SELECT DISTINCT fixture_external_id, team_external_id, CASE WHEN m.fixture_id IS NOT NULL AND t.id IS NOT NULL THEN lu.is_home END AS is_home,
    CASE WHEN m.fixture_id IS NULL THEN 'unknown match' WHEN t.id IS NULL THEN 'unknown team' END AS skip FROM lu
    LEFT JOIN matches m ON m.fixture_id = fixture_external_id AND m.status = 'finished' LEFT JOIN teams t ON t.e = team_external_id"""),
)
def lineup_sides(spark, folder):
    """Lineups with the side read from the stored match."""
    _, _, teams, players, fixtures = stored_dims(spark, folder)
    return In.resolve_lineups(P.split_rejects(P.lineups(lineup_pages(spark, folder)))[0], fixtures, teams, players)[0]


def stored_players(spark, folder):
    c = T.table(spark, folder, "customer").where("c_acctbal >= 0")
    return c.select(
        F.col("c_custkey").alias("external_id"), (F.col("c_custkey") + OFFSET).alias("id"), F.lit("old name").alias("name"), F.lit(None).cast("string").alias("photo"),
        F.lit("old").alias("nationality"), F.lit(None).cast("date").alias("birth_date"), F.lit(150).alias("height_cm"), F.lit(50).alias("weight_kg"), F.lit("FW").alias("position"),
    )


@query(
    "j4_player_statistics_resolution",
    "i:player_external_id,player_id,competition_id,goals,team_id s:skip",
    with_sql(DIMS.replace("teams AS (SELECT DISTINCT home_team_id AS e, home_team_id + 10000 AS id FROM matches WHERE home_goals = 4),", ""), _PS, answer="""SELECT c.c_custkey AS player_external_id, CASE WHEN p.id IS NOT NULL THEN p.id ELSE (SELECT max(id) FROM players) + row_number() OVER (PARTITION BY p.id IS NULL ORDER BY c.c_custkey) END AS player_id,
    CASE WHEN ps.goals IS NOT NULL THEN k.id END AS competition_id, ps.goals, 7 AS team_id, CASE WHEN ps.goals IS NULL THEN 'no statistics' END AS skip FROM customer c LEFT JOIN players p ON p.e = c.c_custkey
    LEFT JOIN ps ON ps.player_external_id = c.c_custkey LEFT JOIN comps k ON k.e = 3"""),
)
def player_stat_resolution(spark, folder):
    """Statistics linked to the internal ids of the upserted players, new players' included."""
    comps, seasons, _, _, _ = stored_dims(spark, folder)
    staged = P.split_rejects(P.players(pages(player_payload(spark, folder), "c_custkey")))[0]
    stats = P.player_statistics(player_stat_pages(spark, folder))
    return In.resolve_player_statistics(staged, stats, stored_players(spark, folder), F.lit(7).cast("long"), comps, seasons)[1]


@query(
    "j5_team_statistics_resolution",
    "i:team_external_id,team_id,season_id,fixtures_played D:as_of_date s:skip",
    with_sql(MATCHES, DIMS, _TS, answer="""SELECT team_external_id, t.id AS team_id, CASE WHEN c.id IS NOT NULL THEN 1998 + competition_external_id * 10000 END AS season_id, fixtures_played,
    DATE '1999-02-02' AS as_of_date, CASE WHEN t.id IS NULL OR c.id IS NULL THEN 'unknown team or season' END AS skip
    FROM ts LEFT JOIN teams t ON t.e = team_external_id LEFT JOIN comps c ON c.e = competition_external_id"""),
)
def team_stat_resolution(spark, folder):
    """Team totals resolved and stamped with the pull date."""
    comps, seasons, teams, _, _ = stored_dims(spark, folder)
    return In.resolve_team_statistics(P.team_statistics(team_stat_payload(spark, folder)), teams, comps, seasons, "1999-02-02")


_KNOWN = "known AS (SELECT s_suppkey AS e, s_suppkey + 10000 AS id FROM supplier WHERE s_acctbal >= 0)"


def known_leagues(spark, folder):
    return T.table(spark, folder, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("external_id"), (F.col("s_suppkey") + OFFSET).alias("id"))


@query(
    "j6_p19_season_resolution",
    "i:competition_external_id,competition_id,year b:is_current s:skip",
    with_sql(SEASONS, _KNOWN, answer="""SELECT competition_external_id, id AS competition_id, year, is_current AND year = 2004 AS is_current,
    CASE WHEN id IS NULL THEN 'unknown competition' END AS skip FROM listed LEFT JOIN known ON e = competition_external_id"""),
)
def season_resolution(spark, folder):
    """Seasons of known competitions; current only where flagged and configured."""
    staged = P.split_rejects(P.seasons(league_payload(spark, folder)))[0]
    return In.resolve_seasons(staged, known_leagues(spark, folder), 2004)


@query(
    "p18_season_year_resolution",
    "i:competition_external_id,season_year",
    with_sql(SEASONS, answer="SELECT competition_external_id, coalesce(max(CASE WHEN is_current AND competition_external_id % 3 <> 0 THEN year END), max(year)) AS season_year FROM listed GROUP BY 1"),
)
def season_year(spark, folder):
    """Target year per competition: configured if stored, else current, else last listed."""
    staged = P.split_rejects(P.seasons(league_payload(spark, folder)))[0]
    listed = staged.withColumn("position", F.col("year")).withColumn("is_current", F.col("is_current") & (F.col("competition_external_id") % 3 != 0))
    return In.season_year(listed, stored_dims(spark, folder)[1], 2050)


# --- upserts --------------------------------------------------------------------------------


@query(
    "u1_upsert_overwrite",
    "i:external_id,founded s:name,country,_outcome",
    """SELECT coalesce(t.k, u.c_custkey) AS external_id, CASE WHEN u.c_custkey IS NOT NULL THEN u.founded ELSE 1900 END AS founded,
    coalesce(u.c_name, 'old name') AS name, CASE WHEN u.c_custkey IS NOT NULL THEN u.n_name ELSE 'old' END AS country,
    CASE WHEN t.k IS NULL THEN 'inserted' WHEN u.c_custkey IS NULL THEN 'untouched' ELSE 'updated' END AS _outcome
    FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 0) t FULL JOIN
    (SELECT c_custkey, c_name, n_name, CASE WHEN c_custkey % 3 < 2 THEN 1850 + c_custkey % 100 END AS founded FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 <> 7) u ON u.c_custkey = t.k""",
)
def upsert_overwrite(spark, folder):
    """Teams: every mutable column takes the new value, even NULL."""
    stored = T.table(spark, folder, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("external_id"), F.lit("old name").alias("name"), F.lit("old").alias("country"), F.lit(1900).alias("founded"))
    new = P.split_rejects(P.teams(team_payload(spark, folder)))[0]
    return U.merge_upsert(stored, new, ["external_id"], U.all_columns(stored, ["external_id"]), "landing")


def stored_matches(spark, folder):
    """Matches known so far: all but the urgent orders; some already carry a result."""
    o = T.table(spark, folder, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("fixture_id"), "o_orderpriority")
    m = T.matches(spark, folder).join(o, "fixture_id")
    done = F.col("o_orderpriority") == "5-LOW"
    return m.select(
        F.col("fixture_id").alias("external_id"), "competition_id", "season_id", "home_team_id", "away_team_id", F.date_sub("kickoff", 1).cast("timestamp").alias("kickoff_time"),
        F.lit(None).cast("int").alias("matchday"), F.lit("old ground").alias("venue"), F.when(done, "finished").otherwise("scheduled").alias("status"),
        F.when(done, 9).cast("long").alias("home_goals"), F.when(done, 9).cast("long").alias("away_goals"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("timestamp").alias("synced_at"),
    )


STAMP = "2002-01-01 00:00:00"
_UP = f"""
st AS (SELECT m.*, o.o_orderpriority = '5-LOW' AS done FROM matches m JOIN orders o ON o.o_orderkey = m.fixture_id WHERE o.o_orderpriority <> '1-URGENT'),
up AS ({_STAGED_OK}),
res AS (SELECT coalesce(st.fixture_id, up.external_id) AS external_id, coalesce(st.home_team_id, up.home_team_external_id) AS home_team_id,
  coalesce(up.kickoff_time, CAST(CAST(st.kickoff AS DATE) - 1 AS TIMESTAMP)) AS kickoff_time, up.matchday,
  CASE WHEN up.external_id IS NULL THEN 'old ground' ELSE 'Ground ' || up.home_team_external_id END AS venue,
  coalesce(up.status, CASE WHEN st.done THEN 'finished' ELSE 'scheduled' END) AS status,
  CASE WHEN st.done THEN 9 WHEN up.status = 'finished' THEN coalesce(up.home_goals, 0) END AS home_goals,
  CASE WHEN st.done THEN 9 WHEN up.status = 'finished' THEN coalesce(up.away_goals, 0) END AS away_goals,
  CASE WHEN st.done IS DISTINCT FROM TRUE AND up.status = 'finished' THEN TIMESTAMP '{STAMP}' END AS finished_at,
  CASE WHEN st.fixture_id IS NULL AND up.status <> 'finished' THEN 'inserted' WHEN up.external_id IS NULL THEN 'untouched' ELSE 'updated' END AS _outcome
  FROM st FULL JOIN up ON up.external_id = st.fixture_id)"""


def match_updates(spark, folder):
    ok = P.split_rejects(staged_a(spark, folder))[0]
    return ok.select(
        "external_id", F.col("competition_external_id").alias("competition_id"), F.col("season_year").alias("season_id"), F.col("home_team_external_id").alias("home_team_id"),
        F.col("away_team_external_id").alias("away_team_id"), "kickoff_time", "matchday", "venue", "status", "home_goals", "away_goals", "landing",
    )


@query(
    "u2_u3_upsert_matches_and_results",
    "i:external_id,home_team_id,matchday,home_goals,away_goals s:venue,status,_outcome t:kickoff_time,finished_at",
    with_sql(MATCHES, STAGED_A, _UP, answer="SELECT * FROM res"),
)
def upsert_matches(spark, folder):
    """Mutable columns overwritten, identity kept, results stamped once, stored goals never changed."""
    target = U.bucketed(stored_matches(spark, folder), ["external_id"], 8, scratch_path(spark, "bucketed"))
    return U.upsert_matches(target, match_updates(spark, folder), STAMP)


@query(
    "u2_u3_repeated_keys_in_landing_order",
    "i:external_id,home_team_id,matchday,home_goals,away_goals s:venue,status t:kickoff_time,finished_at",
    with_sql(MATCHES, STAGED_A, _UP, answer="""SELECT external_id, home_team_id, kickoff_time, matchday, home_goals, away_goals, finished_at,
    CASE WHEN external_id % 6 = 0 AND external_id IN (SELECT external_id FROM up) THEN 'late ground' ELSE venue END AS venue,
    CASE WHEN external_id % 6 = 0 AND external_id IN (SELECT external_id FROM up) THEN 'in_play' ELSE status END AS status FROM res"""),
)
def repeated_keys(spark, folder):
    """Several updates of one match: first a later kickoff without a result, then the update, then another status."""
    new = match_updates(spark, folder)
    shifted = lambda pages: F.struct((F.col("landing.page") + pages).alias("page"), F.col("landing.pos").alias("pos"))
    goals = {c: F.lit(None).cast("long") for c in ("home_goals", "away_goals")}
    early = new.where("external_id % 4 = 0").withColumns({"landing": shifted(-1_000_000), "kickoff_time": F.expr("kickoff_time + interval 7 days"), "status": F.lit("scheduled"), **goals})
    late = new.where("external_id % 6 = 0").withColumns({"landing": shifted(1_000_000), "venue": F.lit("late ground"), "status": F.lit("in_play"), **goals})
    return U.upsert_matches(stored_matches(spark, folder), early.unionByName(new).unionByName(late), STAMP)


@query(
    "a20_ingest_counters",
    "s:job i:requested,received,inserted,updated,skipped,failed",
    with_sql(MATCHES, STAGED_A, _UP, DIMS, """
    sk AS (SELECT up.*, c.id IS NULL OR season_year >= 2001 OR h.id IS NULL OR a.id IS NULL AS skip, st.fixture_id IS NULL AND up.status <> 'finished' AS fresh FROM up
      LEFT JOIN comps c ON c.e = competition_external_id LEFT JOIN teams h ON h.e = home_team_external_id LEFT JOIN teams a ON a.e = away_team_external_id
      LEFT JOIN st ON st.fixture_id = up.external_id)""",
             answer="""SELECT 'sync_matches' AS job, 5 AS requested, count(*) + (SELECT count(*) FROM staged WHERE reject IS NOT NULL) AS received,
    sum(CASE WHEN NOT skip AND fresh THEN 1 ELSE 0 END) AS inserted, sum(CASE WHEN NOT skip AND NOT fresh THEN 1 ELSE 0 END) AS updated, sum(CASE WHEN skip THEN 1 ELSE 0 END) AS skipped,
    (SELECT count(*) FROM staged WHERE reject IS NOT NULL) AS failed FROM sk"""),
)
def ingest_counters(spark, folder):
    """Counters of one match pass: resolve, upsert, and count what was skipped or failed."""
    comps, seasons, teams, _, _ = stored_dims(spark, folder)
    ok, bad = P.split_rejects(staged_a(spark, folder))
    merged, skipped = In.ingest_matches(ok, stored_matches(spark, folder), teams, comps, seasons, STAMP)
    return In.counters("sync_matches", merged, 5, bad, skipped)


@query(
    "u4_upsert_fill_only",
    "i:external_id,height_cm,weight_kg s:name,nationality,position,_outcome",
    with_sql(_PL, answer="""SELECT p.external_id, CASE WHEN c.c_acctbal >= 0 THEN coalesce(height_cm, 150) ELSE height_cm END AS height_cm,
    CASE WHEN c.c_acctbal >= 0 THEN coalesce(weight_kg, 50) ELSE weight_kg END AS weight_kg, name, nationality,
    CASE WHEN c.c_acctbal >= 0 THEN coalesce(position, 'FW') ELSE position END AS position, CASE WHEN c.c_acctbal >= 0 THEN 'updated' ELSE 'inserted' END AS _outcome
    FROM pl p JOIN customer c ON c.c_custkey = p.external_id"""),
)
def upsert_fill(spark, folder):
    """Players: the name always, other columns only where the update knows them."""
    staged = P.split_rejects(P.players(pages(player_payload(spark, folder), "c_custkey")))[0]
    return U.merge_upsert(stored_players(spark, folder), staged, ["external_id"], U.PLAYER_POLICY, "landing")


@query(
    "u5_upsert_composite_key",
    "i:team_id,season_id,n s:_outcome D:as_of_date",
    with_sql(MATCHES, """x AS (SELECT m.home_team_id AS team_id, m.season_id, CAST(l.l_shipdate AS DATE) AS as_of_date,
    sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END) AS a FROM lineitem l JOIN matches m ON m.fixture_id = l.l_orderkey GROUP BY 1, 2, 3)""",
             answer="SELECT team_id, season_id, as_of_date, CASE WHEN a > 0 THEN a ELSE r END AS n, CASE WHEN r > 0 AND a > 0 THEN 'updated' WHEN a > 0 THEN 'inserted' ELSE 'untouched' END AS _outcome FROM x WHERE a > 0 OR r > 0"),
)
def upsert_composite(spark, folder):
    """Snapshots under a composite key: accepted rows replace returned ones."""
    li = T.table(spark, folder, "lineitem")
    m = T.matches(spark, folder).select("fixture_id", F.col("home_team_id").alias("team_id"), "season_id")
    x = li.join(m, li.l_orderkey == m.fixture_id).withColumn("as_of_date", F.to_date("l_shipdate"))
    keys = ["team_id", "season_id", "as_of_date"]
    old = x.where("l_returnflag = 'R'").groupBy(*keys).agg(F.count("*").alias("n"))
    new = x.where("l_returnflag = 'A'").groupBy(*keys).agg(F.count("*").alias("n"))
    return U.merge_upsert(old, new, keys, {"n": "overwrite"}, "as_of_date")


@query(
    "u6_replace_children",
    "i:fixture_id,player_id",
    "SELECT l_orderkey AS fixture_id, l_partkey AS player_id FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT l_orderkey, l_partkey + 1000000 FROM lineitem WHERE l_returnflag = 'R'",
)
def replace_children(spark, folder):
    """Slots of lineups that came again are replaced, all others stay."""
    li = T.table(spark, folder, "lineitem")
    old = li.select(F.col("l_orderkey").alias("fixture_id"), F.col("l_partkey").alias("player_id"))
    fresh = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("fixture_id"), (F.col("l_partkey") + 1000000).alias("player_id"))
    return U.replace_children(old, fresh, fresh, ["fixture_id"])


_LINES = """lines AS (SELECT l_orderkey AS fixture_id, l_linenumber AS shirt_number, l_partkey AS player_id FROM lineitem)"""


def _lineups(spark, folder):
    """Stored lineups of orders not divisible by 5, and updates: no list for a third, an empty one for some, else other players."""
    li = T.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("fixture_id"), F.col("l_linenumber").alias("shirt_number"), F.col("l_partkey").alias("player_id"))
    slots = li.where("fixture_id % 5 <> 0")
    parents = slots.select("fixture_id").distinct().withColumn("formation", F.lit("old"))
    listed = li.groupBy("fixture_id").agg(F.collect_list(F.struct("shirt_number", (F.col("player_id") + 1).alias("player_id"))).alias("p"))
    none = F.lit(None).cast("array<struct<shirt_number:bigint,player_id:bigint>>")
    players = F.when(F.col("fixture_id") % 3 == 0, none).when(F.col("fixture_id") % 7 == 0, F.array().cast("array<struct<shirt_number:bigint,player_id:bigint>>")).otherwise(F.col("p").cast("array<struct<shirt_number:bigint,player_id:bigint>>"))
    updates = listed.where("fixture_id % 2 = 0").select("fixture_id", F.lit("4-4-2").alias("formation"), players.alias("players"), F.lit(1).alias("landing"))
    return U.upsert_lineups(parents, slots.select("fixture_id", F.col("shirt_number").cast("long"), "player_id"), updates, ["fixture_id"], "landing")


@query(
    "u6_lineup_rows",
    "i:fixture_id s:formation,_outcome",
    """SELECT DISTINCT l_orderkey AS fixture_id, CASE WHEN l_orderkey % 2 = 0 THEN '4-4-2' ELSE 'old' END AS formation,
    CASE WHEN l_orderkey % 2 = 0 AND l_orderkey % 5 <> 0 THEN 'updated' WHEN l_orderkey % 2 = 0 THEN 'inserted' ELSE 'untouched' END AS _outcome FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 5 <> 0""",
)
def lineup_parents(spark, folder):
    """Lineups inserted and overwritten."""
    return _lineups(spark, folder)[0]


@query(
    "u6_lineup_slots",
    "i:fixture_id,shirt_number,player_id",
    with_sql(_LINES, answer="""SELECT fixture_id, shirt_number, CASE WHEN fixture_id % 2 = 0 AND fixture_id % 3 <> 0 THEN player_id + 1 ELSE player_id END AS player_id FROM lines
    WHERE CASE WHEN fixture_id % 2 <> 0 OR fixture_id % 3 = 0 THEN fixture_id % 5 <> 0 ELSE fixture_id % 7 <> 0 END"""),
)
def lineup_slots(spark, folder):
    """Slots replaced by the update's list, removed by an empty one, and kept where the list is missing."""
    return _lineups(spark, folder)[1]


@query(
    "u5_upsert_injuries",
    "i:external_id,fixture_id s:type,status,_outcome D:start_date",
    with_sql(_IN, answer="""SELECT external_id, CASE WHEN external_id % 2 = 0 THEN -1 ELSE fixture_external_id END AS fixture_id, type, status, CASE WHEN external_id % 2 = 0 THEN DATE '1999-09-09' ELSE start_date END AS start_date,
    CASE WHEN external_id % 2 = 0 THEN 'updated' ELSE 'inserted' END AS _outcome FROM ip""".replace("CASE WHEN external_id % 2 = 0 THEN -1 ELSE fixture_external_id END", "fixture_external_id")),
)
def upsert_injuries(spark, folder):
    """Injuries: the policy's columns are overwritten, even by NULL, and the start date stays as first stored."""
    new = P.split_rejects(P.injuries(injury_payload(spark, folder)))[0].withColumn("fixture_id", F.col("fixture_external_id"))
    old = new.where("external_id % 2 = 0").select("external_id", F.lit(-1).cast("long").alias("fixture_id"), F.lit("old").alias("type"), F.lit("old").alias("status"), F.lit("1999-09-09").cast("date").alias("start_date"))
    return U.merge_upsert(old, new, ["external_id"], U.INJURY_POLICY, "landing")


@query(
    "j6_team_ingest",
    "i:external_id,id s:name,_outcome",
    with_sql(DIMS.replace("teams AS (SELECT DISTINCT home_team_id AS e, home_team_id + 10000 AS id FROM matches WHERE home_goals = 4),", ""), """
    known AS (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 50 <> 7 AND c_custkey % 7 IN (SELECT e FROM comps) AND 1995 + c_custkey % 9 < 2001),
    old AS (SELECT c_custkey AS k, c_custkey + 10000 AS id FROM customer WHERE c_acctbal >= 0)""",
             answer="""SELECT coalesce(old.k, known.k) AS external_id, coalesce(id, (SELECT max(id) FROM old) + row_number() OVER (PARTITION BY id IS NULL ORDER BY known.k)) AS id,
    coalesce(c_name, 'old') AS name, CASE WHEN old.k IS NULL THEN 'inserted' WHEN known.k IS NULL THEN 'untouched' ELSE 'updated' END AS _outcome FROM old FULL JOIN known ON known.k = old.k"""),
)
def team_ingest(spark, folder):
    """Teams of league seasons: listed twice they are one row, new ones get ids."""
    return _team_ingest(spark, folder)[0]


def _team_ingest(spark, folder):
    comps, _, _, players, _ = stored_dims(spark, folder)
    seasons = comps.select(F.col("id").alias("competition_id")).crossJoin(spark.range(1995, 2001).select(F.col("id").alias("external_id"), (F.col("id") * 10).alias("id")))
    rows = P.split_rejects(P.teams(team_payload(spark, folder)))[0]
    listed = rows.withColumns({"competition_external_id": F.col("external_id") % 7, "season_external_id": 1995 + F.col("external_id") % 9})
    again = listed.withColumns({"name": F.lit("earlier name"), "landing": F.struct((F.col("landing.page") - 1_000_000).alias("page"), F.col("landing.pos").alias("pos"))})
    old = players.select("external_id", "id", F.lit("old").alias("name"))
    return In.ingest_teams(listed.unionByName(again), old, comps, seasons, {"name": "overwrite"})


@query(
    "j6_team_ingest_counters",
    "i:inserted,updated,skipped,failed",
    with_sql(DIMS.replace("teams AS (SELECT DISTINCT home_team_id AS e, home_team_id + 10000 AS id FROM matches WHERE home_goals = 4),", ""), """
    t AS (SELECT c_custkey, c_acctbal >= 0 AS stored, c_custkey % 7 IN (SELECT e FROM comps) AS league, 1995 + c_custkey % 9 < 2001 AS season FROM customer WHERE c_custkey % 50 <> 7)""",
             answer="""SELECT count(*) FILTER (league AND season AND NOT stored) AS inserted, count(*) FILTER (league AND season AND stored) AS updated,
    2 * count(*) FILTER (league AND NOT season) AS skipped, 2 * count(*) FILTER (NOT league) AS failed FROM t"""),
)
def team_ingest_counters(spark, folder):
    """An unknown league fails its rows, a season that is not stored skips them; every listing counts."""
    merged, skipped, failed = _team_ingest(spark, folder)
    return In.counters("sync_teams", merged, 1, failed, skipped)


@query(
    "u7_s19_append_new_only",
    "i:prediction_id",
    with_sql(*EVAL_CTES, answer="SELECT prediction_id FROM stored WHERE prediction_id NOT IN (SELECT prediction_id FROM done)"),
)
def append_new(spark, folder):
    """Predictions whose key is not stored yet; a second write is a no-op."""
    all_rows = stored_predictions(spark, folder).select("prediction_id")
    have = done_outcomes(spark, folder).select("prediction_id")
    return U.append_new(have, all_rows, ["prediction_id"])


@query(
    "u7_insert_only_conflict",
    "i:accepted b:conflict_raised",
    with_sql(*EVAL_CTES, answer="SELECT count(*) AS accepted, TRUE AS conflict_raised FROM stored WHERE prediction_id NOT IN (SELECT prediction_id FROM done)"),
)
def insert_only(spark, folder):
    """Insert-only table: new keys pass, an existing key raises."""
    rows = stored_predictions(spark, folder).select("prediction_id")
    have = done_outcomes(spark, folder).select("prediction_id")
    fresh = U.insert_only(have, U.append_new(have, rows, ["prediction_id"]), ["prediction_id"])
    try:
        U.insert_only(have, rows, ["prediction_id"])
        raised = False
    except ValueError:
        raised = True
    return fresh.agg(F.count("*").alias("accepted"), F.lit(raised).alias("conflict_raised"))


@query(
    "u8_activate_version",
    "i:id s:name b:is_active",
    "SELECT c_custkey AS id, c_mktsegment AS name, CASE WHEN c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 42) THEN c_custkey = 42 ELSE c_acctbal > 5000 END AS is_active FROM customer",
)
def activate(spark, folder):
    """One version on, its siblings of the same name off, others as they were."""
    v = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), (F.col("c_acctbal") > 5000).alias("is_active"))
    return U.activate(v, 42)


@query(
    "u9_table_expectations",
    "s:table_name,rule i:violations",
    with_sql(MATCHES, answer="""SELECT 'matches' AS table_name, 'paired_goals' AS rule, 0 AS violations FROM (SELECT 1) UNION ALL
    SELECT 'matches', 'status_known', 0 UNION ALL SELECT 'matches', 'season_after_1996', (SELECT count(*) FROM matches WHERE season_id <= 1996) UNION ALL
    SELECT 'matches', 'unique(fixture_id)', 0 UNION ALL
    SELECT 'matches', 'unique(competition_id, home_team_id, kickoff)', (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT competition_id, home_team_id, kickoff FROM matches)) FROM matches) UNION ALL
    SELECT 'lineitem', 'reference(l_orderkey)', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))"""),
)
def expectations(spark, folder):
    """Value rules, unique keys and references, counted."""
    m = T.matches(spark, folder)
    rules = {
        "paired_goals": F.col("home_goals").isNull() == F.col("away_goals").isNull(),
        "status_known": F.col("status").isin(*N.MATCH_STATUSES),
        "season_after_1996": F.col("season_id") > 1996,
    }
    return Ex.report(
        [
            Ex.check_rules(m, "matches", rules),
            Ex.check_unique(m, "matches", ["fixture_id"]),
            Ex.check_unique(m, "matches", ["competition_id", "home_team_id", "kickoff"]),
            Ex.check_reference(T.table(spark, folder, "lineitem"), "lineitem", "l_orderkey", T.table(spark, folder, "orders").where("o_orderstatus <> 'P'"), "o_orderkey"),
        ]
    )


@query(
    "u10_late_explanations",
    "i:prediction_id s:summary",
    with_sql(*EVAL_CTES, answer="SELECT prediction_id, 'late' AS summary FROM stored WHERE p_draw > 0.3 AND prediction_id NOT IN (SELECT prediction_id FROM stored WHERE p_home_win > 0.4)"),
)
def explanations(spark, folder):
    """Late explanation rows, one per prediction, for predictions that have none."""
    p = stored_predictions(spark, folder)
    have = p.where(F.col("p_home_win") > 0.4).select("prediction_id")
    late = p.where(F.col("p_draw") > 0.3).select("prediction_id", F.lit("late").alias("summary"))
    return U.append_new(have, late, ["prediction_id"])


_BOOT = f"""
lg AS (SELECT s_suppkey AS k, s_acctbal >= 0 AS old FROM supplier),
sn AS (SELECT k, k % 10 + 2000 + i AS year, old AND i = 0 AS old FROM lg CROSS JOIN range(0, 3) r(i)),
tm AS (SELECT c_custkey AS k, c_acctbal >= 0 AS old, c_custkey % 50 = 7 AS bad, 1 + c_custkey % 13 IN (SELECT k FROM lg) AS league, c_custkey % 4 < 3 AS season FROM customer),
known AS (SELECT k FROM tm WHERE old OR (NOT bad AND league AND season)),
boot_up AS (SELECT *, competition_external_id IN (SELECT k FROM lg) AND external_id % 4 < 3 AND home_team_external_id IN (SELECT k FROM known) AND away_team_external_id IN (SELECT k FROM known) AS ok
  FROM staged WHERE reject IS NULL),
boot_st AS (SELECT m.fixture_id FROM matches m JOIN orders o ON o.o_orderkey = m.fixture_id WHERE o.o_orderpriority <> '1-URGENT'),
boot_ts AS (SELECT k IN (SELECT k FROM known) AND k % 5 IN (SELECT k FROM lg) AND k % 4 < 3 AS ok FROM ({_CUST})),
stages AS (
  SELECT 1 AS nr, 'competitions_seasons' AS job, (SELECT count(*) FROM lg) + (SELECT count(*) FROM sn) AS received,
    (SELECT count(*) FROM lg WHERE NOT old) + (SELECT count(*) FROM sn WHERE NOT old) AS inserted, (SELECT count(*) FROM lg WHERE old) + (SELECT count(*) FROM sn WHERE old) AS updated, 0 AS skipped, 0 AS failed
  UNION ALL SELECT 2, 'teams', count(*), count(*) FILTER (NOT bad AND league AND season AND NOT old), count(*) FILTER (NOT bad AND league AND season AND old),
    count(*) FILTER (NOT bad AND league AND NOT season), count(*) FILTER (bad OR NOT league) FROM tm
  UNION ALL SELECT 3, 'matches', (SELECT count(*) FROM staged), count(*) FILTER (ok AND st.fixture_id IS NULL AND status <> 'finished'),
    count(*) FILTER (ok AND NOT (st.fixture_id IS NULL AND status <> 'finished')), count(*) FILTER (NOT ok), (SELECT count(*) FROM staged WHERE reject IS NOT NULL)
    FROM boot_up LEFT JOIN boot_st st ON st.fixture_id = boot_up.external_id
  UNION ALL SELECT 4, 'team_statistics', count(*), count(*) FILTER (ok), 0, count(*) FILTER (NOT ok), 0 FROM boot_ts)"""


@query(
    "u11_bootstrap_counters",
    "s:job i:requested,received,inserted,updated,skipped,failed",
    with_sql(MATCHES, STAGED_A, _BOOT, answer="""SELECT job, (SELECT count(*) FROM lg) AS requested, received, inserted, updated, skipped, failed FROM stages
    UNION ALL SELECT 'full_bootstrap', 4 * (SELECT count(*) FROM lg), sum(received), sum(inserted), sum(updated), sum(skipped), sum(failed) FROM stages"""),
)
def bootstrap(spark, folder):
    """Leagues with their seasons, teams, matches and team statistics in order, each stage on what the earlier ones stored."""
    page, year = league_payload(spark, folder), F.col("competition_external_id") % 10 + 2000
    teams_ok, teams_bad = In.staged_once(P.teams(team_payload(spark, folder)), "teams")
    league = (1 + F.col("external_id") % 13).alias("competition_external_id")
    listed = teams_ok.select("*", league).withColumn("season_external_id", year + F.col("external_id") % 4)
    games_ok, games_bad = In.staged_once(staged_a(spark, folder), "matches")
    games = games_ok.withColumn("season_year", year + F.col("external_id") % 4)
    totals = materialise(P.team_statistics(team_stat_payload(spark, folder)), "staged-team-statistics").withColumn("season_external_id", year + F.col("team_external_id") % 4)
    staged = {
        "competitions": In.staged_once(P.competitions(page), "competitions"),
        "seasons": In.staged_once(P.seasons(page), "seasons"),
        "teams": (listed, teams_bad),
        "matches": (games, games_bad),
        "team_statistics": (totals, totals.limit(0)),
    }
    known = T.table(spark, folder, "supplier").where("s_acctbal >= 0")
    old = T.table(spark, folder, "customer").where("c_acctbal >= 0")
    key = F.col("s_suppkey")
    stored = {
        "competitions": known.select(key.alias("external_id"), (key + OFFSET).alias("id"), F.lit("old").alias("name")),
        "seasons": known.select((key + OFFSET).alias("competition_id"), (key % 10 + 2000).alias("year"), (key % 10 + 2000).alias("external_id"), (key + 2 * OFFSET).alias("id"), F.lit(False).alias("is_current")),
        "teams": old.select(F.col("c_custkey").alias("external_id"), (F.col("c_custkey") + OFFSET).alias("id"), F.lit("old").alias("name")),
        "matches": stored_matches(spark, folder),
        "team_statistics": spark.createDataFrame([], "team_id long, competition_id long, season_id long, as_of_date date, fixtures_played long, goals_for long"),
    }
    return In.bootstrap(staged, stored, T.table(spark, folder, "supplier").count(), 2004, STAMP)[1]


# --- run tables -----------------------------------------------------------------------------


@query(
    "s18_run_tables_write_once",
    "s:run_id i:fold_id,n_predictions",
    with_sql(MATCHES, FIN, PREDICTIONS, answer="SELECT 'run-' || model_version_id AS run_id, f.season_id AS fold_id, count(*) AS n_predictions FROM predictions p JOIN fin f USING (fixture_id) GROUP BY 1, 2"),
)
def run_tables(spark, folder):
    """Fold metrics appended twice are stored once."""
    store = R.RunStore(spark, scratch_path(spark, "runs"))
    m = fold_metrics(spark, folder)
    store.save("fold_metrics", m)
    store.save("fold_metrics", m)
    return store.load("fold_metrics")


@query(
    "s19_published_predictions",
    "i:fixture_id s:model_name,model_version d:p_home_win",
    with_sql(MATCHES, FIN, PREDICTIONS, answer="SELECT fixture_id, 'weights' AS model_name, 'v' || model_version_id AS model_version, p_home_win FROM predictions"),
)
def published(spark, folder):
    """Published predictions: a second write with other values changes nothing."""
    p = T.predictions(spark, folder).select(F.lit("weights").alias("model_name"), F.concat(F.lit("v"), F.col("model_version_id")).alias("model_version"), "fixture_id", "p_home_win")
    path = scratch_path(spark, "published")
    R.publish_predictions(p, path)
    R.publish_predictions(p.withColumn("p_home_win", F.lit(0.0)), path)
    return spark.read.parquet(path)


@query(
    "s21_comparison_file",
    "s:model_name,model_version i:n_folds,total_n_predictions",
    with_sql(MATCHES, FIN, PREDICTIONS, answer="SELECT 'weights' AS model_name, 'v' || model_version_id AS model_version, count(DISTINCT f.season_id) AS n_folds, count(*) AS total_n_predictions FROM predictions p JOIN fin f USING (fixture_id) GROUP BY model_version_id"),
)
def comparison_file(spark, folder):
    """The comparison written with its fourteen columns and read back."""
    folds = fold_metrics(spark, folder)
    runs = folds.select("run_id", F.lit("weights").alias("model_name"), F.concat(F.lit("v"), F.col("model_version_id")).alias("model_version"), F.lit("d1").alias("dataset_version"), F.lit("{}").alias("iterator_params")).distinct()
    path = scratch_path(spark, "comparison")
    R.save_comparison(Mx.compare_runs(folds, runs), path)
    return spark.read.option("header", True).csv(path)


@query(
    "s22_run_identity",
    "i:custkey s:run_id",
    """SELECT c_custkey AS custkey, substr(sha256('{"dataset_version": "d1", "iterator_params": {"gap_days": 1}, "model_name": "elo_baseline", "model_version": "' || c_name || '", "seed": ' || c_custkey || '}'), 1, 16) AS run_id FROM customer""",
)
def run_identity(spark, folder):
    """Run ids over versions and seeds: a column expression that equals the driver-side function."""
    c = T.table(spark, folder, "customer")
    text = F.concat(
        F.lit('{"dataset_version": "d1", "iterator_params": {"gap_days": 1}, "model_name": "elo_baseline", "model_version": "'), F.col("c_name"), F.lit('", "seed": '), F.col("c_custkey"), F.lit("}")
    )
    first = c.orderBy("c_custkey").first()
    same = R.run_id("d1", {"gap_days": 1}, "elo_baseline", first["c_name"], first["c_custkey"])
    out = c.select(F.col("c_custkey").alias("custkey"), F.substring(F.sha2(text, 256), 1, 16).alias("run_id"))
    assert out.where(F.col("custkey") == first["c_custkey"]).first()["run_id"] == same
    return out


# --- streams --------------------------------------------------------------------------------


FILES = 4


def _land(spark, df, period, name):
    """Land rows period by period, FILES files each, so that a trigger of FILES files takes one period.

    The rows are made once, written by period; each period then reads its own part only.
    """
    path = scratch_path(spark, name)
    made = materialise(df.withColumn("_period", period), f"{name}-by-period", by=("_period",))
    periods = sorted(r[0] for r in made.select("_period").distinct().collect())
    for p in periods:
        made.where(F.col("_period") == p).select(*df.columns).repartition(FILES).write.mode("append").parquet(path)
    return path


def _to_parquet(spark, stream, out, mark):
    """Run a stateful stream over all landed files into a Parquet folder."""
    with SI.state_settings(spark):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()


def _match_stream(spark, folder):
    updates = match_updates(spark, folder)
    return SI.landed(spark, _land(spark, updates, F.floor(F.year("kickoff_time") / 3), "landed"), updates.schema, FILES)


@query(
    "r1_streaming_upsert",
    "i:external_id,home_goals,away_goals,matchday s:status,venue b:changed",
    with_sql(MATCHES, STAGED_A, _UP, answer="SELECT *, _outcome <> 'untouched' AS changed FROM res"),
)
def streaming_upsert(spark, folder):
    """Landed updates in several micro-batches give the table that one batch gives; each row tells whether a batch changed it."""
    first = stored_matches(spark, folder)
    table = SI.BucketedTable(spark, scratch_path(spark, "matches"), first.schema, "external_id", 8)
    table.create(first)
    SI.upsert_stream(_match_stream(spark, folder), table, None, scratch_path(spark, "checkpoint"), SI.apply_matches(STAMP)).awaitTermination()
    return table.read().withColumn("changed", F.col("batch_id").isNotNull())


@query(
    "r2_r3_late_results_with_cutoff",
    "i:external_id s:status",
    with_sql(MATCHES, STAGED_A, answer=f"SELECT external_id, status FROM ({_STAGED_OK}) WHERE kickoff_time < TIMESTAMP '2000-01-01 00:00:00'"),
)
def late_results(spark, folder):
    """Each update sent twice: repeats drop inside the look-back, nothing at or after the cutoff enters."""
    updates = materialise(match_updates(spark, folder), "updates")
    twice = updates.unionByName(updates)
    stream = SI.before_cutoff(SI.landed(spark, _land(spark, twice, F.year("kickoff_time"), "landed"), twice.schema, FILES), "2000-01-01 00:00:00")
    out, mark = scratch_path(spark, "settled"), scratch_path(spark, "checkpoint")
    _to_parquet(spark, SI.settle_late(stream), out, mark)
    return spark.read.schema(updates.schema).parquet(out)


@query(
    "r4_streaming_ratings",
    "i:competition_id,season_id,fixture_id b:late d:home_elo,away_elo",
    with_sql(MATCHES, FIN, ELO_CTE, recursive=True, answer="""SELECT f.competition_id, f.season_id, f.fixture_id, FALSE AS late, e.eh AS home_elo, e.ea AS away_elo
    FROM fin f JOIN elo e USING (fixture_id) WHERE f.kickoff < (SELECT max(kickoff) FROM fin) - INTERVAL 6 HOUR"""),
)
def streaming_ratings(spark, folder):
    """Pre-match ratings of a stream of results in kickoff order."""
    p = H.finished(T.matches(spark, folder)).select("fixture_id", *N.LEAGUE, "home_team_id", "away_team_id", "kickoff", "home_goals", "away_goals")
    stream = SI.landed(spark, _land(spark, p, F.col("season_id"), "results"), p.schema, FILES)
    out, mark = scratch_path(spark, "ratings"), scratch_path(spark, "checkpoint")
    _to_parquet(spark, SE.rating_stream(stream), out, mark)
    return spark.read.parquet(out)


@query(
    "r5_streaming_counters",
    "s:job i:n t:window_start",
    """SELECT event_type AS job, date_trunc('day', ts) AS window_start, count(*) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY 1, 2""",
)
def streaming_counters(spark, folder):
    """Events per job and day from a stream, as the watermark closes each day."""
    e = T.table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("job"))
    stream = SI.landed(spark, _land(spark, e, F.weekofyear("ts"), "events"), e.schema, FILES)
    out, mark = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    _to_parquet(spark, SI.tumbling_counts(stream, "ts", "1 day", "job"), out, mark)
    return spark.read.parquet(out)
