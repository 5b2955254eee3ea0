"""Registry of queries with their SQL counterparts, and the derived inputs as SQL text.

A query declares its columns once, as ``"i:a,b d:c s:name"``. The same declaration brings the Spark result
and the SQL result to common types: i bigint, d double with six digits, s text, t timestamp text, D date
text, b 0/1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {
    "i": lambda c: F.col(c).cast("long"),
    "d": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0),
    "s": lambda c: F.col(c).cast("string"),
    "t": lambda c: F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss"),
    "D": lambda c: F.date_format(F.col(c), "yyyy-MM-dd"),
    "b": lambda c: F.col(c).cast("int").cast("long"),
}
_SQL = {
    "i": 'CAST("{c}" AS BIGINT)',
    "d": 'round(CAST("{c}" AS DOUBLE), 6) + 0.0',
    "s": 'CAST("{c}" AS VARCHAR)',
    "t": "strftime(CAST(\"{c}\" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')",
    "D": "strftime(CAST(\"{c}\" AS DATE), '%Y-%m-%d')",
    "b": 'CAST(CAST("{c}" AS INTEGER) AS BIGINT)',
}


def columns(spec: str) -> list[tuple[str, str]]:
    return [(part[0], c) for part in spec.split() for c in part[2:].split(",")]


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``."""
    cols = columns(spec)

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Dates and instants of the derived tables are UTC whatever the session started with.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder).select(*[_SPARK[k](c).alias(c) for k, c in cols])

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            picked = ", ".join(f'{_SQL[k].format(c=c)} AS "{c}"' for k, c in cols)
            head, body = ("", sql) if not sql.lstrip().upper().startswith("WITH") else _split(sql)
            ORACLES[name] = f"{head}SELECT {picked} FROM (\n{body}\n) AS answer"
        return fn

    return register


def _split(sql: str) -> tuple[str, str]:
    """Separate the WITH list from the final SELECT, marked by a line ``--answer``."""
    head, body = sql.split("--answer", 1)
    return head, body.strip()


def with_sql(*ctes: str, answer: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(c.strip() for c in ctes) + f"\n--answer\n{answer.strip()}"


MATCHES = """
matches AS (
  SELECT o_orderkey AS fixture_id,
         o_custkey % 5 AS competition_id,
         CAST(year(o_orderdate) AS BIGINT) AS season_id,
         (o_custkey % 5) * 100 + CAST(floor(o_custkey / 5.0) AS BIGINT) % 20 AS home_team_id,
         (o_custkey % 5) * 100 + (CAST(floor(o_custkey / 5.0) AS BIGINT) + 1 + o_orderkey % 19) % 20 AS away_team_id,
         CAST(o_orderdate + INTERVAL '1' HOUR * CAST(12 + o_orderkey % 10 AS INT) AS TIMESTAMP) AS kickoff,
         CASE WHEN o_orderstatus = 'P' THEN 'scheduled' ELSE 'finished' END AS status,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 5 END AS home_goals,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (CAST(floor(o_totalprice) AS BIGINT) + o_orderkey) % 4 END AS away_goals
  FROM orders)"""
FIN = "fin AS (SELECT * FROM matches WHERE status = 'finished')"
LONG = """
long AS (
  SELECT *, CASE WHEN gf > ga THEN 'W' WHEN gf < ga THEN 'L' ELSE 'D' END AS outcome,
         CASE WHEN gf > ga THEN 3 WHEN gf < ga THEN 0 ELSE 1 END AS points
  FROM (SELECT fixture_id, competition_id, season_id, kickoff, home_team_id AS team_id, away_team_id AS opponent_id,
               TRUE AS is_home, home_goals AS gf, away_goals AS ga FROM fin
        UNION ALL
        SELECT fixture_id, competition_id, season_id, kickoff, away_team_id, home_team_id, FALSE, away_goals, home_goals FROM fin))"""
TEAM_STATS = """
team_stats AS (
  SELECT m.home_team_id AS team_id, m.competition_id, m.season_id, CAST(l.l_shipdate AS DATE) AS as_of_date,
         max(CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE l.l_quantity / 10 END) AS xg,
         max(l.l_discount * 20) AS xga
  FROM lineitem l JOIN matches m ON m.fixture_id = l.l_orderkey
  GROUP BY m.home_team_id, m.competition_id, m.season_id, CAST(l.l_shipdate AS DATE))"""
PREDICTIONS = """
predictions AS (
  SELECT w.*, w.w_h / (w.w_h + w.w_d + w.w_a) AS p_home_win, w.w_d / (w.w_h + w.w_d + w.w_a) AS p_draw,
         w.w_a / (w.w_h + w.w_d + w.w_a) AS p_away_win
  FROM (SELECT m.fixture_id, v.model_version_id, m.kickoff,
          CAST(1 + (m.fixture_id + 3 * v.model_version_id) % 7 AS DOUBLE) AS w_h,
          CAST(1 + (CAST(floor(m.fixture_id / 7.0) AS BIGINT) + v.model_version_id) % 5 AS DOUBLE) AS w_d,
          CAST(1 + (CAST(floor(m.fixture_id / 35.0) AS BIGINT) + 2 * v.model_version_id) % 6 AS DOUBLE) AS w_a
        FROM matches m CROSS JOIN (SELECT CAST(0 AS BIGINT) AS model_version_id UNION ALL SELECT 1 UNION ALL SELECT 2) v) w)"""
