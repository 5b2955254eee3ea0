"""Dataset, folds, models, calibration, backtest and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.base import FIN, MATCHES, PREDICTIONS, query, with_sql
from checks.features import ELO_CTE, EXAMPLE_CTES, EXAMPLES_SELECT, family, played
from checks.scores import BINS, CTES, IN_BIN, forecasts
from touchline.functions import names as N
from touchline.functions import scalars as X
from touchline.operators import features as Fe
from touchline.operators import metrics as Mx
from touchline.plans import backtest as Bt
from touchline.plans import boosting as B
from touchline.plans import calibration as Cal
from touchline.plans import dataset as Ds
from touchline.plans import folds as Fo
from touchline.plans import models as Mo
from touchline.plans import scoring as Sc
from touchline.session import materialise, scratch_path
from touchline.sources import datasets as D
from touchline.sources import runs as R
from touchline.sources import tables as T

EXAMPLES = f"ex AS ({EXAMPLES_SELECT})"


def examples(spark, folder):
    p = played(spark, folder)
    return Fe.build_examples(p, p, T.team_stats(spark, folder))


def share(df, part: float) -> int:
    """A block size that grows with the data."""
    return max(1, int(df.count() * part))


# --- dataset --------------------------------------------------------------------------------

_STORED = {}


def stored(spark, folder):
    """The dataset of a folder, written once per session and read back with its checks."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        path = scratch_path(spark, "dataset")
        m = T.matches(spark, folder)
        leagues, seasons = ([r[0] for r in m.select(c).distinct().orderBy(c).collect()] for c in N.LEAGUE)
        Ds.build_dataset(m, T.team_stats(spark, folder), path, "d1", leagues, seasons, cutoff="2100-01-01 00:00:00")
        _STORED[key] = path
    return _STORED[key]


def rows(spark, folder):
    return D.read_dataset(spark, stored(spark, folder), "d1", verify=False)


_MEAN = [c for c in N.FEATURES if c in N.DOUBLE_FEATURES]


@query(
    "s15_s16_dataset_round_trip",
    "i:fixture_id,competition_id,season_id,home_team_id,away_team_id,home_win,draw,away_win,home_goals,away_goals,"
    + ",".join(c for c in N.FEATURES if c not in N.DOUBLE_FEATURES) + " d:" + ",".join(_MEAN) + " t:kickoff",
    with_sql(*EXAMPLE_CTES, recursive=True, answer=EXAMPLES_SELECT),
)
def dataset_round_trip(spark, folder):
    """Dataset written with its manifest, then read back after version, name, count and digest checks."""
    return D.read_dataset(spark, stored(spark, folder), "d1")


@query(
    "s17_a18_manifest",
    "i:row_count,n_features,n_targets s:dataset_version,feature_definition_version,source_schema_version,competitions,seasons t:start_date,end_date,data_cutoff",
    with_sql(MATCHES, FIN, answer="""SELECT count(*) AS row_count, 66 AS n_features, 5 AS n_targets, 'd1' AS dataset_version, 'fd_v1' AS feature_definition_version,
    'schema_v1' AS source_schema_version, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT competition_id AS c FROM fin)) AS competitions,
    (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT season_id AS c FROM fin)) AS seasons, min(kickoff) AS start_date, max(kickoff) AS end_date,
    TIMESTAMP '2100-01-01 00:00:00' AS data_cutoff FROM fin"""),
)
def manifest(spark, folder):
    """The stored manifest."""
    m = D.read_manifest(spark, stored(spark, folder))
    text = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("competitions", "seasons")}
    return m.withColumns(text).withColumns({"n_features": F.size("feature_names"), "n_targets": F.size("target_names")})


@query("a18_manifest_of_empty_dataset", "i:row_count t:start_date,end_date", "SELECT 0 AS row_count, TIMESTAMP '2020-01-01 00:00:00' AS start_date, TIMESTAMP '1970-01-01 00:00:00' AS end_date")
def empty_manifest(spark, folder):
    """An empty window still gets a manifest: start now, end at the epoch."""
    none = played(spark, folder).where(F.col("kickoff") > F.lit("2100-01-01").cast("timestamp"))
    return D.manifest(none, "d0", "2100-01-01 00:00:00", "0", "2020-01-01 00:00:00")


@query(
    "a19_content_digest",
    "i:row_count b:same_rows_same_digest,other_rows_other_digest",
    with_sql(MATCHES, FIN, answer="SELECT count(*) AS row_count, TRUE AS same_rows_same_digest, TRUE AS other_rows_other_digest FROM fin"),
)
def digest(spark, folder):
    """The digest ignores row order and notices one changed value."""
    df = played(spark, folder)
    other = df.withColumn("home_goals", F.when(F.col("kickoff") == df.agg(F.min("kickoff")).first()[0], F.col("home_goals") + 1).otherwise(F.col("home_goals")))
    a, b, c = (D.content_digest(x).select(F.struct("hash_xor", "hash_sum").alias(n), *(["row_count"] if n == "a" else [])) for x, n in ((df, "a"), (df.repartition(5), "b"), (other, "c")))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").join(c.withColumn("k", F.lit(1)), "k").select(
        "row_count", (F.col("a") == F.col("b")).alias("same_rows_same_digest"), (F.col("a") != F.col("c")).alias("other_rows_other_digest")
    )


@query(
    "s16_csv_round_trip",
    "i:fixture_id,home_points_last_5,home_goals,h2h_sample_size d:home_elo_pre_match,home_xg_season_asof t:kickoff",
    with_sql(*EXAMPLE_CTES, recursive=True, answer=EXAMPLES_SELECT),
)
def csv_round_trip(spark, folder):
    """Ordered CSV export read back with strict types; an empty cell is NULL."""
    path = scratch_path(spark, "csv")
    D.export_csv(rows(spark, folder), path)
    return D.read_csv(spark, path)


@query(
    "p22_missing_count",
    "i:fixture_id,missing d:fraction",
    with_sql(*EXAMPLE_CTES, EXAMPLES, recursive=True, answer="SELECT fixture_id, " + " + ".join(f"CAST({c} IS NULL AS INT)" for c in N.FEATURES)
             + " AS missing, (" + " + ".join(f"CAST({c} IS NULL AS INT)" for c in N.FEATURES) + ") / 66.0 AS fraction FROM ex"),
)
def missing_count(spark, folder):
    """Missing features per row and their share."""
    return rows(spark, folder).select("fixture_id", X.missing_count(N.FEATURES).alias("missing"), (X.missing_count(N.FEATURES) / 66.0).alias("fraction"))


@query(
    "p23_feature_vector",
    "i:fixture_id,size,missing d:elo,goals_mean",
    with_sql(*EXAMPLE_CTES, EXAMPLES, recursive=True, answer="SELECT fixture_id, 66 AS size, " + " + ".join(f"CAST({c} IS NULL AS INT)" for c in N.FEATURES)
             + " AS missing, CAST(CAST(home_elo_pre_match AS FLOAT) AS DOUBLE) AS elo, CAST(CAST(home_goals_for_mean_last_5 AS FLOAT) AS DOUBLE) AS goals_mean FROM ex"),
)
def feature_vector(spark, folder):
    """float32 vector in canonical order; missing is NaN, zero stays zero."""
    v = F.col("v")
    i = {c: F.lit(N.FEATURES.index(c)) for c in ("home_elo_pre_match", "home_goals_for_mean_last_5")}
    return rows(spark, folder).select("fixture_id", X.feature_vector(N.FEATURES).alias("v")).select(
        "fixture_id",
        F.size("v").alias("size"),
        F.size(F.filter("v", lambda x: F.isnan(x))).alias("missing"),
        F.nullif(F.get(v, i["home_elo_pre_match"]).cast("double"), F.lit(float("nan"))).alias("elo"),
        F.nullif(F.get(v, i["home_goals_for_mean_last_5"]).cast("double"), F.lit(float("nan"))).alias("goals_mean"),
    )


# --- folds ----------------------------------------------------------------------------------


def params(df, mode="expanding"):
    """Fold sizes as shares of the data: a third to train first, a tenth per test block."""
    n = df.count()
    return Fo.FoldParams(min_train_size=n // 3, test_size=max(1, n // 10), gap_days=1, mode=mode, val_ratio=0.15)


_LINE = """
line AS (SELECT k, CAST(sum(n) OVER (ORDER BY k) - n AS BIGINT) AS first, CAST(sum(n) OVER (ORDER BY k) - 1 AS BIGINT) AS last FROM
  (SELECT CAST(epoch_us(kickoff) AS BIGINT) AS k, count(*) AS n FROM fin GROUP BY 1)),
size AS (SELECT count(*) AS n, count(*) // 3 AS mt, count(*) // 10 AS ts FROM fin)"""


def _walk_sql(mode: str) -> str:
    """Fold bounds by recursion; every boundary is one lookup of the kickoff group that holds a position."""
    start = "w.t0" if mode == "expanding" else "CASE WHEN w.fold_id = 0 THEN w.t0 ELSE (SELECT min(first) FROM line WHERE last >= greatest(0, w.te - w.mt + 1)) END"
    group = "(SELECT min({k: k, f: first, l: last}) FROM line WHERE %s)"
    return f"""
walk AS (
  SELECT CAST(0 AS BIGINT) AS fold_id, CAST(0 AS BIGINT) AS t0, CAST(NULL AS BIGINT) AS tr, CAST(NULL AS BIGINT) AS tk, CAST(NULL AS BIGINT) AS vs, CAST(NULL AS BIGINT) AS ve,
         CAST(NULL AS BIGINT) AS ss, CAST(NULL AS BIGINT) AS se, CAST(mt - 1 AS BIGINT) AS te, CAST(0 AS BIGINT) AS nv, CAST(0 AS BIGINT) AS ns, mt, ts FROM size
  UNION ALL
  SELECT d.fold_id + 1, d.t0, d.tr, d.tk, d.v.k, d.e.k, d.s.k, d.x.k, d.x.l, d.e.l - d.v.f + 1, d.x.l - d.s.f + 1, d.mt, d.ts FROM
   (SELECT c.*, {group % "last >= c.s.f + c.ts - 1"} AS x FROM
    (SELECT b.*, {group % "k >= b.e.k + 86400000000"} AS s FROM
     (SELECT a.*, {group % "last >= a.v.f + greatest(1, round_even((a.tr - a.t0 + 1) * 0.15, 0)) - 1"} AS e FROM
      (SELECT q.*, {group % "k >= q.tk + 86400000000"} AS v FROM
       (SELECT p.*, (SELECT max(k) FROM line WHERE last <= p.tr) AS tk FROM
        (SELECT w.fold_id, {start} AS t0, w.mt, w.ts,
                CASE WHEN (SELECT min(last) FROM line WHERE last >= w.te) = w.te THEN w.te ELSE (SELECT max(last) FROM line WHERE last < w.te) END AS tr
         FROM walk w) p) q WHERE q.tr - q.t0 + 1 >= q.mt) a) b) c) d
  WHERE d.x IS NOT NULL)"""


_FOLD_SPEC = "i:fold_id,n_train,n_val,n_test t:train_start,train_end,val_start,val_end,test_start,test_end"
_FOLD_ANSWER = """SELECT fold_id - 1 AS fold_id, tr - t0 + 1 AS n_train, nv AS n_val, ns AS n_test,
  make_timestamp((SELECT k FROM line WHERE first = t0)) AS train_start, make_timestamp(tk) AS train_end, make_timestamp(vs) AS val_start,
  make_timestamp(ve) AS val_end, make_timestamp(ss) AS test_start, make_timestamp(se) AS test_end FROM walk WHERE fold_id > 0"""


def folds(spark, folder, mode="expanding"):
    p = played(spark, folder)
    return Fo.walk_forward(p, params(p, mode))


for _mode in ("expanding", "sliding"):

    @query(f"m1_walk_forward_{_mode}", _FOLD_SPEC, with_sql(MATCHES, FIN, _LINE, _walk_sql(_mode), recursive=True, answer=_FOLD_ANSWER))
    def walk_forward(spark, folder, mode=_mode):
        """Fold bounds with a day's gap and whole kickoff groups."""
        return Fo.fold_table(spark, folds(spark, folder, mode))


@query(
    "m17_fold_cutoffs",
    "i:fold_id t:gap_end,training_cutoff,validation_cutoff,test_cutoff",
    with_sql(MATCHES, FIN, _LINE, _walk_sql("expanding"), recursive=True, answer="""SELECT fold_id - 1 AS fold_id, make_timestamp(vs) AS gap_end,
    make_timestamp(tk) AS training_cutoff, make_timestamp(ve) AS validation_cutoff, make_timestamp(se) AS test_cutoff FROM walk WHERE fold_id > 0"""),
)
def fold_cutoffs(spark, folder):
    """Cutoffs of every fold."""
    return Fo.fold_table(spark, folds(spark, folder))


_MEMBERS = """
members AS (SELECT w.fold_id - 1 AS fold_id, f.fixture_id, f.home_goals, f.away_goals,
  CASE WHEN l.k <= w.tk THEN 'train' WHEN l.k <= w.ve THEN 'val' ELSE 'test' END AS block
  FROM walk w JOIN line l ON (l.first >= w.t0 AND l.k <= w.tk) OR (l.k >= w.vs AND l.k <= w.ve) OR (l.k >= w.ss AND l.k <= w.se)
  JOIN fin f ON epoch_us(f.kickoff) = l.k WHERE w.fold_id > 0)"""


@query(
    "j13_fold_membership",
    "i:fold_id,fixture_id s:block",
    with_sql(MATCHES, FIN, _LINE, _walk_sql("expanding"), _MEMBERS, recursive=True, answer="SELECT * FROM members"),
)
def fold_membership(spark, folder):
    """Rows joined to every fold block that holds their kickoff."""
    return Fo.membership(played(spark, folder), Fo.fold_table(spark, folds(spark, folder)))


@query(
    "o7_fold_blocks_disjoint",
    "i:fold_id,overlap",
    with_sql(MATCHES, FIN, _LINE, _walk_sql("expanding"), recursive=True, answer="SELECT fold_id - 1 AS fold_id, 0 AS overlap FROM walk WHERE fold_id > 0"),
)
def blocks_disjoint(spark, folder):
    """Rows that lie in more than one block of a fold: none."""
    return Fo.block_overlaps(played(spark, folder), Fo.fold_table(spark, folds(spark, folder)))


@query("w9_position_per_kickoff", "i:at_micros,first,last", with_sql(MATCHES, FIN, _LINE, answer="SELECT k AS at_micros, first, last FROM line"))
def positions(spark, folder):
    """First and last row position of every distinct kickoff."""
    return Fo.timeline(played(spark, folder)).withColumnRenamed("at", "at_micros")


@query("w8_order_keys_unique", "i:duplicates,unset", with_sql(MATCHES, FIN, answer="SELECT count(*) - count(DISTINCT fixture_id) AS duplicates, count(*) - count(kickoff) AS unset FROM fin"))
def order_keys(spark, folder):
    """The order (kickoff, id) is total: no repeated key and no NULL."""
    p = played(spark, folder)
    twice = p.groupBy("kickoff", "fixture_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    return twice.withColumn("k", F.lit(1)).join(p.agg(F.count_if(F.col("kickoff").isNull()).alias("unset")).withColumn("k", F.lit(1)), "k")


@query(
    "a21_train_intercepts",
    "i:fold_id d:beta_0_home,beta_0_away",
    with_sql(MATCHES, FIN, _LINE, _walk_sql("expanding"), _MEMBERS, recursive=True, answer="""SELECT fold_id, ln(greatest(avg(home_goals), 0.1)) AS beta_0_home,
    ln(greatest(avg(away_goals), 0.1)) AS beta_0_away FROM members WHERE block = 'train' GROUP BY fold_id"""),
)
def train_intercepts(spark, folder):
    """Log mean goals per side and fold, from train blocks."""
    bounds = Fo.fold_table(spark, folds(spark, folder))
    return Mo.fold_intercepts(Fo.train_sums(played(spark, folder), bounds, [f"{s}_goals" for s in N.SIDES]))


@query(
    "a22_p24_train_means",
    "s:feature d:mean",
    with_sql(*EXAMPLE_CTES, EXAMPLES, recursive=True, answer=" UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(avg(CAST(CAST({c} AS FLOAT) AS DOUBLE)), 0) AS mean FROM ex" for c in N.HEAD["home"])),
)
def train_means(spark, folder):
    """Mean of each home-head feature over its present values, the fill value outside training."""
    means = Mo.head_means(rows(spark, folder), "home")
    return spark.createDataFrame(list(means.items()), "feature string, mean double")


@query(
    "p24_train_rows_kept",
    "i:home_rows,away_rows",
    with_sql(*EXAMPLE_CTES, EXAMPLES, recursive=True, answer="SELECT " + ", ".join(
        f"sum(CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in N.HEAD[s])} THEN 1 ELSE 0 END) AS {s}_rows" for s in N.SIDES) + " FROM ex"),
)
def train_rows_kept(spark, folder):
    """Rows without a missing head feature, which are those a head trains on."""
    full = [F.count_if(~F.array_contains(F.array(*[F.col(c).isNull() for c in N.HEAD[s]]), True)).alias(f"{s}_rows") for s in N.SIDES]
    return rows(spark, folder).agg(*full)


@query(
    "p25_rows_with_ratings",
    "i:kept,dropped",
    with_sql(MATCHES, FIN, answer="SELECT count(*) AS kept, 0 AS dropped FROM fin"),
)
def rows_with_ratings(spark, folder):
    """Rows with finite ratings and the number dropped."""
    r = rows(spark, folder)
    return r.agg(
        F.count_if(X.finite(F.col("home_elo_pre_match")) & X.finite(F.col("away_elo_pre_match"))).alias("kept"),
        F.count_if(~X.finite(F.col("elo_difference"))).alias("dropped"),
    )


# --- models ---------------------------------------------------------------------------------

_POIS = """
cells AS (SELECT q.*, i, j, exp(-lh + i * ln(lh) - lgamma(i + 1)) * exp(-la + j * ln(la) - lgamma(j + 1)) AS p
  FROM rates q, range(0, 11) AS a(i), range(0, 11) AS b(j)),
probs AS (SELECT key, sum(p) FILTER (i > j) / sum(p) AS ph, sum(p) FILTER (i = j) / sum(p) AS pd, sum(p) FILTER (i < j) / sum(p) AS pa FROM cells GROUP BY key)"""


@query(
    "m2_elo_baseline_forecast",
    "i:fixture_id d:expected_home_goals,expected_away_goals,p_home_win,p_draw,p_away_win",
    with_sql(
        MATCHES, FIN, ELO_CTE,
        """rates AS (SELECT fixture_id AS key, exp(0.3 + 0.002 * (CAST(CAST(eh AS FLOAT) AS DOUBLE) + 65 - CAST(CAST(ea AS FLOAT) AS DOUBLE))) AS lh,
        exp(0.1 - 0.002 * (CAST(CAST(eh AS FLOAT) AS DOUBLE) + 65 - CAST(CAST(ea AS FLOAT) AS DOUBLE))) AS la FROM elo)""",
        _POIS, recursive=True,
        answer="SELECT r.key AS fixture_id, lh AS expected_home_goals, la AS expected_away_goals, ph AS p_home_win, pd AS p_draw, pa AS p_away_win FROM rates r JOIN probs USING (key)",
    ),
)
def elo_forecast(spark, folder):
    """Forecast of every match by a rating baseline with fixed parameters."""
    model = Mo.EloModel({"beta_0_home": 0.3, "beta_0_away": 0.1, "HFA": 65.0, "beta_1": 0.002, "max_goals": 10})
    return model.transform(family("elo")(spark, folder))


_GRID = ", ".join(f"({i}, {h}, {b})" for i, (h, b) in enumerate((h, b) for h in Mo.GRID_HFA for b in Mo.GRID_BETA))


_TAILS = """SELECT *, list_transform(range(0, 11), lambda i: exp(-lh + i * ln(lh) - lgamma(i + 1))) AS hp,
  list_transform(range(0, 11), lambda i: exp(-la + i * ln(la) - lgamma(i + 1))) AS ap"""
_SUMS = """list_sum(hp) * list_sum(ap) AS total, list_sum(list_transform(range(2, 12), lambda i: hp[i] * list_sum(ap[1:i - 1]))) AS ph,
  list_sum(list_transform(range(1, 12), lambda i: hp[i] * ap[i])) AS pd"""
_RATES = """exp(bh + beta * (CAST(CAST(eh AS FLOAT) AS DOUBLE) + hfa - CAST(CAST(ea AS FLOAT) AS DOUBLE))) AS lh,
  exp(ba - beta * (CAST(CAST(eh AS FLOAT) AS DOUBLE) + hfa - CAST(CAST(ea AS FLOAT) AS DOUBLE))) AS la"""
_GRID_CTES = (
    MATCHES, FIN, ELO_CTE.replace("elo AS (", "elo AS MATERIALIZED ("), _LINE, _walk_sql("expanding"),
    _MEMBERS.replace("'train'", "1").replace("'val'", "2").replace("'test'", "3"),
    f"""grid AS (SELECT * FROM (VALUES {_GRID}) AS t(g, hfa, beta)),
    betas AS (SELECT fold_id, ln(greatest(avg(home_goals), 0.1)) AS bh, ln(greatest(avg(away_goals), 0.1)) AS ba FROM members WHERE block = 1 GROUP BY 1),
    rates AS (SELECT m.fold_id, m.fixture_id, g, hfa, beta, m.home_goals, m.away_goals, {_RATES}
      FROM members m JOIN betas USING (fold_id) JOIN elo USING (fixture_id) CROSS JOIN grid WHERE m.block = 2),
    tails AS ({_TAILS} FROM rates),
    probs AS (SELECT fold_id, g, hfa, beta, home_goals, away_goals, {_SUMS} FROM tails),
    losses AS (SELECT fold_id, g, hfa, beta, count(*) AS n, avg(-ln(CASE WHEN home_goals > away_goals THEN ph / total
      WHEN home_goals = away_goals THEN pd / total ELSE 1 - (ph + pd) / total END)) AS loss FROM probs GROUP BY 1, 2, 3, 4),
    best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY loss, g) AS rn FROM losses) WHERE rn = 1)""",
)


@query(
    "m3_elo_grid_search",
    "i:fold_id,val_n d:hfa,beta_1,val_log_loss",
    with_sql(*_GRID_CTES, recursive=True, answer="SELECT fold_id, n AS val_n, hfa, beta AS beta_1, loss AS val_log_loss FROM best"),
)
def elo_grid(spark, folder):
    """Best grid point of every fold on its validation block."""
    r = family("elo")(spark, folder)
    bounds = Fo.fold_table(spark, folds(spark, folder))
    betas = Mo.fold_intercepts(Fo.train_sums(r, bounds, [f"{s}_goals" for s in N.SIDES]))
    losses = Mo.elo_grid_losses(Fo.membership(r, bounds, ("val",)).join(betas, "fold_id"), ["fold_id"]).collect()
    out = [(x["fold_id"], x["val_n"], *map(float, Mo.pick_grid_point(x)[0]), Mo.pick_grid_point(x)[1]) for x in losses]
    return spark.createDataFrame(out, "fold_id long, val_n long, hfa double, beta_1 double, val_log_loss double")


@query(
    "m10_calibrator_choice",
    "i:model_version_id,season_id,val_n s:kind d:val_ece",
    with_sql(*CTES, BINS, f"""bins AS (SELECT s.model_version_id, s.season_id, e.bin_id, count(*) AS n, avg(hit) AS acc, avg(conf) AS mc FROM sc s JOIN edges e ON {IN_BIN} GROUP BY 1, 2, 3)""",
             answer="""SELECT *, CASE WHEN val_ece < 0.02 THEN 'identity' WHEN val_ece >= 0.05 AND val_n >= 5000 THEN 'dirichlet' ELSE 'temperature' END AS kind FROM
    (SELECT model_version_id, season_id, sum(n) AS val_n, sum(n * abs(acc - mc)) / sum(n) AS val_ece FROM bins GROUP BY 1, 2)"""),
)
def calibrator_choice(spark, folder):
    """Calibrator kind per group, from its calibration error and size."""
    return Cal.choose(forecasts(spark, folder), ["model_version_id", "season_id"])


@query("m7_identity_calibration", "i:fixture_id,model_version_id d:p_home_win,p_draw,p_away_win", with_sql(*CTES, answer="SELECT * FROM sc"))
def identity(spark, folder):
    """The identity calibrator changes nothing."""
    f = forecasts(spark, folder)
    p = f.select("model_version_id").distinct().withColumn("kind", F.lit("identity"))
    p = p.withColumns({c: F.lit(float(c in ("w00", "w11", "w22"))) for c in Cal.PARAMS})
    return Cal.apply(f, p, ["model_version_id"])


@query(
    "m8_temperature_fit",
    "i:model_version_id b:inside_bounds,is_minimum",
    with_sql(*CTES, answer="SELECT DISTINCT model_version_id, TRUE AS inside_bounds, TRUE AS is_minimum FROM sc"),
)
def temperature(spark, folder):
    """Fitted temperature per model version: inside its bounds and no worse than its neighbours."""
    f = forecasts(spark, folder)
    table = Cal.fit_temperature(f, ["model_version_id"]).withColumnRenamed("temperature", "t")
    out = f.withColumns({f"lp{i}": X.clipped_log(F.col(c), Cal.CLIP) for i, c in enumerate(Mx.P)})
    lp = [F.col(f"lp{i}") for i in range(3)]

    def loss(t):
        return F.avg(-F.log(X.pick3(F.col("label"), *X.softmax3(*[x / t for x in lp]))))

    scored = out.join(table, "model_version_id").groupBy("model_version_id", "t").agg(
        loss(F.col("t")).alias("at"), loss(F.col("t") * 1.01).alias("above"), loss(F.col("t") / 1.01).alias("below")
    )
    return scored.select("model_version_id", F.col("t").between(Cal.T_MIN, Cal.T_MAX).alias("inside_bounds"), (((F.col("at") <= F.col("above")) | (F.col("t") >= Cal.T_MAX)) & ((F.col("at") <= F.col("below")) | (F.col("t") <= Cal.T_MIN))).alias("is_minimum"))


@query(
    "m9_dirichlet_fit",
    "i:model_version_id,rows b:simplex,no_worse_than_identity,converged,stationary",
    with_sql(*CTES, answer="SELECT model_version_id, count(*) AS rows, TRUE AS simplex, TRUE AS no_worse_than_identity, TRUE AS converged, TRUE AS stationary FROM sc GROUP BY 1"),
)
def dirichlet(spark, folder):
    """Dirichlet calibration per model version: a simplex, a lower log loss, and a zero gradient in all twelve parameters."""
    f = forecasts(spark, folder)
    fitted = Cal.fit_dirichlet(f, ["model_version_id"])
    ended = fitted.select("model_version_id", "converged", "gradient")
    table = fitted.select("model_version_id", F.lit("dirichlet").alias("kind"), *[F.col("x")[i].alias(p) for i, p in enumerate(Cal.PARAMS)])
    both = Cal.apply(f.withColumn("raw_loss", -F.log(X.pick3(F.col("label"), *[F.col(c) for c in Mx.P]))), table, ["model_version_id"])
    p = [F.col(c) for c in Mx.P]
    return both.groupBy("model_version_id").agg(
        F.count("*").alias("rows"),
        F.bool_and(X.is_simplex(*p)).alias("simplex"),
        (F.avg(-F.log(X.pick3(F.col("label"), *p))) <= F.avg("raw_loss")).alias("no_worse_than_identity"),
    ).join(ended, "model_version_id").withColumn("stationary", F.col("gradient") < 1e-6)


@query("m4_poisson_regression", "i:fixture_id d:expected_home_goals,expected_away_goals,p_home_win,p_draw,p_away_win")
def poisson_regression(spark, folder):
    """Two-head Poisson regression fitted on all rows and applied to them."""
    r = rows(spark, folder)
    return Mo.PoissonTrainer().fit(r).transform(r)


@query(
    "m4_poisson_stationary_point",
    "s:head,feature i:train_rows b:gradient_is_zero",
    with_sql(*EXAMPLE_CTES, EXAMPLES, recursive=True, answer=" UNION ALL ".join(
        f"SELECT '{side}' AS head, f AS feature, n AS train_rows, TRUE AS gradient_is_zero FROM (SELECT count(*) AS n FROM ex WHERE {' AND '.join(f'{x} IS NOT NULL' for x in N.HEAD[side])}), "
        f"unnest([{', '.join(repr(c) for c in ['intercept', *N.HEAD[side]])}]) t(f)" for side in N.SIDES)),
)
def poisson_stationary(spark, folder):
    """At both fitted heads the penalised gradient vanishes for the intercept and every feature."""
    r = rows(spark, folder)
    trainer = Mo.PoissonTrainer()
    model = trainer.fit(r)
    out = None
    for side in N.SIDES:
        weights = dict(zip(N.HEAD[side], model.heads[side].coefficients.tolist(), strict=True))
        seen = model.transform(r.dropna(subset=N.HEAD[side]))
        miss = F.col(f"expected_{side}_goals") - F.col(f"{side}_goals")
        x = {c: F.col(c).cast("float").cast("double") for c in N.HEAD[side]}
        # Relative to the spread of the feature, since columns range from goal means to ratings.
        flat = {"intercept": F.abs(F.avg(miss)) <= 1e-6} | {c: F.abs(F.avg(miss * x[c]) + trainer.l2 * weights[c]) <= 1e-6 * (1.0 + F.avg(F.abs(x[c]))) for c in x}
        sums = seen.agg(F.count("*").alias("train_rows"), *[v.alias(c) for c, v in flat.items()])
        entries = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("gradient_is_zero")) for c in flat]
        part = sums.select(F.lit(side).alias("head"), "train_rows", F.explode(F.array(*entries)).alias("e")).select("head", "train_rows", "e.*")
        out = part if out is None else out.unionByName(part)
    return out


@query("m5_gradient_boosting", "i:fixture_id d:p_home_win,p_draw,p_away_win")
def gradient_boosting(spark, folder):
    """Boosted trees over all 66 features."""
    r = rows(spark, folder)
    return Mo.trainer("gradient_boosting").fit(r, seed=42).transform(r)


@query("m6_second_booster", "i:fixture_id d:p_home_win,p_draw,p_away_win")
def second_booster(spark, folder):
    """The second booster: the same estimator with its own parameter set."""
    r = rows(spark, folder)
    return Mo.trainer("lightgbm").fit(r, seed=42).transform(r)


@query(
    "m5_m6_boosters_improve",
    "s:model i:fixture_id,train_rows b:simplex,loss_falls_every_round",
    with_sql(MATCHES, FIN, answer="""SELECT model, fixture_id, (SELECT count(*) FROM fin) AS train_rows, TRUE AS simplex, TRUE AS loss_falls_every_round
    FROM fin, unnest(['gradient_boosting', 'lightgbm']) m(model)"""),
)
def boosters_improve(spark, folder):
    """Both boosters with their defaults, fitted side by side: probabilities of every row, and the train loss after each round."""
    r = rows(spark, folder)
    models = B.fit(r, [B.Group((name,), B.growth_of(defaults, {})) for name, defaults in Mo.BOOSTING.items()])
    falls = {k[0]: len(m.losses) == 101 and all(b < a for a, b in zip(m.losses, m.losses[1:], strict=False)) for k, m in models.items()}
    table = spark.createDataFrame([(name, ok) for name, ok in falls.items()], "model string, loss_falls_every_round boolean")
    out = B.forecast(r, models, {"model": "string"}, ["fixture_id"]).join(F.broadcast(table), "model")
    return out.select("model", "fixture_id", F.lit(r.count()).alias("train_rows"), X.is_simplex(*[F.col(c) for c in Mx.P]).alias("simplex"), "loss_falls_every_round")


_STUMP = [c for c in N.FORM]
_STUMP_SQL = f"""
labelled AS (SELECT CASE WHEN home_win = 1 THEN 0 WHEN draw = 1 THEN 1 ELSE 2 END AS y, * FROM ex),
shares AS (SELECT k, count(*) FILTER (y = k) / count(*)::DOUBLE AS p FROM labelled, range(3) t(k) GROUP BY k),
signals AS (SELECT fixture_id, k, CAST(round((p - (y = k)::INT) * 16777216) AS HUGEINT) AS g, CAST(round(p * (1 - p) * 16777216) AS HUGEINT) AS h FROM labelled, shares),
cells AS ({" UNION ALL ".join(f"SELECT fixture_id, {i} AS j, {c} AS v FROM labelled" for i, c in enumerate(_STUMP))}),
bars AS (SELECT k, j, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM cells JOIN signals USING (fixture_id) GROUP BY ALL),
cuts AS (SELECT k, j, c, s, sum(g) FILTER (v <= c OR (v IS NULL AND s = 1)) AS gl, sum(h) FILTER (v <= c OR (v IS NULL AND s = 1)) AS hl,
  coalesce(sum(n) FILTER (v <= c OR (v IS NULL AND s = 1)), 0) AS nl, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM bars, range(31) a(c), range(2) b(s) GROUP BY k, j, c, s),
scored AS (SELECT *, (gl::DOUBLE * gl / hl + (g - gl)::DOUBLE * (g - gl) / (h - hl) - g::DOUBLE * g / h) / 16777216 AS gain FROM cuts WHERE nl >= 20 AND n - nl >= 20),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j, c, s) AS r FROM (SELECT *, max(gain) OVER (PARTITION BY k) AS top FROM scored) WHERE gain >= top * (1 - 1e-12))"""


@query(
    "m5_stump_split",
    "i:class,feature,cut,rows_below,rows_above b:missing_below d:gain,value_below,value_above",
    with_sql(*EXAMPLE_CTES, EXAMPLES, _STUMP_SQL, recursive=True, answer="""SELECT k AS class, j AS feature, c AS cut, s = 1 AS missing_below, gain, nl AS rows_below, n - nl AS rows_above,
    -0.1 * gl / hl AS value_below, -0.1 * (g - gl) / (h - hl) AS value_above FROM best WHERE r = 1"""),
)
def stump_split(spark, folder):
    """First split of the booster per class over the form columns: column, cut, side of missing values, gain and leaf values."""
    growth = B.Growth(rounds=1, leaves=2)
    edges = [np.arange(31.0) for _ in _STUMP]
    model = B.fit(rows(spark, folder), [B.Group((0,), growth)], _STUMP, edges)[(0,)]
    out = []
    for k, tree, values in model.trees:
        out.append((k, *[int(tree[c][0]) for c in ("feature", "cut")], bool(tree["missing_left"][0]), float(tree["gain"][0]), *[int(n) for n in tree["rows"][1:3]], *map(float, values[1:3])))
    return spark.createDataFrame(out, "class int, feature int, cut int, missing_below boolean, gain double, rows_below long, rows_above long, value_below double, value_above double")


_LOGS = ", ".join(f"ln(least(greatest({c}, 1e-12), 1.0)) AS l{i}" for i, c in enumerate(("ph / total", "pd / total", "1 - (ph + pd) / total")))
_SOFT = [f"exp(u * l{i}) / (exp(u * l0) + exp(u * l1) + exp(u * l2))" for i in range(3)]
_BACKTEST = f"""
raw AS MATERIALIZED (SELECT *, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS label, {_LOGS}
  FROM (SELECT *, {_SUMS} FROM ({_TAILS} FROM (SELECT m.fold_id, m.block, m.fixture_id, m.home_goals, m.away_goals, {_RATES}
    FROM members m JOIN betas USING (fold_id) JOIN elo USING (fixture_id) JOIN best USING (fold_id) WHERE m.block > 1)))),
val AS (SELECT *, greatest(ph / total, pd / total, 1 - (ph + pd) / total) AS conf, CASE WHEN label = CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END AS hit
  FROM raw WHERE block = 2),
val_bins AS (SELECT s.fold_id, e.bin_id, count(*) AS n, avg(hit) AS acc, avg(conf) AS mc FROM val s JOIN edges e ON {IN_BIN} GROUP BY 1, 2),
kinds AS MATERIALIZED (SELECT fold_id, sum(n * abs(acc - mc)) / sum(n) AS val_ece FROM val_bins GROUP BY 1),
halving AS (
  SELECT fold_id, 0 AS it, CAST(0.1 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi FROM kinds
  UNION ALL
  SELECT fold_id, it + 1, CASE WHEN slope > 0 THEN lo ELSE u END, CASE WHEN slope > 0 THEN u ELSE hi END
  FROM (SELECT fold_id, it, lo, hi, u, avg({' + '.join(f'{x} * l{i}' for i, x in enumerate(_SOFT))} - CASE label WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END) AS slope
    FROM (SELECT h.fold_id, h.it, h.lo, h.hi, (h.lo + h.hi) / 2 AS u, v.l0, v.l1, v.l2, v.label FROM halving h JOIN val v ON v.fold_id = h.fold_id WHERE h.it < 45) GROUP BY 1, 2, 3, 4, 5)),
scale AS (SELECT fold_id, CASE WHEN val_ece < 0.02 THEN NULL ELSE (lo + hi) / 2 END AS u FROM halving JOIN kinds USING (fold_id) WHERE it = 45),
cal AS (SELECT r.*, CASE WHEN u IS NULL THEN ph / total ELSE {_SOFT[0]} END AS c0, CASE WHEN u IS NULL THEN pd / total ELSE {_SOFT[1]} END AS c1,
  CASE WHEN u IS NULL THEN 1 - (ph + pd) / total ELSE {_SOFT[2]} END AS c2 FROM raw r JOIN scale USING (fold_id) WHERE block = 3),
scored AS (SELECT *, greatest(c0, c1, c2) AS conf, CASE label WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS p_true,
  CASE WHEN label = CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END AS hit FROM cal),
test_bins AS (SELECT s.fold_id, e.bin_id, count(*) AS n, avg(hit) AS acc, avg(conf) AS mc FROM scored s JOIN edges e ON {IN_BIN} GROUP BY 1, 2),
errors AS (SELECT fold_id, sum(n * abs(acc - mc)) / sum(n) AS ece, max(abs(acc - mc)) AS mce FROM test_bins GROUP BY 1)"""


@query(
    "m11_m12_backtest_elo_baseline",
    "i:fold_id,n_predictions d:accuracy,log_loss,ece,mce,brier_multiclass,rmse_total_goals,poisson_loglik",
    with_sql(*_GRID_CTES, BINS, _BACKTEST, recursive=True, answer="""SELECT fold_id, count(*) AS n_predictions, avg(hit) AS accuracy, avg(-ln(p_true)) AS log_loss, max(ece) AS ece, max(mce) AS mce,
    avg(pow(c0 - (label = 0)::INT, 2) + pow(c1 - (label = 1)::INT, 2) + pow(c2 - (label = 2)::INT, 2)) AS brier_multiclass,
    sqrt(avg(pow(home_goals + away_goals - lh - la, 2))) AS rmse_total_goals,
    avg(-lh + home_goals * ln(lh) - lgamma(home_goals + 1) - la + away_goals * ln(la) - lgamma(away_goals + 1)) AS poisson_loglik
    FROM scored JOIN errors USING (fold_id) GROUP BY fold_id"""),
)
def backtest_elo(spark, folder):
    """Walk-forward backtest of the rating baseline: all folds in three passes, calibrated on validation."""
    r = rows(spark, folder)
    return Bt.run_backtest(r, params(r), "elo_baseline", "v1", "d1")["reports"]


@query("m12_backtest_poisson", "i:fold_id,n_predictions d:accuracy,log_loss,ece,mce,brier_multiclass,rmse_total_goals,poisson_loglik")
def backtest_poisson(spark, folder):
    """Walk-forward backtest of the Poisson regression."""
    r = rows(spark, folder)
    return Bt.run_backtest(r, params(r), "poisson", "v1", "d1")["reports"]


@query("m12_compare_models", "s:model_name,model_version i:n_folds,total_n_predictions d:mean_accuracy,mean_log_loss,weighted_log_loss,weighted_ece")
def compare_models(spark, folder):
    """Two models on identical folds, stored once and compared."""
    r = rows(spark, folder)
    store = R.RunStore(spark, scratch_path(spark, "runs"))
    return Bt.run_all(r, params(r), ["elo_baseline", "poisson"], "v1", "d1", store)


@query("m13_parameter_search", "i:trial s:hyperparameters d:weighted_log_loss")
def parameter_search(spark, folder):
    """Ten candidates of the booster's learning rate, leaves and rounds scored on the same folds, best first."""
    r = rows(spark, folder)
    return Bt.search(r, params(r), "gradient_boosting", Bt.candidates(10))


@query(
    "m14_s20_final_fit_registered",
    "s:model_name,model_version b:digest_matches i:fitted_seed",
    "SELECT 'elo_baseline' AS model_name, 'v9' AS model_version, TRUE AS digest_matches, 42 AS fitted_seed",
)
def final_fit(spark, folder):
    """Final fit on all rows, registered with its payload and digest."""
    registry = R.ModelRegistry(spark, scratch_path(spark, "registry"))
    Bt.train_final(rows(spark, folder), "elo_baseline", "v9", "d1", registry, "2024-01-01 00:00:00")
    registry.load("elo_baseline", "v9")
    return spark.read.parquet(f"{registry.root}/registry").withColumn("digest_matches", F.sha2("payload", 256) == F.col("payload_sha256"))


@query(
    "m14_s20_loaded_model_scores",
    "i:fixture_id d:expected_home_goals,expected_away_goals,p_home_win,p_draw,p_away_win",
    with_sql(
        MATCHES, FIN, ELO_CTE,
        """means AS (SELECT ln(greatest(avg(home_goals), 0.1)) AS bh, ln(greatest(avg(away_goals), 0.1)) AS ba FROM fin),
        rates AS (SELECT fixture_id AS key, exp(bh + 0.002 * (CAST(CAST(eh AS FLOAT) AS DOUBLE) + 70 - CAST(CAST(ea AS FLOAT) AS DOUBLE))) AS lh,
        exp(ba - 0.002 * (CAST(CAST(eh AS FLOAT) AS DOUBLE) + 70 - CAST(CAST(ea AS FLOAT) AS DOUBLE))) AS la FROM elo, means)""",
        _POIS, recursive=True,
        answer="SELECT r.key AS fixture_id, lh AS expected_home_goals, la AS expected_away_goals, ph AS p_home_win, pd AS p_draw, pa AS p_away_win FROM rates r JOIN probs USING (key)",
    ),
)
def loaded_scores(spark, folder):
    """A final fit with given rating parameters, registered, loaded again and applied to every row."""
    registry = R.ModelRegistry(spark, scratch_path(spark, "registry"))
    Bt.train_final(rows(spark, folder), "elo_baseline", "v1", "d1", registry, "2024-01-01 00:00:00", HFA=70.0, beta_1=0.002)
    return registry.load_model("elo_baseline", "v1").transform(rows(spark, folder))


_OPEN = """
open AS (SELECT fixture_id, competition_id, season_id, home_team_id, away_team_id, kickoff FROM matches WHERE status <> 'finished'),
seen AS (SELECT o.fixture_id, (SELECT count(*) FROM fin f WHERE f.competition_id = o.competition_id AND f.season_id = o.season_id AND f.kickoff < o.kickoff
   AND (f.home_team_id IN (o.home_team_id, o.away_team_id) OR f.away_team_id IN (o.home_team_id, o.away_team_id))) AS n FROM open o)"""


@query(
    "m15_batch_scoring_outcomes",
    "i:fixture_id s:outcome b:has_probabilities",
    with_sql(MATCHES, FIN, _OPEN, answer="""SELECT q.fixture_id, CASE WHEN s.fixture_id IS NULL THEN 'unknown_match' WHEN s.n = 0 THEN 'insufficient_history' ELSE 'scored' END AS outcome,
    coalesce(s.n > 0, FALSE) AS has_probabilities FROM (SELECT DISTINCT l_orderkey * 2 AS fixture_id FROM lineitem WHERE l_linestatus = 'O'
    UNION SELECT fixture_id FROM open) q LEFT JOIN seen s USING (fixture_id)"""),
)
def batch_scoring(spark, folder):
    """Scores of requested matches; unknown ones and those without history are told apart."""
    m = T.matches(spark, folder)
    li = T.table(spark, folder, "lineitem").where("l_linestatus = 'O'").select((F.col("l_orderkey") * 2).alias("fixture_id"))
    asked = li.union(m.where("status <> 'finished'").select("fixture_id")).distinct()
    model = Mo.EloModel({"beta_0_home": 0.3, "beta_0_away": 0.1, "HFA": 65.0, "beta_1": 0.002, "max_goals": 10})
    out = Sc.score(asked, m, T.team_stats(spark, folder), model)
    return out.withColumn("has_probabilities", F.col("p_home_win").isNotNull())


@query(
    "m16_score_feature_rows",
    "i:fixture_id b:simplex",
    with_sql(MATCHES, FIN, answer="SELECT fixture_id, TRUE AS simplex FROM fin"),
)
def score_rows(spark, folder):
    """Probabilities for given feature rows."""
    model = Mo.EloModel({"beta_0_home": 0.3, "beta_0_away": 0.1, "HFA": 65.0, "beta_1": 0.002, "max_goals": 10})
    out = Sc.score_rows(rows(spark, folder), model)
    return out.select("fixture_id", X.is_simplex(*[F.col(c) for c in Mx.P]).alias("simplex"))


@query("x12_fold_seed", "i:fixture_id,seed", with_sql(MATCHES, answer="SELECT fixture_id, CAST('0x' || substr(sha256('42:' || fixture_id), 1, 8) AS BIGINT) AS seed FROM matches"))
def fold_seed(spark, folder):
    """Seed from base and index, here for every match id."""
    return T.matches(spark, folder).select("fixture_id", X.fold_seed(42, F.col("fixture_id")).alias("seed"))


@query(
    "o8_feature_partition",
    "s:feature b:home_head,away_head i:present",
    with_sql(*EXAMPLE_CTES, EXAMPLES, recursive=True, answer=" UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c.startswith('home_') or c in N.SHARED} AS home_head, {c.startswith('away_') or c in N.SHARED} AS away_head, count({c}) AS present FROM ex" for c in N.FEATURES)),
)
def feature_partition(spark, folder):
    """Which head reads which feature, and how many rows carry it."""
    counts = rows(spark, folder).agg(*[F.count(c).alias(c) for c in N.FEATURES])
    entries = [F.struct(F.lit(c).alias("feature"), F.lit(c in N.HEAD["home"]).alias("home_head"), F.lit(c in N.HEAD["away"]).alias("away_head"), F.col(c).alias("present")) for c in N.FEATURES]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
