"""Metrics, goal expressions and evaluation of forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import FIN, MATCHES, PREDICTIONS, query, with_sql
from touchline.functions import scalars as X
from touchline.operators import history as H
from touchline.operators import metrics as Mx
from touchline.operators import reads as Rd
from touchline.sources import tables as T

BY = ["model_version_id"]
RATE = 0.4


def forecasts(spark, folder):
    """Three forecasts per finished match with its class and, from the weights, two goal rates."""
    m = H.finished(T.matches(spark, folder)).select("fixture_id", "competition_id", "season_id", "home_goals", "away_goals")
    return T.predictions(spark, folder).join(m, "fixture_id").withColumns(
        {
            "label": X.outcome_class(F.col("home_goals"), F.col("away_goals")),
            "home_rate": F.col("w_h") * RATE,
            "away_rate": F.col("w_a") * RATE,
        }
    )


ROWS = f"""
fc AS (
  SELECT p.*, f.competition_id, f.season_id, f.home_goals, f.away_goals, p.w_h * {RATE} AS home_rate, p.w_a * {RATE} AS away_rate,
         CASE WHEN f.home_goals > f.away_goals THEN 0 WHEN f.home_goals = f.away_goals THEN 1 ELSE 2 END AS label,
         CASE WHEN p.p_home_win >= p.p_draw AND p.p_home_win >= p.p_away_win THEN 0 WHEN p.p_draw >= p.p_away_win THEN 1 ELSE 2 END AS predicted,
         greatest(p.p_home_win, p.p_draw, p.p_away_win) AS conf
  FROM predictions p JOIN fin f ON f.fixture_id = p.fixture_id),
sc AS (
  SELECT *, CASE label WHEN 0 THEN p_home_win WHEN 1 THEN p_draw ELSE p_away_win END AS p_true,
         CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END AS hit
  FROM fc)"""
CTES = (MATCHES, FIN, PREDICTIONS, ROWS)


def edges_sql(edges) -> str:
    rows = ", ".join(f"({i}, CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE), {'TRUE' if i == len(edges) - 2 else 'FALSE'})" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return f"edges AS (SELECT * FROM (VALUES {rows}) AS t(bin_id, lower, upper, closed))"


BINS = edges_sql(Mx.uniform_edges(10))
IN_BIN = "s.conf >= e.lower AND (s.conf < e.upper OR (e.closed AND s.conf <= e.upper))"
PER_BIN = f"""
per_bin AS (
  SELECT g.model_version_id, e.bin_id, e.lower, e.upper, count(s.fixture_id) AS n, avg(s.hit) AS acc, avg(s.conf) AS mc, avg(-ln(s.p_true)) AS ll
  FROM (SELECT DISTINCT model_version_id FROM sc) g CROSS JOIN edges e
  LEFT JOIN sc s ON s.model_version_id = g.model_version_id AND {IN_BIN}
  GROUP BY g.model_version_id, e.bin_id, e.lower, e.upper)"""


@query("p7_class_label", "i:fixture_id,label", with_sql(MATCHES, FIN, answer="SELECT fixture_id, CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS label FROM fin"))
def class_label(spark, folder):
    """Class from the outcome flags; from the goals where a flag is missing."""
    m = H.finished(T.matches(spark, folder))
    hg, ag = F.col("home_goals"), F.col("away_goals")
    flags = m.withColumns({"hw": F.when(hg > ag, 1).when(hg < ag, 0), "dr": F.when(hg == ag, F.lit(None).cast("int")).otherwise(0), "aw": (hg < ag).cast("int")})
    return flags.select("fixture_id", X.target_label(F.col("hw"), F.col("dr"), F.col("aw"), hg, ag).alias("label"))


@query(
    "p20_probability_validation",
    "i:model_version_id,rows,invalid_plain,invalid_scaled",
    with_sql(*CTES, answer="""SELECT model_version_id, count(*) AS rows, 0 AS invalid_plain,
    sum(CASE WHEN w_d = 5 THEN 1 ELSE 0 END) AS invalid_scaled FROM sc GROUP BY 1"""),
)
def probability_validation(spark, folder):
    """Rows that are no simplex: none as given, all with the largest draw weight once that is inflated."""
    p = [F.col(c) for c in Mx.P]
    bent = F.when(F.col("w_d") == 5, p[1] + 0.01).otherwise(p[1])
    return forecasts(spark, folder).groupBy(*BY).agg(
        F.count("*").alias("rows"),
        F.count_if(~X.is_simplex(*p)).alias("invalid_plain"),
        F.count_if(~X.is_simplex(p[0], bent, p[2])).alias("invalid_scaled"),
    )


@query(
    "p21_goal_validation",
    "i:rows,bad_goals,bad_halves",
    with_sql(MATCHES, answer="""SELECT count(*) AS rows, sum(CASE WHEN home_goals IS NULL THEN 1 ELSE 0 END) AS bad_goals,
    sum(CASE WHEN home_goals IS NULL OR home_goals % 2 = 1 THEN 1 ELSE 0 END) AS bad_halves FROM matches"""),
)
def goal_validation(spark, folder):
    """Unplayed matches fail the goal check, and so do halved odd goals."""
    return T.matches(spark, folder).agg(
        F.count("*").alias("rows"),
        F.count_if(~X.is_goal_count(F.col("home_goals"))).alias("bad_goals"),
        F.count_if(~X.is_goal_count(F.col("home_goals") / 2)).alias("bad_halves"),
    )


def _scalar(name, spec, select):
    @query(name, "i:model_version_id " + spec, with_sql(*CTES, BINS, PER_BIN, answer=f"SELECT model_version_id, {select} GROUP BY model_version_id"))
    def run(spark, folder):
        return Mx.summary(forecasts(spark, folder), BY)

    return run


_scalar("a3_accuracy", "d:accuracy", "avg(hit) AS accuracy FROM sc")
_scalar("a4_log_loss", "d:log_loss", "-avg(ln(greatest(p_true, 1e-15))) AS log_loss FROM sc")
_SQ = [f"avg(pow({c} - CASE WHEN label = {i} THEN 1 ELSE 0 END, 2))" for i, c in enumerate(Mx.P)]
_BRIER = f"{_SQ[0]} AS brier_home, {_SQ[1]} AS brier_draw, {_SQ[2]} AS brier_away, {' + '.join(_SQ)} AS brier_multiclass"
_scalar("a5_brier_scores", "d:brier_home,brier_draw,brier_away,brier_multiclass", f"{_BRIER} FROM sc")
_CM = ", ".join(f"sum(CASE WHEN label = {i} AND predicted = {j} THEN 1 ELSE 0 END) AS cm_{i}{j}" for i in range(3) for j in range(3))
_CMN = ",".join(f"cm_{i}{j}" for i in range(3) for j in range(3))
_scalar("a6_confusion_matrix", f"i:{_CMN}", f"{_CM} FROM sc")
_scalar("a7_expected_calibration_error", "d:ece", "sum(n * abs(acc - mc)) / sum(n) AS ece FROM per_bin WHERE n > 0")
_scalar("a8_maximum_calibration_error", "d:mce", "max(abs(acc - mc)) AS mce FROM per_bin WHERE n > 0")


@query(
    "a9_reliability_table",
    "i:model_version_id,bin_id,n d:lower,upper,accuracy,mean_confidence,abs_gap,weight",
    with_sql(*CTES, BINS, PER_BIN, answer="""SELECT model_version_id, bin_id, lower, upper, n, coalesce(acc, 0) AS accuracy,
    coalesce(mc, 0) AS mean_confidence, coalesce(abs(acc - mc), 0) AS abs_gap,
    CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY model_version_id) AS weight FROM per_bin"""),
)
def reliability_table(spark, folder):
    """Ten bins per model version, empty ones as zeros."""
    return Mx.reliability(forecasts(spark, folder), BY)


@query(
    "a10_confidence_buckets",
    "i:model_version_id,bin_id,n d:lower,upper,accuracy,mean_confidence,log_loss",
    with_sql(*CTES, edges_sql(Mx.CONFIDENCE_EDGES), PER_BIN, answer="""SELECT model_version_id, bin_id, lower, upper, n, coalesce(acc, 0) AS accuracy,
    coalesce(mc, 0) AS mean_confidence, coalesce(ll, 0) AS log_loss FROM per_bin"""),
)
def confidence_buckets(spark, folder):
    """Buckets from 0.4 up; lower confidences belong to none."""
    return Mx.confidence_buckets(forecasts(spark, folder), BY)


_GOALS = """avg(abs(home_goals - home_rate)) AS mae_home_goals, avg(abs(away_goals - away_rate)) AS mae_away_goals,
sqrt(avg(pow(home_goals - home_rate, 2))) AS rmse_home_goals, sqrt(avg(pow(away_goals - away_rate, 2))) AS rmse_away_goals,
sqrt(avg(pow(home_goals + away_goals - home_rate - away_rate, 2))) AS rmse_total_goals,
avg(-home_rate + home_goals * ln(home_rate) - lgamma(home_goals + 1) - away_rate + away_goals * ln(away_rate) - lgamma(away_goals + 1)) AS poisson_loglik"""


def _goal_scalar(name, spec):
    @query(name, "i:model_version_id " + spec, with_sql(*CTES, answer=f"SELECT model_version_id, {_GOALS} FROM sc GROUP BY model_version_id"))
    def run(spark, folder):
        return Mx.goal_metrics(forecasts(spark, folder), BY, "home_rate", "away_rate")

    return run


_goal_scalar("a11_mean_absolute_goal_error", "d:mae_home_goals,mae_away_goals")
_goal_scalar("a12_root_mean_square_goal_error", "d:rmse_home_goals,rmse_away_goals,rmse_total_goals")
_goal_scalar("a13_poisson_loglik_from_rates", "d:poisson_loglik")


@query(
    "a14_poisson_loglik_from_pmf",
    "i:model_version_id d:loglik",
    with_sql(*CTES, answer="""SELECT model_version_id, avg(
    ln(CASE WHEN home_goals <= 2 THEN exp(-home_rate + home_goals * ln(home_rate) - lgamma(home_goals + 1)) ELSE 1e-15 END)
    + ln(CASE WHEN away_goals <= 2 THEN exp(-away_rate + away_goals * ln(away_rate) - lgamma(away_goals + 1)) ELSE 1e-15 END)) AS loglik
    FROM sc GROUP BY model_version_id"""),
)
def loglik_from_pmf(spark, folder):
    """Log-likelihood from short pmf maps; a count beyond the map counts as 1e-15."""
    rows = forecasts(spark, folder).withColumns({f"pmf_{s}": X.pmf_map(F.col(f"{s}_rate"), 2) for s in ("home", "away")})
    both = Mx.pmf_loglik(F.col("home_goals"), F.col("pmf_home")) + Mx.pmf_loglik(F.col("away_goals"), F.col("pmf_away"))
    return rows.groupBy(*BY).agg(F.avg(both).alias("loglik"))


_REPORT = f"""SELECT s.model_version_id, s.season_id, count(*) AS n_predictions, avg(hit) AS accuracy, avg(-ln(p_true)) AS log_loss,
{_BRIER}, {_CM}, {_GOALS}, max(b.ece) AS ece, max(b.mce) AS mce
FROM sc s JOIN (SELECT model_version_id, season_id, sum(n * abs(acc - mc)) / sum(n) AS ece, max(abs(acc - mc)) AS mce FROM
  (SELECT s.model_version_id, s.season_id, e.bin_id, count(*) AS n, avg(hit) AS acc, avg(conf) AS mc FROM sc s JOIN edges e ON {IN_BIN} GROUP BY 1, 2, 3)
  GROUP BY 1, 2) b ON b.model_version_id = s.model_version_id AND b.season_id = s.season_id GROUP BY s.model_version_id, s.season_id"""


@query(
    "a15_fold_report",
    f"i:model_version_id,season_id,n_predictions,{_CMN} d:accuracy,log_loss,brier_home,brier_draw,brier_away,brier_multiclass,ece,mce,"
    "mae_home_goals,mae_away_goals,rmse_home_goals,rmse_away_goals,rmse_total_goals,poisson_loglik",
    with_sql(*CTES, BINS, answer=_REPORT),
)
def fold_report(spark, folder):
    """Every metric at once per (model version, season)."""
    by = [*BY, "season_id"]
    rows = forecasts(spark, folder)
    return Mx.summary(rows, by).join(Mx.goal_metrics(rows, by, "home_rate", "away_rate").drop("n"), by)


_FOLDS = f"folds AS ({_REPORT})"


def fold_metrics(spark, folder):
    return Mx.summary(forecasts(spark, folder), [*BY, "season_id"]).withColumnRenamed("season_id", "fold_id").withColumn(
        "run_id", F.concat(F.lit("run-"), F.col("model_version_id"))
    )


@query(
    "a16_run_comparison",
    "s:model_name,model_version,dataset_version,iterator_params i:n_folds,total_n_predictions "
    "d:mean_accuracy,std_accuracy,mean_log_loss,std_log_loss,mean_ece,mean_mce,weighted_log_loss,weighted_ece",
    with_sql(*CTES, BINS, _FOLDS, answer="""SELECT 'weights' AS model_name, 'v' || model_version_id AS model_version, 'd1' AS dataset_version,
    '{}' AS iterator_params, count(*) AS n_folds, sum(n_predictions) AS total_n_predictions, avg(accuracy) AS mean_accuracy,
    stddev_pop(accuracy) AS std_accuracy, avg(log_loss) AS mean_log_loss, stddev_pop(log_loss) AS std_log_loss, avg(ece) AS mean_ece,
    avg(CASE WHEN season_id <> 2001 THEN mce END) AS mean_mce, sum(n_predictions * log_loss) / sum(n_predictions) AS weighted_log_loss,
    sum(n_predictions * ece) / sum(n_predictions) AS weighted_ece FROM folds GROUP BY model_version_id"""),
)
def run_comparison(spark, folder):
    """One row per run over its folds; one metric of one fold is NaN and leaves only its mean."""
    folds = fold_metrics(spark, folder).withColumn("mce", F.when(F.col("fold_id") == 2001, F.lit(float("nan"))).otherwise(F.col("mce")))
    runs = folds.select(
        "run_id",
        F.lit("weights").alias("model_name"),
        F.concat(F.lit("v"), F.col("model_version_id")).alias("model_version"),
        F.lit("d1").alias("dataset_version"),
        F.lit("{}").alias("iterator_params"),
    ).distinct()
    return Mx.compare_runs(folds, runs)


@query(
    "a17_trial_metric",
    "i:model_version_id d:weighted_log_loss",
    with_sql(*CTES, BINS, _FOLDS, answer="SELECT model_version_id, sum(n_predictions * log_loss) / sum(n_predictions) AS weighted_log_loss FROM folds GROUP BY 1"),
)
def trial_metric(spark, folder):
    """Row-weighted log loss over folds."""
    return Mx.fold_metric(fold_metrics(spark, folder), BY, "weighted_log_loss")


# --- goal expressions -----------------------------------------------------------------------


@query(
    "x1_poisson_pmf",
    "i:fixture_id,model_version_id,k d:p",
    with_sql(*CTES, answer="""SELECT fixture_id, model_version_id, k, exp(-home_rate + k * ln(home_rate) - lgamma(k + 1)) AS p
    FROM sc CROSS JOIN range(0, 11) AS r(k)"""),
)
def poisson_pmf(spark, folder):
    """P(0..10 goals) of every forecast."""
    return forecasts(spark, folder).select("fixture_id", "model_version_id", F.posexplode(X.poisson_pmf(F.col("home_rate"), 10)).alias("k", "p"))


@query(
    "x2_outcome_from_rates",
    "i:fixture_id,model_version_id d:p_h,p_d,p_a",
    with_sql(
        *CTES,
        """pairs AS (SELECT DISTINCT w_h, w_d, w_a, w_h * w_d AS lh, w_a * 0.5 AS la FROM sc),
        sized AS (SELECT *, CASE WHEN greatest(lh, la) > 10 THEN greatest(10, CAST(ceil(greatest(lh, la) + 5 * sqrt(greatest(lh, la))) AS INT)) ELSE 10 END AS m FROM pairs),
        cells AS (SELECT s.w_h, s.w_d, s.w_a, i, j, exp(-lh + i * ln(lh) - lgamma(i + 1)) * exp(-la + j * ln(la) - lgamma(j + 1)) AS p
          FROM sized s, range(0, 100) AS a(i), range(0, 100) AS b(j) WHERE i <= s.m AND j <= s.m),
        sums AS (SELECT w_h, w_d, w_a, sum(CASE WHEN i > j THEN p ELSE 0 END) AS h, sum(CASE WHEN i = j THEN p ELSE 0 END) AS d,
          sum(CASE WHEN i < j THEN p ELSE 0 END) AS a FROM cells GROUP BY 1, 2, 3)""",
        answer="""SELECT fixture_id, model_version_id, CASE WHEN abs(h + d + a - 1) <= 1e-9 THEN h ELSE h / (h + d + a) END AS p_h,
        CASE WHEN abs(h + d + a - 1) <= 1e-9 THEN d ELSE d / (h + d + a) END AS p_d,
        CASE WHEN abs(h + d + a - 1) <= 1e-9 THEN a ELSE a / (h + d + a) END AS p_a FROM sc JOIN sums USING (w_h, w_d, w_a)""",
    ),
)
def outcome_from_rates(spark, folder):
    """Outcome probabilities from two rates; some rates exceed ten goals, which widens the range."""
    rows = forecasts(spark, folder).withColumn("o", X.outcome_from_rates(F.col("w_h") * F.col("w_d"), F.col("w_a") * 0.5))
    return rows.select("fixture_id", "model_version_id", F.col("o.home").alias("p_h"), F.col("o.draw").alias("p_d"), F.col("o.away").alias("p_a"))


@query(
    "x3_over_under_2_5",
    "i:fixture_id,model_version_id d:over_2_5,under_2_5",
    with_sql(*CTES, """t AS (SELECT *, CASE WHEN w_h = 7 THEN 0 ELSE home_rate END AS lh FROM sc)""",
             answer="""SELECT fixture_id, model_version_id,
    CASE WHEN lh > 0 THEN 1 - exp(-lh - away_rate) * (1 + (lh + away_rate) + pow(lh, 2) / 2 + lh * away_rate + pow(away_rate, 2) / 2) END AS over_2_5,
    CASE WHEN lh > 0 THEN exp(-lh - away_rate) * (1 + (lh + away_rate) + pow(lh, 2) / 2 + lh * away_rate + pow(away_rate, 2) / 2) END AS under_2_5 FROM t"""),
)
def over_under(spark, folder):
    """Over and under 2.5 goals; a rate of zero gives no market."""
    lh = F.when(F.col("w_h") == 7, F.lit(0.0)).otherwise(F.col("home_rate"))
    rows = forecasts(spark, folder).withColumn("o", X.over_under_25(lh, F.col("away_rate")))
    return rows.select("fixture_id", "model_version_id", F.col("o.over").alias("over_2_5"), F.col("o.under").alias("under_2_5"))


@query(
    "x4_both_teams_score",
    "i:fixture_id,model_version_id d:yes,no",
    with_sql(*CTES, answer="""SELECT fixture_id, model_version_id, (1 - exp(-home_rate)) * (1 - exp(-away_rate)) AS yes,
    1 - (1 - exp(-home_rate)) * (1 - exp(-away_rate)) AS no FROM sc"""),
)
def both_score(spark, folder):
    """Both teams score."""
    rows = forecasts(spark, folder).withColumn("o", X.both_score(F.col("home_rate"), F.col("away_rate")))
    return rows.select("fixture_id", "model_version_id", "o.yes", "o.no")


@query(
    "x7_softmax_and_clipped_log",
    "i:fixture_id,model_version_id d:s_h,s_d,s_a,log_clipped",
    with_sql(*CTES, answer="""SELECT fixture_id, model_version_id, exp(w_h - m) / z AS s_h, exp(w_d - m) / z AS s_d, exp(w_a - m) / z AS s_a,
    ln(greatest(1e-15, CASE WHEN w_h = 1 THEN 0 ELSE p_home_win END)) AS log_clipped FROM
    (SELECT *, greatest(w_h, w_d, w_a) AS m, exp(w_h - greatest(w_h, w_d, w_a)) + exp(w_d - greatest(w_h, w_d, w_a)) + exp(w_a - greatest(w_h, w_d, w_a)) AS z FROM sc)"""),
)
def softmax(spark, folder):
    """Softmax of the weights and the clipped logarithm of a probability that may be zero."""
    s = X.softmax3(F.col("w_h"), F.col("w_d"), F.col("w_a"))
    p = F.when(F.col("w_h") == 1, F.lit(0.0)).otherwise(F.col("p_home_win"))
    return forecasts(spark, folder).select(
        "fixture_id", "model_version_id", s[0].alias("s_h"), s[1].alias("s_d"), s[2].alias("s_a"), X.clipped_log(p).alias("log_clipped")
    )


@query("x8_argmax_first_wins", "i:fixture_id,model_version_id,predicted", with_sql(*CTES, answer="SELECT fixture_id, model_version_id, predicted FROM sc"))
def argmax(spark, folder):
    """Predicted class; equal weights go to the first class."""
    return Mx.scored(forecasts(spark, folder))


@query(
    "x15_clamp_and_renormalise",
    "i:fixture_id,model_version_id d:q_h,q_d,q_a",
    with_sql(*CTES, answer="""SELECT fixture_id, model_version_id, a / (a + b + c) AS q_h, b / (a + b + c) AS q_d, c / (a + b + c) AS q_a FROM
    (SELECT *, least(1, greatest(0, w_h / 5 - 0.3)) AS a, least(1, w_d / 4) AS b, least(1, w_a / 5) AS c FROM sc)"""),
)
def clamp(spark, folder):
    """Raw scores clamped to [0,1] and divided by their sum."""
    q = X.normalise3(F.col("w_h") / 5 - 0.3, F.col("w_d") / 4, F.col("w_a") / 5)
    return forecasts(spark, folder).select("fixture_id", "model_version_id", q[0].alias("q_h"), q[1].alias("q_d"), q[2].alias("q_a"))


@query(
    "x13_snapshot_json",
    "i:fixture_id,model_version_id s:snapshot",
    with_sql(*CTES, answer="""SELECT fixture_id, model_version_id, '{"away":' || CAST(CAST(w_a AS BIGINT) AS VARCHAR) || ',"draw":' || CAST(CAST(w_d AS BIGINT) AS VARCHAR)
    || ',"home":' || CAST(CAST(w_h AS BIGINT) AS VARCHAR) || '}' AS snapshot FROM sc"""),
)
def snapshot_json(spark, folder):
    """Feature snapshot of a forecast as JSON text."""
    body = F.to_json(F.struct(*[F.col(c).cast("long").alias(n) for c, n in (("w_a", "away"), ("w_d", "draw"), ("w_h", "home"))]))
    return forecasts(spark, folder).select("fixture_id", "model_version_id", body.alias("snapshot"))


# --- evaluation -----------------------------------------------------------------------------

EVAL_EDGES = (0.0, 0.3, 0.5, 0.7, 0.85, 1.0)
_STORED = """
stored AS (
  SELECT fixture_id * 3 + model_version_id AS prediction_id, fixture_id, model_version_id, p_home_win, p_draw, p_away_win,
         kickoff + INTERVAL '1' HOUR * CAST(w_d - 4 AS INT) AS created_at FROM predictions),
done AS (SELECT prediction_id FROM stored WHERE p_home_win = p_away_win),
evaluated AS (
  SELECT s.prediction_id, s.fixture_id, s.model_version_id, f.competition_id, f.season_id, f.home_goals, f.away_goals,
         CASE WHEN f.home_goals > f.away_goals THEN 0 WHEN f.home_goals = f.away_goals THEN 1 ELSE 2 END AS y,
         CASE WHEN s.p_home_win >= s.p_draw AND s.p_home_win >= s.p_away_win THEN 0 WHEN s.p_draw >= s.p_away_win THEN 1 ELSE 2 END AS p,
         s.p_home_win, s.p_draw, s.p_away_win
  FROM stored s JOIN fin f ON f.fixture_id = s.fixture_id
  WHERE s.created_at < f.kickoff AND s.prediction_id NOT IN (SELECT prediction_id FROM done)),
outcomes AS (
  SELECT *, CASE y WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS actual_result,
         CASE p WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS predicted_result, y = p AS correct,
         pow(p_home_win - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + pow(p_draw - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2)
           + pow(p_away_win - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2) AS brier_score,
         CASE y WHEN 0 THEN p_home_win WHEN 1 THEN p_draw ELSE p_away_win END AS probability_of_truth,
         greatest(p_home_win, p_draw, p_away_win) AS confidence
  FROM evaluated)"""
EVAL_CTES = (MATCHES, FIN, PREDICTIONS, _STORED)


def stored_predictions(spark, folder):
    """Predictions with ids; those with a draw weight above 3 were made at or after kickoff."""
    return T.predictions(spark, folder).select(
        (F.col("fixture_id") * 3 + F.col("model_version_id")).alias("prediction_id"),
        "fixture_id",
        "model_version_id",
        *Mx.P,
        (F.col("kickoff") + F.make_dt_interval(hours=(F.col("w_d") - 4).cast("int"))).alias("created_at"),
    )


def done_outcomes(spark, folder):
    """Predictions that count as evaluated already."""
    return stored_predictions(spark, folder).where(F.col("p_home_win") == F.col("p_away_win")).select("prediction_id", "fixture_id")


def evaluated(spark, folder):
    played = H.finished(T.matches(spark, folder))
    return Rd.evaluate_pending(stored_predictions(spark, folder), played, done_outcomes(spark, folder))


@query(
    "j14_evaluation_join",
    "i:prediction_id,fixture_id,model_version_id",
    with_sql(*EVAL_CTES, answer="SELECT prediction_id, fixture_id, model_version_id FROM evaluated"),
)
def evaluation_join(spark, folder):
    """Predictions made before kickoff of finished matches that have no outcome yet."""
    return evaluated(spark, folder)


@query(
    "a23_outcome_rows",
    "i:prediction_id,actual_home_goals,actual_away_goals s:actual_result,predicted_result b:correct d:brier_score,log_loss,probability_of_truth,confidence",
    with_sql(*EVAL_CTES, answer="""SELECT prediction_id, home_goals AS actual_home_goals, away_goals AS actual_away_goals, actual_result, predicted_result,
    correct, brier_score, -ln(probability_of_truth) AS log_loss, probability_of_truth, confidence FROM outcomes"""),
)
def outcome_rows(spark, folder):
    """Outcome row of each newly evaluated prediction."""
    return evaluated(spark, folder)


_AGG = "count(*) AS prediction_count, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy, avg(brier_score) AS brier_score, avg(-ln(probability_of_truth)) AS log_loss, avg(confidence) AS avg_confidence"


@query(
    "a24_performance_rollup",
    "s:scope i:scope_id,prediction_count d:accuracy,brier_score,log_loss,avg_confidence",
    with_sql(*EVAL_CTES, edges_sql(EVAL_EDGES), answer=f"""SELECT 'overall' AS scope, CAST(NULL AS BIGINT) AS scope_id, {_AGG} FROM outcomes
    UNION ALL SELECT 'bucket', e.bin_id, {_AGG} FROM outcomes o JOIN edges e ON o.confidence >= e.lower AND (o.confidence < e.upper OR (e.closed AND o.confidence <= e.upper)) GROUP BY e.bin_id
    UNION ALL SELECT 'competition', competition_id, {_AGG} FROM outcomes GROUP BY competition_id
    UNION ALL SELECT 'season', season_id, {_AGG} FROM outcomes GROUP BY season_id"""),
)
def performance_rollup(spark, folder):
    """Performance overall, per confidence bucket, per competition and per season."""
    return Mx.performance(evaluated(spark, folder), EVAL_EDGES)


@query(
    "j15_prediction_list_states",
    "i:prediction_id,fixture_id b:evaluated,correct",
    with_sql(*EVAL_CTES, answer="""SELECT s.prediction_id, s.fixture_id, o.prediction_id IS NOT NULL AS evaluated, o.correct
    FROM stored s LEFT JOIN outcomes o USING (prediction_id)"""),
)
def prediction_list(spark, folder):
    """Predictions with their outcome where there is one."""
    return Rd.prediction_list(stored_predictions(spark, folder), evaluated(spark, folder))


@query(
    "j15_prediction_list_correct",
    "i:prediction_id",
    with_sql(*EVAL_CTES, answer="SELECT prediction_id FROM outcomes WHERE correct"),
)
def prediction_list_correct(spark, folder):
    """Evaluated predictions that were right."""
    return Rd.prediction_list(stored_predictions(spark, folder), evaluated(spark, folder), state="evaluated", correct=True)
