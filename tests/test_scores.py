import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.operators import metrics as Mx
from touchline.plans import calibration as Cal

SPEC = "g long, label int, p_home_win double, p_draw double, p_away_win double"


def test_closed_form_scores(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 1.0), (2, 1, 1 / 3, 1 / 3, 1 / 3), (3, 1, 1.0, 0.0, 0.0)], SPEC)
    got = {r["g"]: r for r in Mx.summary(df, ["g"]).collect()}
    assert (got[1]["accuracy"], got[1]["log_loss"], got[1]["brier_multiclass"], got[1]["ece"]) == (1.0, 0.0, 0.0, 0.0)
    assert got[2]["log_loss"] == pytest.approx(math.log(3)) and got[2]["accuracy"] == 0.0  # first class wins the tie
    assert got[3]["log_loss"] == pytest.approx(-math.log(1e-15)) and got[3]["ece"] == 1.0 and got[3]["cm_10"] == 1
    assert Mx.reliability(df, ["g"]).where("g = 1").count() == 10


def test_bins_use_the_float_edges(spark):
    edges = Mx.uniform_edges(10)
    assert edges == list(np.linspace(0, 1, 11))
    xs = [0.3, 0.30000000000000004, 0.6, 0.7, 1.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(Mx.bucket(F.col("x"), edges).alias("b"))
    want = [max(i for i in range(10) if edges[i] <= x) for x in xs]
    assert [r["b"] for r in df.collect()] == want
    for bad in ([0.5], [0.5, 0.4], [0.1, 1.2]):
        with pytest.raises(ValueError):
            Mx.check_edges(bad)
    with pytest.raises(ValueError):
        Mx.uniform_edges(1)


def test_invalid_rows_are_found(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0, 0.5, 0.3, 0.2), (1, 0, 0.5, 0.3, 0.3), (1, 3, 0.5, 0.3, 0.2), (1, 0, nan, 0.5, 0.5), (1, 0, -0.1, 0.6, 0.5)], SPEC)
    assert Mx.bad_rows(df).count() == 4
    goals = spark.createDataFrame([(1, 1.5, 1.0)], "home_goals long, r double, away_goals double")
    with pytest.raises(Exception, match="out of range"):
        Mx.goal_metrics(goals.withColumn("home_goals", F.lit(-1)), [], "r", "r").collect()


@pytest.mark.parametrize("lam", [(1.4, 1.1), (0.2, 3.0), (15.0, 12.0), (40.0, 2.0)])
def test_outcome_from_rates_equals_the_double_sum(spark, lam):
    m = 10 if max(lam) <= 10 else max(10, min(math.ceil(max(lam) + 5 * math.sqrt(max(lam))), 60))
    pmf = [[math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(m + 1)] for x in lam]
    p = [0.0, 0.0, 0.0]
    for i in range(m + 1):
        for j in range(m + 1):
            p[0 if i > j else 1 if i == j else 2] += pmf[0][i] * pmf[1][j]
    total = sum(p)
    want = p if math.isclose(total, 1, abs_tol=1e-9) else [x / total for x in p]
    df = spark.createDataFrame([lam], "h double, a double").select(X.outcome_from_rates(F.col("h"), F.col("a")).alias("o"))
    assert list(df.first()["o"]) == pytest.approx(want, abs=1e-12)


def test_markets_need_positive_rates(spark):
    df = spark.createDataFrame([(0.0, 1.0), (None, 1.0), (float("inf"), 1.0), (1.0, 1.0)], "h double, a double")
    got = df.select(X.over_under_25(F.col("h"), F.col("a")).alias("o"), X.both_score(F.col("h"), F.col("a")).alias("b")).collect()
    assert [r["o"] is None for r in got] == [True, True, True, False]
    assert got[3]["o"]["over"] + got[3]["o"]["under"] == pytest.approx(1) and got[3]["b"]["yes"] == pytest.approx((1 - math.exp(-1)) ** 2)


def sample(spark, n=3000, sharpen=2.0):
    r = np.random.default_rng(3)
    p = r.dirichlet([2, 1, 1.5], n)
    y = [int(r.choice(3, p=q)) for q in p]
    q = p**sharpen
    q /= q.sum(1, keepdims=True)
    return spark.createDataFrame([(1, y[i], *map(float, q[i])) for i in range(n)], SPEC), q, np.array(y)


def nll(q, y, w, b):
    z = np.log(np.clip(q, Cal.CLIP, 1)) @ w.T + b
    z -= z.max(1, keepdims=True)
    s = np.exp(z)
    s /= s.sum(1, keepdims=True)
    return -np.log(s[np.arange(len(y)), y]).mean()


def test_temperature_undoes_sharpening(spark):
    df, q, y = sample(spark)
    t = Cal.fit_temperature(df, ["g"]).first()["temperature"]
    assert 1.6 < t < 2.4
    best = min(np.linspace(0.5, 4, 3501), key=lambda x: nll(q, y, np.eye(3) / x, 0))
    assert t == pytest.approx(best, abs=2e-3)


def test_dirichlet_reaches_a_stationary_point(spark):
    df, q, y = sample(spark)
    r = Cal.fit_dirichlet(df, ["g"]).first()
    assert r["converged"]
    x = np.array(r["x"])
    loss = lambda v: nll(q, y, v[:9].reshape(3, 3), v[9:]) + Cal.L2 * ((v[:9] - np.eye(3).ravel()) ** 2).sum()
    grad = [(loss(x + d) - loss(x - d)) / 2e-5 for d in np.eye(12) * 1e-5]
    assert np.abs(grad).max() < 1e-6


def test_calibrated_rows_stay_simplex_and_choice_follows_error(spark):
    df, *_ = sample(spark)
    params = Cal.fit(df, ["g"])
    assert params.first()["kind"] == "temperature"
    out = Cal.apply(df, params, ["g"])
    assert out.where(~X.is_simplex(*[F.col(c) for c in Mx.P])).count() == 0
    assert Mx.summary(out, ["g"]).first()["ece"] < Mx.summary(df, ["g"]).first()["ece"]


def test_runs_of_different_data_are_not_compared(spark):
    folds = spark.createDataFrame([("a", 0, 5, 0.5, 1.0, 0.1, 0.2)], "run_id string, fold_id int, n_predictions long, accuracy double, log_loss double, ece double, mce double")
    cols = "run_id string, model_name string, model_version string, dataset_version string, iterator_params string"
    ok = spark.createDataFrame([("a", "m", "1", "d", "{}"), ("b", "m", "2", "d", "{}")], cols)
    r = {x["model_version"]: x for x in Mx.compare_runs(folds, ok).collect()}
    assert r["1"]["std_accuracy"] == 0.0 and r["2"]["n_folds"] == 0 and math.isnan(r["2"]["mean_accuracy"])
    with pytest.raises(ValueError):
        Mx.compare_runs(folds, ok.withColumn("dataset_version", F.col("run_id")))


def test_uneven_and_impossible_rates(spark):
    df = spark.createDataFrame([(200.0, 1.0), (1.0, 200.0), (900.0, 1.0), (1.2, 0.9)], "h double, a double")
    r = [x["o"] for x in df.select(X.outcome_from_rates(F.col("h"), F.col("a")).alias("o")).collect()]
    assert r[0]["home"] == pytest.approx(1.0) and r[1]["away"] == pytest.approx(1.0) and r[2]["home"] == 1.0
    assert r[3]["home"] + r[3]["draw"] + r[3]["away"] == pytest.approx(1.0)


def test_summary_refuses_rows_that_are_no_probabilities(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0)], "p_home_win double, p_draw double, p_away_win double, label int")
    with pytest.raises(Exception, match="no probability simplex"):
        Mx.summary(df, []).collect()


@pytest.mark.parametrize("lam", [(5000.0, 5001.0), (1e6, 1e6), (800.0, 790.0), (701.0, 650.0)])
def test_large_rates_have_probabilities(spark, lam):
    df = spark.createDataFrame([lam], "h double, a double").select(X.outcome_from_rates(F.col("h"), F.col("a")).alias("o"))
    o = df.first()["o"]
    assert sum(o) == pytest.approx(1.0, abs=1e-9)
    sd = math.sqrt(sum(lam))
    phi = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    assert o["home"] == pytest.approx(1 - phi((0.5 - lam[0] + lam[1]) / sd), abs=2e-3)
    assert o["draw"] == pytest.approx(math.exp(-((lam[0] - lam[1]) ** 2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi)), rel=0.05)


def test_rates_far_beyond_any_match(spark):
    df = spark.createDataFrame([(1e300, 3.0), (2.0, 1e12), (1e12, 1e12), (10.0, 10.0), (1e-9, 1e-9)], "h double, a double")
    r = [x["o"] for x in df.select(X.outcome_from_rates(F.col("h"), F.col("a")).alias("o")).collect()]
    assert tuple(r[0]) == (1.0, 0.0, 0.0) and tuple(r[1]) == (0.0, 0.0, 1.0) and r[2] is None
    assert r[3]["home"] == pytest.approx(r[3]["away"]) and r[4]["draw"] == pytest.approx(1.0)


def test_many_groups_are_fitted_at_once(spark):
    """Five thousand groups of a few rows; some of them against plain numpy."""
    n = 5_000
    df = spark.range(n * 6).selectExpr("id % 5000 as g", "cast(hash(id) as long) as h", "cast(abs(hash(id, 5)) % 3 as int) as label")
    w = [F.lit(0.2) + F.pmod(F.shiftright("h", 7 * i), F.lit(97)) / 97.0 for i in range(3)]
    df = df.select("g", "label", *[(x / (w[0] + w[1] + w[2])).alias(c) for x, c in zip(w, Mx.P, strict=True)])
    from touchline.session import materialise

    df = materialise(df, "groups")
    t = Cal.fit_temperature(df, ["g"])
    x = Cal.fit_dirichlet(df, ["g"])
    assert t.count() == x.count() == n and t.where("not converged").isEmpty()
    assert x.where("converged").count() > 0.999 * n
    for g in (0, 7, 4_999):
        own = df.where(F.col("g") == g).toPandas()
        q, y = own[list(Mx.P)].to_numpy(), own["label"].to_numpy()
        v = np.array(x.where(F.col("g") == g).first()["x"])
        loss = lambda v, q=q, y=y: nll(q, y, v[:9].reshape(3, 3), v[9:]) + Cal.L2 * ((v[:9] - np.eye(3).ravel()) ** 2).sum()
        assert max(abs(loss(v + d) - loss(v - d)) / 2e-5 for d in np.eye(12) * 1e-5) < 1e-5


@pytest.mark.parametrize("fit", ["fit_temperature", "fit_dirichlet"])
def test_fits_make_their_rows_once(spark, fit):
    """Every Newton step reads stored rows; what made the rows runs once."""
    rows = sample(spark, 400)[0].repartition(3).cache()
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    counted = rows.mapInArrow(count, rows.schema)
    got = getattr(Cal, fit)(counted, ["g"]).collect()
    rows.unpersist()
    assert made.value == 400 and len(got) == 1 and got[0]["converged"]
