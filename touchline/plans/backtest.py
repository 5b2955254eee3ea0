"""Walk-forward backtest: per fold train, calibrate on validation, score the test block."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import scalars as X
from touchline.operators import metrics as Mx
from touchline.plans import boosting as B
from touchline.plans import calibration as Cal
from touchline.plans import folds as Fo
from touchline.plans import models as Mo
from touchline.session import materialise
from touchline.sources import runs as R

_KEEP = ["fixture_id", "kickoff", "home_goals", "away_goals", *Mx.P]
_EXPECTED = [f"expected_{s}_goals" for s in N.SIDES]


def _blocks(folds: list[dict]) -> dict[int, list[tuple[str, int, int]]]:
    """Kickoff intervals of the validation and test block of every fold."""
    return {f["fold_id"]: [(b, f[f"{b}_start"], f[f"{b}_end"]) for b in ("val", "test")] for f in folds}


def boosted_forecasts(rows: DataFrame, folds: list[dict], trials: Sequence[dict], name: str) -> DataFrame:
    """Raw forecasts of every (trial, fold) of a booster; all are fitted in the same passes."""
    fits = [B.Group((t, f["fold_id"]), B.growth_of(Mo.BOOSTING[name], hyper), f["train_start"], f["train_end"]) for t, hyper in enumerate(trials) for f in folds]
    models = B.fit(rows, fits)
    blocks = _blocks(folds)
    known = rows.withColumn("label", X.target_label(*[F.col(c) for c in N.TARGETS]))
    keep = ["fixture_id", "kickoff", "home_goals", "away_goals", "label"]
    out = B.forecast(known, models, {"trial": "long", "fold_id": "long"}, keep, {key: blocks[key[1]] for key in models})
    none = [F.lit(None).cast("double").alias(f"expected_{s}_goals") for s in N.SIDES]
    return out.select("trial", "fold_id", "block", *_KEEP, *none, "label")


def poisson_forecasts(rows: DataFrame, folds: list[dict], **hyper) -> DataFrame:
    """Raw forecasts of the Poisson regressions of all folds: one set of Newton passes, then one pass over the rows."""
    models = Mo.PoissonTrainer(**hyper).fit_folds(rows, {f["fold_id"]: (f["train_start"], f["train_end"]) for f in folds})
    lines = []
    for f, m in models.items():
        weights = [[m.heads[s].intercept, *m.heads[s].coefficients.tolist()] for s in N.SIDES]
        lines.append((f, *weights, *[[m.heads[s].means[c] for c in N.HEAD[s]] for s in N.SIDES]))
    table = rows.sparkSession.createDataFrame(lines, "fold_id long, w_home array<double>, w_away array<double>, m_home array<double>, m_away array<double>")
    member = Fo.membership(rows, Fo.fold_table(rows.sparkSession, folds), ("val", "test")).join(table, "fold_id")
    rates = []
    for s in N.SIDES:
        eta = F.col(f"w_{s}")[0]
        for i, c in enumerate(N.HEAD[s]):
            eta = eta + F.col(f"w_{s}")[i + 1] * F.coalesce(F.col(c).cast("float").cast("double"), F.col(f"m_{s}")[i])
        rates.append(Mo.usable_rate(F.exp(eta)))
    scored = Mo.with_rates(member, *rates, next(iter(models.values())).max_goals)
    label = X.target_label(*[F.col(c) for c in N.TARGETS]).alias("label")
    return scored.select("fold_id", "block", *_KEEP, "expected_home_goals", "expected_away_goals", label)


def no_forecasts(rows: DataFrame) -> DataFrame:
    """Forecasts of no fold: no rows, with the columns of the others."""
    label = X.target_label(*[F.col(c) for c in N.TARGETS]).alias("label")
    doubles = [F.lit(0.0).alias(c) for c in (*Mx.P, *_EXPECTED)]
    wide = rows.select(F.lit(0).cast("long").alias("fold_id"), F.lit("").alias("block"), *[c for c in _KEEP if c not in Mx.P], *doubles, label)
    return rows.sparkSession.createDataFrame([], wide.select("fold_id", "block", *_KEEP, *_EXPECTED, "label").schema)


def forecast_folds(rows: DataFrame, folds: list[dict], name: str, **hyper) -> DataFrame:
    """Raw forecasts of every fold's validation and test block, written once; all folds are fitted together.

    No fold is a valid outcome of the walk: it gives no forecasts.
    """
    if name not in Mo.TRAINERS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(Mo.TRAINERS)}")
    if not folds:
        return no_forecasts(rows)
    if name == "elo_baseline":
        made = elo_forecast_folds(rows, folds, **hyper)
    elif name == "poisson":
        made = poisson_forecasts(rows, folds, **hyper)
    else:
        made = boosted_forecasts(rows, folds, [hyper], name).drop("trial")
    return materialise(made, f"forecast-{name}")


def elo_forecast_folds(rows: DataFrame, folds: list[dict], max_goals: int = 10) -> DataFrame:
    """All folds of the rating baseline in three passes: intercepts, grid losses, forecasts.

    One row per fold goes to and fro; Spark broadcasts those tables when their size allows it.
    """
    spark = rows.sparkSession
    bounds = Fo.fold_table(spark, folds)
    valid = Mo.with_valid_elo(rows)
    betas = Mo.fold_intercepts(Fo.train_sums(valid, bounds, [f"{s}_goals" for s in N.SIDES]))
    member = Fo.membership(valid, bounds, ("val", "test"))
    val = member.where(F.col("block") == "val").join(betas, "fold_id")
    params = []
    for r in Mo.elo_grid_losses(val, ["fold_id"], max_goals).collect():
        (hfa, beta), loss = Mo.pick_grid_point(r)
        params.append((r["fold_id"], r["beta_0_home"], r["beta_0_away"], float(hfa), beta, loss))
    table = spark.createDataFrame(params, "fold_id long, b_h double, b_a double, hfa double, b_1 double, val_log_loss double")
    home, away = Mo.elo_rates(*[F.col(c) for c in ("b_h", "b_a", "hfa", "b_1")])
    wanted = member.join(table, "fold_id")
    return Mo.with_rates(wanted, home, away, max_goals).select(
        "fold_id",
        "block",
        *_KEEP,
        "expected_home_goals",
        "expected_away_goals",
        X.target_label(*[F.col(c) for c in N.TARGETS]).alias("label"),
    )


def calibrate(forecasts: DataFrame, by: Sequence[str] = ("fold_id",)) -> tuple[DataFrame, DataFrame]:
    """(calibrated test rows, calibrator table); calibrators see validation rows only."""
    params = Cal.fit(forecasts.where(F.col("block") == "val"), list(by))
    return Cal.apply(forecasts.where(F.col("block") == "test"), params, list(by)), params


def fold_reports(test: DataFrame, by: Sequence[str] = ("fold_id",)) -> DataFrame:
    """Every scalar metric and the confusion matrix per fold; goal metrics where the model gives rates."""
    out = Mx.summary(test, list(by))
    rated = test.where(F.col("expected_home_goals").isNotNull())
    goals = Mx.goal_metrics(rated, list(by), "expected_home_goals", "expected_away_goals").drop("n")
    return out.join(goals, list(by), "left")


def run_backtest(
    rows: DataFrame, params: Fo.FoldParams, name: str, version: str, dataset_version: str, seed: int = 42, store: R.RunStore | None = None, **hyper
) -> dict:
    """One model over all folds: forecasts, calibrators, fold reports, optionally stored."""
    folds = Fo.walk_forward(rows, params)
    raw = forecast_folds(rows, folds, name, **hyper)
    test, calibrators = calibrate(raw)
    reports = fold_reports(test)
    rid = R.run_id(dataset_version, params.config(), name, version, seed)
    result = {"run_id": rid, "folds": folds, "predictions": test, "calibrators": calibrators, "reports": reports}
    if store is not None:
        spark = rows.sparkSession
        tag = F.lit(rid).alias("run_id")
        config = spark.createDataFrame(
            [(rid, name, version, dataset_version, json.dumps(params.config(), sort_keys=True), seed)],
            "run_id string, model_name string, model_version string, dataset_version string, iterator_params string, seed long",
        )
        store.save("configs", config)
        store.save("predictions", test.select(tag, "*"))
        store.save("calibrators", calibrators.select(tag, "*"))
        store.save("fold_metrics", reports.select(tag, "*"))
        store.save("summaries", reports.groupBy().agg(F.count("*").alias("n_folds")).select(tag, "*"))
    return result


def run_all(rows: DataFrame, params: Fo.FoldParams, names: Sequence[str], version: str, dataset_version: str, store: R.RunStore, **hyper) -> DataFrame:
    """Several models on identical folds, then their comparison."""
    for n in names:
        run_backtest(rows, params, n, version, dataset_version, store=store, **hyper.get(n, {}))
    return Mx.compare_runs(store.load("fold_metrics"), store.load("configs"))


# Search space: bounds per hyperparameter, log scale for the learning rate.
SEARCH = {"learning_rate": (0.01, 0.1), "leaves": (15, 63), "rounds": (50, 150)}


def candidates(trials: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """Seeded random candidates inside the bounds."""
    import math
    import random

    draw = random.Random(seed)
    out = []
    for _ in range(trials):
        c = {}
        for k, (lo, hi) in (space or SEARCH).items():
            if isinstance(lo, int) and isinstance(hi, int):
                c[k] = draw.randint(lo, hi)
            elif k == "learning_rate":
                c[k] = math.exp(draw.uniform(math.log(lo), math.log(hi)))
            else:
                c[k] = draw.uniform(lo, hi)
        out.append(c)
    return out


def search(rows: DataFrame, params: Fo.FoldParams, name: str, trials: Sequence[dict], metric: str = "weighted_log_loss") -> DataFrame:
    """Score of every candidate on the same folds, best first. Candidates of a booster share their passes with all folds.

    Without a fold every candidate has the worst score, an infinite one.
    """
    folds = Fo.walk_forward(rows, params)
    names = rows.sparkSession.createDataFrame([(t, json.dumps(h, sort_keys=True)) for t, h in enumerate(trials)], "trial long, hyperparameters string")
    best_first = F.desc(metric) if "accuracy" in metric else F.asc(metric)
    if not folds:
        worst = F.lit(float("-inf" if "accuracy" in metric else "inf"))
        return names.select("trial", "hyperparameters", worst.alias(metric)).orderBy("trial")
    if name in Mo.BOOSTING:
        raw = materialise(boosted_forecasts(rows, folds, trials, name), f"search-{name}")
    else:
        parts = [forecast_folds(rows, folds, name, **hyper).select(F.lit(t).cast("long").alias("trial"), "*") for t, hyper in enumerate(trials)]
        raw = reduce(DataFrame.unionByName, parts)
    by = ["trial", "fold_id"]
    test, _ = calibrate(raw, by)
    scores = Mx.fold_metric(Mx.summary(test, by), ["trial"], metric)
    return scores.join(F.broadcast(names), "trial").select("trial", "hyperparameters", metric).orderBy(best_first, "trial")


def train_final(rows: DataFrame, name: str, version: str, dataset_version: str, registry: R.ModelRegistry, now: str, seed: int = 42, **hyper):
    """Fit on all rows and register."""
    model = Mo.trainer(name, **hyper).fit(rows, None, seed)
    cutoff = str(rows.agg(F.max("kickoff")).first()[0])
    registry.save(model, version, dataset_version, cutoff, now, seed, N.ELO if name == "elo_baseline" else N.FEATURES)
    return model
