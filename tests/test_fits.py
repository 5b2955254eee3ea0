"""Boosted trees and grouped Poisson regressions against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.plans import backtest as Bt
from touchline.plans import boosting as B
from touchline.plans import folds as Fo
from touchline.plans import models as Mo
from touchline.plans.poisson import fit_heads

COLS = ["a", "b", "c"]


def table(spark, n=900, seed=4):
    """Rows with three columns (one with gaps that tell the outcome) and outcomes that depend on them."""
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 1)
    x[:, 1] = r.integers(0, 4, n)
    gone = r.random(n) < 0.3
    y = np.clip(np.floor(x[:, 0] + 0.6 * x[:, 1] + 1.5 * gone + r.normal(size=n) * 0.5), 0, 2).astype(int)
    x[gone, 2] = np.nan
    rows = [(i, 1_000_000 * i, *[None if math.isnan(v) else float(v) for v in x[i]], *[int(y[i] == k) for k in range(3)], int(y[i] == 0) + 1, 1) for i in range(n)]
    df = spark.createDataFrame(rows, "fixture_id long, at long, a double, b double, c double, home_win int, draw int, away_win int, home_goals long, away_goals long")
    return df.withColumn("kickoff", F.timestamp_micros("at")).drop("at").repartition(5), x, y


def same(a: B.Trees, b: B.Trees):
    assert a.start == b.start and len(a.trees) == len(b.trees)
    for (k, t, v), (k2, t2, v2) in zip(a.trees, b.trees, strict=True):
        assert k == k2 and all(np.array_equal(t[c], t2[c]) for c in B.FLAT) and np.array_equal(v, v2)
    assert a.losses == pytest.approx(b.losses, abs=1e-12)


def test_passes_and_tasks_grow_the_same_trees(spark):
    df, *_ = table(spark)
    groups = [
        B.Group((0, 0), B.Growth(rounds=12, leaves=6), 0, 500_000_000),
        B.Group((0, 1), B.Growth(rounds=12, leaves=6), 0, 800_000_000),
        B.Group((1, 0), B.Growth(rounds=4, leaves=3, learning_rate=0.5, curvature=1.5), 100_000_000, 500_000_000),
    ]
    here, spread = B.fit(df, groups, COLS), B.fit(df, groups, COLS, task_rows=0)
    again = B.fit(df.repartition(2), groups, COLS, task_rows=0)
    for g in groups:
        same(here[g.key], spread[g.key])
        same(spread[g.key], again[g.key])
        losses = here[g.key].losses
        assert len(losses) == g.growth.rounds + 1 and all(b < a for a, b in zip(losses, losses[1:], strict=False))


def brute_split(codes, g, h, bins, least):
    best = None
    for j in range(codes.shape[1]):
        for cut in range(bins - 2):
            for missing in (False, True):
                down = np.where(codes[:, j] == bins - 1, missing, codes[:, j] <= cut)
                if min(down.sum(), (~down).sum()) < least:
                    continue
                gain = sum(g[m].sum() ** 2 / h[m].sum() for m in (down, ~down)) - g.sum() ** 2 / h.sum()
                if best is None or gain > best[0] * (1 + 1e-12):
                    best = (gain, j, cut, missing)
    return best


def test_splits_are_the_best_of_all(spark):
    _, x, y = table(spark, 300)
    edges = [np.unique(x[~np.isnan(x[:, j]), j])[:6] for j in range(3)]
    codes = B.to_bins(x, edges, 8)
    g, h = B.gradients(np.tile(B.start_scores(np.bincount(y).tolist()), (300, 1)), y, 1, 1.0)
    growth = B.Growth(bins=8, min_leaf=15)
    got = B.best_split(B.histogram(codes, g, h, 8), growth)
    gain, j, cut, missing = brute_split(codes, g, h, 8, 15)
    assert (got["feature"], got["cut"], got["missing_left"]) == (j, cut, missing) and got["gain"] * B.UNIT == pytest.approx(gain)


def test_groups_do_not_wait_for_each_other(spark):
    """Every group has a partition of its own; a hash of the group's number put both boosters into one."""
    data = spark.range(90).select((F.col("id") % 3).cast("int").alias("label"), F.col("id").alias("at"), F.lit(b"x").alias("bins"))
    for groups in ([B.Group((i,), B.Growth()) for i in range(2)], [B.Group((i,), B.Growth(), 0, 3 * i) for i in range(30)]):
        dealt = B.deal(data, groups).groupBy("job", F.spark_partition_id().alias("part")).count().collect()
        assert sorted((r["job"], r["part"]) for r in dealt) == [(i, i) for i in range(len(groups))]
        assert all(r["count"] == (90 if groups[r["job"]].high is None else min(90, groups[r["job"]].high + 1)) for r in dealt)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_histograms_of_several_nodes_are_plain_sums(width):
    """By pairs of columns (many rows for the bins), column by column (few), and all rows at once."""
    r = np.random.default_rng(width)
    for n, bins in ((4000, 8), (300, 64)):
        codes = r.integers(0, bins, (n, width)).astype(np.uint8)
        g, h = np.rint(r.normal(size=n) * B.UNIT), np.rint(r.random(n) * B.UNIT)
        node = r.integers(0, 4, n)
        for nodes in ([np.arange(n)], [np.flatnonzero(node == k) for k in range(3)], [np.flatnonzero(node == 1), np.arange(0)]):
            got = B.Cells(codes, bins).add_up(nodes, g, h)
            want = np.zeros((len(nodes), 3, width, bins))
            for k, rows in enumerate(nodes):
                for j in range(width):
                    for i, w in enumerate((g, h, np.ones(n))):
                        np.add.at(want[k, i, j], codes[rows, j], w[rows])
            assert np.array_equal(got, want)
            both = B.best_splits(got, B.Growth(bins=bins))
            assert both == [B.best_split(x, B.Growth(bins=bins)) for x in want] and both[0] is not None


def test_columns_of_few_bins_are_counted_together():
    """Cells hold as many columns as their bins in use allow; sums are those of every column alone."""
    r = np.random.default_rng(3)
    bins, sizes = 64, [64, 64, 5, 6, 3, 12, 64, 2]
    n = 60_000
    codes = np.stack([r.integers(0, s, n) for s in sizes], axis=1)
    codes = np.where(codes == np.array(sizes) - 1, bins - 1, codes).astype(np.uint8)
    cells = B.Cells(codes, bins, sizes)
    assert sorted(j for pack in cells.layout.packs for j in pack) == list(range(len(sizes))) and len(cells.layout.packs) == 3
    g, h = np.rint(r.normal(size=n) * B.UNIT), np.rint(r.random(n) * B.UNIT).astype(np.int32)
    for nodes in ([np.arange(n)], [np.flatnonzero(r.random(n) < share) for share in (0.5, 0.3, 0.2)], [np.arange(9), np.arange(40, 70)]):
        got = cells.add_up(nodes, g, h)
        for k, rows in enumerate(nodes):
            for j in range(len(sizes)):
                for i, w in enumerate((g, h, None)):
                    assert np.array_equal(got[k, i, j], np.bincount(codes[rows, j], None if w is None else w[rows], bins))
    for j in range(len(sizes)):
        code, gone = cells.code(j, np.arange(n))
        assert np.array_equal(np.where(code == gone, bins - 1, code), codes[:, j])


def test_rows_reach_their_leaves():
    """All leaves, or only those asked for; a cut above every value still sends missing values to their side."""
    codes = np.array([[0, 1], [3, 7], [7, 0], [2, 2], [7, 7], [1, 7]], np.uint8)
    tree = B.Tree()
    for node, feature, cut, missing in ((0, 0, 1, False), (2, 0, 6, False), (1, 1, 1, True)):
        tree.split(node, {"feature": feature, "cut": cut, "missing_left": missing, "gain": 1.0, "below": (0.0, 1.0, 1.0), "above": (0.0, 1.0, 1.0)})
    cells, every = B.Cells(codes, 8), np.arange(6)
    assert {n: rows.tolist() for n, rows in B.reach(cells.code, every, tree).items()} == {3: [1, 3], 4: [2, 4], 5: [0, 5], 6: []}
    assert {n: rows.tolist() for n, rows in B.reach(cells.code, every, tree, [4]).items()} == {4: [2, 4]}
    few = B.Cells(np.minimum(codes, 4), 8, [5, 5])
    assert [rows.tolist() for _, rows in sorted(B.reach(few.code, every, tree).items())] == [[1, 3], [2, 4], [0, 5], []]


def test_a_pass_is_one_job(spark, monkeypatch):
    """Every pass reads the blocks once, with the slopes of its round; written scores are removed when they are replaced."""
    import os

    monkeypatch.setattr(B, "HELD", 1)
    df, *_ = table(spark)
    sc, group = spark.sparkContext, B.Group((0,), B.Growth(rounds=6, leaves=6))
    sc.setJobGroup("passes", "passes")
    try:
        spread = B.fit(df, [group], COLS, task_rows=0)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    passes, written = 6 * 4, 5
    assert len(sc.statusTracker().getJobIdsForGroup("passes")) <= passes + written + 15
    same(B.fit(df, [group], COLS)[(0,)], spread[(0,)])
    found = [d for _, dirs, _ in os.walk(sc.getCheckpointDir().removeprefix("file:")) for d in dirs if d.startswith("rdd-")]
    assert not found and not sc._jsc.getPersistentRDDs()


def test_rows_without_an_instant_are_in_groups_without_bounds_only(spark):
    df, *_ = table(spark)
    df = df.withColumn("kickoff", F.when(F.col("fixture_id") % 7 != 0, F.col("kickoff")))
    groups = [B.Group((i,), B.Growth(rounds=2, leaves=4), low, high) for i, (low, high) in enumerate([(None, None), (None, 700_000_000), (100_000_000, None)])]
    here, spread = B.fit(df, groups, COLS), B.fit(df, groups, COLS, task_rows=0)
    for g in groups:
        same(here[g.key], spread[g.key])
    assert here[(0,)].trees[0][1]["rows"][0] == 900 > here[(1,)].trees[0][1]["rows"][0]


def test_missing_values_learn_their_side_and_trees_keep_their_budget(spark):
    df, x, y = table(spark)
    m = B.fit(df, [B.Group((0,), B.Growth(rounds=30, leaves=5))], COLS)[(0,)]
    assert any(t["missing_left"][(t["feature"] == 2)].any() for _, t, _ in m.trees) and any((~t["missing_left"][t["feature"] == 2]).any() for _, t, _ in m.trees)
    assert all((t["feature"] == -1).sum() <= 5 and t["rows"][t["feature"] == -1].min() >= 20 for _, t, _ in m.trees if len(t["feature"]) > 1)
    p = m.probabilities(x.astype(np.float32).astype(float))
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.75
    scored = {r["fixture_id"]: r for r in B.forecast(df, {(7,): m}, {"trial": "int"}, ["fixture_id"]).collect()}
    assert np.allclose([[scored[i][c] for c in Mo.P] for i in range(len(y))], p)
    back = B.Trees.from_dict(m.as_dict())
    assert np.array_equal(back.probabilities(x), m.probabilities(x))


def test_one_class_and_bad_parameters(spark):
    df, *_ = table(spark, 60)
    one = df.withColumns({"home_win": F.lit(1), "draw": F.lit(0), "away_win": F.lit(0)})
    for rows in (60, 0):
        with pytest.raises(Exception, match="fewer than two classes"):
            B.fit(one, [B.Group((0,), B.Growth(rounds=2))], COLS, task_rows=rows)
    two = df.where("away_win = 0")
    p = B.fit(two, [B.Group((0,), B.Growth(rounds=3, min_leaf=5))], COLS)[(0,)].probabilities(np.zeros((1, 3)))
    assert p[0, 2] < 1e-9
    with pytest.raises(ValueError, match="no training rows"):
        B.fit(df, [B.Group((0,), B.Growth(rounds=2), -2, -1)], COLS)
    for bad in (dict(leaves=1), dict(rounds=0), dict(learning_rate=0.0), dict(bins=500)):
        with pytest.raises(ValueError):
            B.Growth(**bad).check()
    with pytest.raises(ValueError, match="unknown booster parameters"):
        Mo.trainer("lightgbm", depth=3).growth()


def features(spark, n=500, seed=1):
    r = np.random.default_rng(seed)
    rows, order = [], list(N.FEATURES)
    for i in range(n):
        vals = {c: float(np.float32(r.normal())) for c in order}
        goals = [int(r.poisson(math.exp(0.2 + 0.3 * vals[f"{s}_elo_pre_match"]))) for s in N.SIDES]
        if i % 11 == 0:
            vals["h2h_draws"] = None
        win = (goals[0] > goals[1], goals[0] == goals[1], goals[0] < goals[1])
        rows.append((i, 86_400_000_000 * (i // 3), *[vals[c] for c in order], *[int(w) for w in win], *goals))
    df = spark.createDataFrame(rows, "fixture_id long, at long, " + ", ".join(f"{c} double" for c in order) + ", home_win int, draw int, away_win int, home_goals long, away_goals long")
    return df.withColumn("kickoff", F.timestamp_micros("at")).drop("at").repartition(3)


def test_heads_of_all_folds_equal_fits_on_their_rows(spark):
    df = features(spark)
    micro = 86_400_000_000
    folds = {0: (0, 60 * micro), 1: (0, 120 * micro), 2: (50 * micro, 160 * micro)}
    together = fit_heads(df, folds, 0.05)
    pdf = df.withColumn("at", F.unix_micros("kickoff")).toPandas()
    for f, (low, high) in folds.items():
        part = pdf[(pdf["at"] >= low) & (pdf["at"] <= high)]
        for s in N.SIDES:
            head = together[f][s]
            whole = part.dropna(subset=N.HEAD[s])
            x, y = whole[N.HEAD[s]].to_numpy(dtype=float), whole[f"{s}_goals"].to_numpy(dtype=float)
            mu = np.exp(x @ head.coefficients + head.intercept)
            assert np.abs((mu - y) @ x / len(y) + 0.05 * head.coefficients).max() < 1e-8 and abs((mu - y).mean()) < 1e-8
            assert head.means["h2h_draws"] == pytest.approx(part["h2h_draws"].mean())
    with pytest.raises(ValueError, match="home head of fold 5"):
        fit_heads(df, {5: (-9, -1)}, 0.05)


def test_search_and_backtests_score_each_fold_on_later_rows(spark):
    df = features(spark, 600)
    params = Fo.FoldParams(min_train_size=198, test_size=60, gap_days=1, val_ratio=0.2)
    folds = Fo.walk_forward(df, params)
    trials = [{"rounds": 4, "leaves": 4}, {"rounds": 8, "leaves": 3, "learning_rate": 0.2}]
    got = Bt.search(df, params, "gradient_boosting", trials).collect()
    assert sorted(r["trial"] for r in got) == [0, 1] and got[0]["weighted_log_loss"] <= got[1]["weighted_log_loss"]
    alone = Bt.search(df, params, "gradient_boosting", trials[1:]).first()
    assert alone["weighted_log_loss"] == pytest.approx(next(r for r in got if r["trial"] == 1)["weighted_log_loss"], abs=1e-12)
    for name in ("poisson", "lightgbm"):
        raw = Bt.forecast_folds(df, folds, name)
        sizes = {(r["fold_id"], r["block"]): r["count"] for r in raw.groupBy("fold_id", "block").count().collect()}
        assert sizes == {(f["fold_id"], b): f[f"n_{b}"] for f in folds for b in ("val", "test")}
    one = Mo.PoissonTrainer().fit_folds(df, {0: (folds[0]["train_start"], folds[0]["train_end"])})[0]
    direct = {r["fixture_id"]: r["p_draw"] for r in one.transform(df).collect()}
    raw = Bt.forecast_folds(df, folds, "poisson").where("fold_id = 0").collect()
    assert all(direct[r["fixture_id"]] == pytest.approx(r["p_draw"], abs=1e-12) for r in raw)


def test_data_without_a_fold_give_empty_results(spark, tmp_path):
    """The first kickoff group that crosses the wanted train size ends the walk: no fold, which is no error."""
    from touchline.sources import runs as R

    df = features(spark, 60)
    params = Fo.FoldParams(min_train_size=20, test_size=6, gap_days=1, val_ratio=0.15)  # kickoffs in threes: row 20 splits a group
    assert Fo.walk_forward(df, params) == []
    full = Fo.walk_forward(df, Fo.FoldParams(min_train_size=21, test_size=6, gap_days=1, val_ratio=0.15))
    for name in ("elo_baseline", "poisson", "gradient_boosting"):
        got = Bt.run_backtest(df, params, name, "v1", "d1")
        assert got["folds"] == [] and got["reports"].count() == 0 and got["predictions"].count() == 0
        assert {"fold_id", "accuracy", "rmse_total_goals"} <= set(got["reports"].columns)
    whole = Bt.forecast_folds(df, full, "poisson")
    assert [(f.name, f.dataType) for f in Bt.no_forecasts(df).schema] == [(f.name, f.dataType) for f in whole.schema]
    both = Bt.run_all(df, params, ["elo_baseline", "poisson"], "v1", "d1", R.RunStore(spark, str(tmp_path / "runs"))).collect()
    assert [(r["model_name"], r["n_folds"], r["total_n_predictions"]) for r in both] == [("elo_baseline", 0, 0), ("poisson", 0, 0)]
    assert all(math.isnan(r["mean_accuracy"]) for r in both)
    trials = [{"rounds": 4}, {"rounds": 8}]
    assert [(r["trial"], r["weighted_log_loss"]) for r in Bt.search(df, params, "gradient_boosting", trials).collect()] == [(0, math.inf), (1, math.inf)]
    with pytest.raises(ValueError, match="unknown model"):
        Bt.forecast_folds(df, [], "nothing")
