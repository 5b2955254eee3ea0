import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from touchline.plans import folds as Fo


def rows(seed, n):
    r = random.Random(seed)
    at, out = datetime(2021, 1, 1, tzinfo=UTC), []
    for i in range(n):
        if r.random() > 0.3:
            at += timedelta(hours=r.choice([1, 5, 30, 80]))
        out.append((i, at))
    return out


def by_index(kicks, p: Fo.FoldParams):
    """The same walk written over row positions."""
    n, gap, out = len(kicks), timedelta(days=p.gap_days), []
    lo, hi = 0, p.min_train_size - 1
    while hi < n:
        while hi >= 0 and hi + 1 < n and kicks[hi + 1] == kicks[hi]:
            hi -= 1
        if hi - lo + 1 < p.min_train_size:
            break
        after = lambda i: next((j for j in range(i + 1, n) if kicks[j] - kicks[i] >= gap and kicks[j] > kicks[i]), None)
        grow = lambda i: next((j for j in range(i, n) if j + 1 == n or kicks[j + 1] != kicks[i]), None)
        v = after(hi)
        size = p.val_size or max(1, round((hi - lo + 1) * p.val_ratio))
        if v is None or v + size - 1 >= n:
            break
        ve = grow(v + size - 1)
        t = after(ve)
        if t is None or t + p.test_size - 1 >= n:
            break
        te = grow(t + p.test_size - 1)
        out.append((hi - lo + 1, kicks[lo], kicks[hi], kicks[v], kicks[ve], kicks[t], kicks[te]))
        if te >= n - 1:
            break
        if p.mode == "sliding":
            lo = max(0, te - p.min_train_size + 1)
            while lo > 0 and kicks[lo] == kicks[lo - 1]:
                lo -= 1
        hi = te
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("mode", ["expanding", "sliding"])
def test_bounds_equal_an_index_walk(spark, seed, mode):
    data = rows(seed, 160)
    df = spark.createDataFrame(data, "fixture_id long, kickoff timestamp")
    p = Fo.FoldParams(min_train_size=30 + seed, test_size=11, gap_days=seed % 2, mode=mode, val_ratio=0.2)
    got = Fo.walk_forward(df, p)
    micro = lambda t: int(t.timestamp() * 1_000_000)
    want = by_index([k for _, k in data], p)
    assert [(f["n_train"], *[f[c] for c in ("train_start", "train_end", "val_start", "val_end", "test_start", "test_end")]) for f in got] == [
        (w[0], *map(micro, w[1:])) for w in want
    ]


def test_too_few_rows_and_bad_parameters(spark):
    df = spark.createDataFrame(rows(1, 20), "fixture_id long, kickoff timestamp")
    assert Fo.walk_forward(df, Fo.FoldParams(min_train_size=50)) == []
    for bad in (dict(min_train_size=0), dict(val_ratio=None), dict(val_size=3), dict(mode="other"), dict(val_ratio=1.0)):
        with pytest.raises(ValueError):
            Fo.walk_forward(df, Fo.FoldParams(**bad))


def test_future_rows_do_not_move_earlier_folds_and_train_sums_need_no_copies(spark):
    data = rows(9, 150)
    p = Fo.FoldParams(min_train_size=40, test_size=10, gap_days=0, val_ratio=0.2)
    df = spark.createDataFrame(data, "fixture_id long, kickoff timestamp")
    folds = Fo.walk_forward(df, p)
    more = data + [(1000 + i, data[-1][1] + timedelta(days=i + 1)) for i in range(40)]
    assert Fo.walk_forward(spark.createDataFrame(more, df.schema), p)[: len(folds)] == folds
    bounds = Fo.fold_table(spark, folds)
    a = Fo.membership(df, bounds).select("fold_id", "fixture_id", "block")
    assert "NestedLoop" not in a._jdf.queryExecution().toString()
    sums = {r["fold_id"]: (r["n"], r["fixture_id"]) for r in Fo.train_sums(df, bounds, ["fixture_id"]).collect()}
    want = {r["fold_id"]: (r["n"], r["s"]) for r in a.where("block = 'train'").groupBy("fold_id").agg(F.count("*").alias("n"), F.sum("fixture_id").alias("s")).collect()}
    assert sums == want
    sizes = {(r["fold_id"], r["block"]): r["count"] for r in a.groupBy("fold_id", "block").count().collect()}
    for f in folds:
        assert [sizes[(f["fold_id"], x)] for x in ("train", "val", "test")] == [f["n_train"], f["n_val"], f["n_test"]]
    assert a.groupBy("fold_id", "fixture_id").count().where(F.col("count") > 1).count() == 0
