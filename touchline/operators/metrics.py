"""Scores of probability forecasts: every metric is one grouped pass over the rows.

Rows carry ``label`` (0 home, 1 draw, 2 away) and ``p_home_win``, ``p_draw``, ``p_away_win``. Sums are
formed per (group, confidence bin) with map-side partial aggregation, so a group that holds most
rows costs no more than many small ones; all metrics are then read off that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalars as X

P = ("p_home_win", "p_draw", "p_away_win")
CONFIDENCE_EDGES = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def uniform_edges(n_bins: int) -> list[float]:
    """Bin edges as doubles i * (1/n); the upper end is exactly 1."""
    if n_bins < 2:
        raise ValueError(f"n_bins must be at least 2, got {n_bins}")
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def check_edges(edges: Sequence[float]) -> list[float]:
    out = [float(e) for e in edges]
    if len(out) < 2 or any(not 0.0 <= e <= 1.0 for e in out) or any(a >= b for a, b in zip(out, out[1:])):
        raise ValueError(f"edges must rise strictly inside [0, 1], got {list(edges)}")
    return out


def bucket(x: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open bucket that holds ``x``; the last one is closed; NULL outside."""
    out = F.when(x < F.lit(edges[0]), F.lit(None).cast("int"))
    for i, high in enumerate(edges[1:]):
        out = out.when((x <= F.lit(high)) if i == len(edges) - 2 else (x < F.lit(high)), F.lit(i))
    return out


def scored(rows: DataFrame) -> DataFrame:
    """Per-row terms: predicted class, confidence, hit, log loss and squared errors per class."""
    p = [F.col(c) for c in P]
    label = F.col("label")
    hit = (F.col("predicted") == label).cast("double")
    return rows.withColumn("predicted", X.argmax3(*p)).withColumns(
        {
            "confidence": F.greatest(*p),
            "hit": hit,
            "row_log_loss": -X.clipped_log(X.pick3(label, *p)),
            **{f"sq_{i}": F.pow(p[i] - (label == i).cast("double"), F.lit(2.0)) for i in range(3)},
        }
    )


def bad_rows(rows: DataFrame) -> DataFrame:
    """Rows that are no probability simplex or carry no valid class."""
    ok = X.is_simplex(*[F.col(c) for c in P]) & F.coalesce(F.col("label").isin(0, 1, 2), F.lit(False))
    return rows.where(~ok)


def validated(rows: DataFrame) -> DataFrame:
    """The same rows; one that ``bad_rows`` would list raises when it is read."""
    ok = X.is_simplex(*[F.col(c) for c in P]) & F.coalesce(F.col("label").isin(0, 1, 2), F.lit(False))
    wrong = F.raise_error(F.lit("row is no probability simplex or has no valid class"))
    return rows.withColumn(P[0], F.when(ok, F.col(P[0])).otherwise(wrong.cast("double")))


def goal_terms(home_rate: str, away_rate: str) -> dict[str, Column]:
    """Per-row goal errors against expected goals, and the Poisson log-likelihood of the score."""
    yh, ya = F.col("home_goals").cast("double"), F.col("away_goals").cast("double")
    lh, la = F.col(home_rate), F.col(away_rate)

    def loglik(y: Column, rate: Column) -> Column:
        return -rate + y * F.log(F.greatest(rate, F.lit(X.EPS))) - X.log_factorial(y)

    return {
        "abs_home": F.abs(yh - lh),
        "abs_away": F.abs(ya - la),
        "sq_home": F.pow(yh - lh, F.lit(2.0)),
        "sq_away": F.pow(ya - la, F.lit(2.0)),
        "sq_total": F.pow(yh + ya - lh - la, F.lit(2.0)),
        "loglik": loglik(yh, lh) + loglik(ya, la),
    }


def pmf_loglik(goals: Column, pmf: Column, eps: float = X.EPS) -> Column:
    """Log-probability of an observed count in a pmf map; an absent count has probability eps."""
    return F.log(F.greatest(F.coalesce(F.try_element_at(pmf, goals.cast("int")), F.lit(eps)), F.lit(eps)))


def goal_metrics(rows: DataFrame, by: Sequence[str], home_rate: str, away_rate: str) -> DataFrame:
    """MAE, RMSE and mean Poisson log-likelihood per group; rows with invalid goals or rates raise."""
    ok = X.is_goal_count(F.col("home_goals")) & X.is_goal_count(F.col("away_goals"))
    ok = ok & X.finite(F.col(home_rate)) & X.finite(F.col(away_rate)) & (F.col(home_rate) > 0) & (F.col(away_rate) > 0)
    guard = F.when(ok, F.lit(1)).otherwise(F.raise_error(F.lit("goal row out of range")).cast("int"))
    t = rows.withColumns(goal_terms(home_rate, away_rate)).withColumn("_ok", guard)
    return t.groupBy(*by).agg(
        F.sum("_ok").cast("long").alias("n"),
        F.avg("abs_home").alias("mae_home_goals"),
        F.avg("abs_away").alias("mae_away_goals"),
        F.sqrt(F.avg("sq_home")).alias("rmse_home_goals"),
        F.sqrt(F.avg("sq_away")).alias("rmse_away_goals"),
        F.sqrt(F.avg("sq_total")).alias("rmse_total_goals"),
        F.avg("loglik").alias("poisson_loglik"),
    )


def _per_bin(rows: DataFrame, by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    s = scored(validated(rows)).withColumn("bin_id", bucket(F.col("confidence"), edges))
    cells = [
        F.count_if((F.col("label") == i) & (F.col("predicted") == j)).alias(f"cm_{i}{j}")
        for i in range(3)
        for j in range(3)
    ]
    return s.groupBy(*by, "bin_id").agg(
        F.count("*").alias("n"),
        F.sum("hit").alias("hits"),
        F.sum("confidence").alias("conf"),
        F.sum("row_log_loss").alias("loss"),
        *[F.sum(f"sq_{i}").alias(f"sq_{i}") for i in range(3)],
        *cells,
    )


def summary(rows: DataFrame, by: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Accuracy, log loss, Brier scores, ECE, MCE and the confusion matrix per group."""
    per_bin = _per_bin(rows, by, uniform_edges(n_bins))
    n = F.sum("n")
    gap = F.abs(F.col("hits") / F.col("n") - F.col("conf") / F.col("n"))
    out = per_bin.groupBy(*by).agg(
        n.alias("n_predictions"),
        (F.sum("hits") / n).alias("accuracy"),
        (F.sum("loss") / n).alias("log_loss"),
        (F.sum("sq_0") / n).alias("brier_home"),
        (F.sum("sq_1") / n).alias("brier_draw"),
        (F.sum("sq_2") / n).alias("brier_away"),
        (F.sum(F.col("n") * gap) / n).alias("ece"),
        F.max(gap).alias("mce"),
        *[F.sum(f"cm_{i}{j}").alias(f"cm_{i}{j}") for i in range(3) for j in range(3)],
    )
    return out.withColumn("brier_multiclass", F.col("brier_home") + F.col("brier_draw") + F.col("brier_away"))


def _filled(per_bin: DataFrame, by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Every bucket of every group, with zeros where no row fell."""
    spark = per_bin.sparkSession
    frame = spark.createDataFrame(
        [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))],
        "bin_id int, lower double, upper double",
    )
    ids = F.array(*[F.lit(i) for i in range(len(edges) - 1)])
    groups = per_bin.groupBy(*by).agg(F.sum("n").alias("total")).withColumn("bin_id", F.explode(ids))
    joined = groups.join(F.broadcast(frame), "bin_id").join(
        per_bin.where(F.col("bin_id").isNotNull()).select(*by, "bin_id", "n", "hits", "conf", "loss"),
        [*by, "bin_id"],
        "left",
    )
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n", "hits", "conf", "loss")})


def _mean(total: str) -> Column:
    return F.coalesce(F.try_divide(F.col(total), F.col("n")), F.lit(0.0))


def reliability(rows: DataFrame, by: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Reliability table: always ``n_bins`` rows per group."""
    edges = uniform_edges(n_bins)
    t = _filled(_per_bin(rows, by, edges), by, edges)
    return t.select(
        *by,
        "bin_id",
        "lower",
        "upper",
        "n",
        _mean("hits").alias("accuracy"),
        _mean("conf").alias("mean_confidence"),
        F.abs(_mean("hits") - _mean("conf")).alias("abs_gap"),
        (F.col("n") / F.col("total")).alias("weight"),
    )


def confidence_buckets(rows: DataFrame, by: Sequence[str], edges: Sequence[float] = CONFIDENCE_EDGES) -> DataFrame:
    """Accuracy, confidence and log loss per bucket; rows below the first edge belong to none."""
    edges = check_edges(edges)
    t = _filled(_per_bin(rows, by, edges), by, edges)
    return t.select(
        *by,
        "bin_id",
        "lower",
        "upper",
        "n",
        _mean("hits").alias("accuracy"),
        _mean("conf").alias("mean_confidence"),
        _mean("loss").alias("log_loss"),
    )


def performance(evaluated: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Overall, per confidence bucket, per competition and per season in one grouping-sets pass.

    The rows are first summed per (bucket, competition, season), so the four groupings expand that
    small table and not the predictions.
    """
    edges = check_edges(edges)
    s = evaluated.withColumn("bucket", bucket(F.col("confidence"), edges))
    cells = s.groupBy("bucket", "competition_id", "season_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("correct").cast("double")).alias("hits"),
        F.sum("brier_score").alias("brier"),
        F.sum("log_loss").alias("loss"),
        F.sum("confidence").alias("conf"),
    )
    b, c, y = F.col("bucket"), F.col("competition_id"), F.col("season_id")
    grouped = cells.groupingSets([[], [b], [c], [y]], b, c, y).agg(
        F.grouping("bucket").alias("gb"),
        F.grouping("competition_id").alias("gc"),
        F.grouping("season_id").alias("gs"),
        *[F.sum(x).alias(x) for x in ("n", "hits", "brier", "loss", "conf")],
    )
    n = F.col("n")
    scope = (
        F.when(F.col("gb") == 0, "bucket").when(F.col("gc") == 0, "competition").when(F.col("gs") == 0, "season")
    ).otherwise("overall")
    return grouped.select(
        scope.alias("scope"),
        F.coalesce(
            F.when(F.col("gb") == 0, b.cast("long")), F.when(F.col("gc") == 0, c), F.when(F.col("gs") == 0, y)
        ).alias("scope_id"),
        n.alias("prediction_count"),
        (F.col("hits") / n).alias("accuracy"),
        (F.col("brier") / n).alias("brier_score"),
        (F.col("loss") / n).alias("log_loss"),
        (F.col("conf") / n).alias("avg_confidence"),
    )


def compare_runs(folds: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run from its fold metrics.

    NaN metrics leave the numerators only; their rows still count in the weights. A run without
    folds keeps a row of NaN. All runs must share dataset version and fold parameters.
    """
    kinds = runs.agg(
        F.count_distinct("dataset_version").alias("d"), F.count_distinct("iterator_params").alias("p")
    ).first()
    if kinds["d"] > 1 or kinds["p"] > 1:
        raise ValueError("runs differ in dataset version or fold parameters and cannot be compared")
    nan = F.lit(float("nan"))

    def clean(c: str) -> Column:
        return F.nullif(F.col(c), nan)

    n = F.col("n_predictions")
    per_run = folds.groupBy("run_id").agg(
        F.count("*").alias("n_folds"),
        F.avg(clean("accuracy")).alias("mean_accuracy"),
        F.stddev_pop(clean("accuracy")).alias("std_accuracy"),
        F.avg(clean("log_loss")).alias("mean_log_loss"),
        F.stddev_pop(clean("log_loss")).alias("std_log_loss"),
        F.avg(clean("ece")).alias("mean_ece"),
        F.avg(clean("mce")).alias("mean_mce"),
        F.sum(n).alias("total_n_predictions"),
        F.try_divide(F.coalesce(F.sum(n * clean("log_loss")), F.lit(0.0)), F.sum(n)).alias("weighted_log_loss"),
        F.try_divide(F.coalesce(F.sum(n * clean("ece")), F.lit(0.0)), F.sum(n)).alias("weighted_ece"),
    )
    ident = ["model_name", "model_version", "dataset_version", "iterator_params"]
    joined = runs.select("run_id", *ident).join(per_run, "run_id", "left")
    counts = {"n_folds", "total_n_predictions"}
    stds = {"std_accuracy", "std_log_loss"}
    cols = []
    for c in per_run.columns[1:]:
        if c in counts:
            cols.append(F.coalesce(F.col(c), F.lit(0)).alias(c))
        elif c in stds:
            cols.append(F.when(F.col("n_folds") == 1, F.lit(0.0)).otherwise(F.coalesce(F.col(c), nan)).alias(c))
        else:
            cols.append(F.coalesce(F.col(c), nan).alias(c))
    return joined.select(*ident, *cols).orderBy("model_name", "model_version")


def fold_metric(folds: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Score of a search trial over its folds: ``weighted_<m>`` by rows, ``mean_<m>`` plain."""
    kind, _, name = metric.partition("_")
    if kind == "weighted":
        value = F.sum(F.col("n_predictions") * F.col(name)) / F.sum("n_predictions")
    elif kind == "mean":
        value = F.avg(F.nullif(F.col(name), F.lit(float("nan"))))
    else:
        raise ValueError(f"unknown fold metric {metric!r}")
    return folds.groupBy(*by).agg(value.alias(metric))
