"""The three model families: rating baseline, two-head Poisson regression and boosted trees.

A trainer has ``fit(train, val, seed)`` and returns a model with ``transform(df)``, which adds the three
outcome probabilities and, where the model yields them, the expected goals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import scalars as X
from touchline.plans.boosting import Group, Growth, Trees, growth_of
from touchline.plans.boosting import fit as fit_trees
from touchline.plans.poisson import Head, fit_heads

MAX_LOG_RATE = 30.0
P = ["p_home_win", "p_draw", "p_away_win"]


# --- rating baseline ------------------------------------------------------------------------

GRID_K, GRID_HFA, GRID_BETA = (15, 20, 25, 30), (50, 65, 80), (0.0015, 0.0020, 0.0025)


def elo_rates(beta_home: Column, beta_away: Column, hfa: Column, beta: Column) -> tuple[Column, Column]:
    """Expected goals from the rating difference, capped in log space."""
    edge = F.col("home_elo_pre_match").cast("float").cast("double") + hfa
    edge = edge - F.col("away_elo_pre_match").cast("float").cast("double")
    cap = F.lit(MAX_LOG_RATE)
    return F.exp(F.least(beta_home + beta * edge, cap)), F.exp(F.least(beta_away - beta * edge, cap))


def with_rates(df: DataFrame, home: Column, away: Column, max_goals: int) -> DataFrame:
    """Add expected goals and the outcome probabilities; the goal fold runs once per row."""
    names = [f"expected_{s}_goals" for s in N.SIDES]
    rated = df.withColumns(dict(zip(names, (home, away))))
    o = F.col("_o")
    return (
        rated.withColumn("_o", X.outcome_from_rates(*[F.col(n) for n in names], max_goals))
        .withColumns({"p_home_win": o["home"], "p_draw": o["draw"], "p_away_win": o["away"]})
        .drop("_o")
    )


def with_valid_elo(df: DataFrame) -> DataFrame:
    return df.dropna(subset=N.ELO)


def intercepts() -> list[Column]:
    """Log of mean goals per side, floored at 0.1 goals."""
    return [
        F.log(F.greatest(F.avg(f"{s}_goals"), F.lit(0.1))).alias(f"beta_0_{s}") for s in N.SIDES
    ]


def fold_intercepts(sums: DataFrame) -> DataFrame:
    """The same per fold, from the sums of train goals."""
    return sums.where("n > 0").select("fold_id", *[F.log(F.greatest(F.col(f"{s}_goals") / F.col("n"), F.lit(0.1))).alias(f"beta_0_{s}") for s in N.SIDES])


def elo_grid_losses(rows: DataFrame, by: list[str], max_goals: int = 10) -> DataFrame:
    """Validation log loss of every grid point per group, all points in one pass over the rows.

    ``rows`` carries the group's intercepts. The update factor K does not enter the forecast, so nine
    points cover the grid and the first K wins every tie.
    """
    label = X.outcome_class(F.col("home_goals"), F.col("away_goals"))
    aggs = []
    for i, hfa in enumerate(GRID_HFA):
        for j, beta in enumerate(GRID_BETA):
            home, away = elo_rates(F.col("beta_0_home"), F.col("beta_0_away"), F.lit(float(hfa)), F.lit(beta))
            truth = X.outcome_from_rates(home, away, max_goals, label)
            aggs.append(F.avg(-X.clipped_log(truth)).alias(f"l{i}{j}"))
    return rows.groupBy(*by, "beta_0_home", "beta_0_away").agg(F.count("*").alias("val_n"), *aggs)


@dataclass
class EloModel:
    hyper: dict
    name: str = "elo_baseline"

    def transform(self, df: DataFrame) -> DataFrame:
        h = self.hyper
        home, away = elo_rates(*[F.lit(float(h[k])) for k in ("beta_0_home", "beta_0_away", "HFA", "beta_1")])
        return with_rates(df, home, away, h["max_goals"])

    def state(self) -> dict:
        return {}

    def save(self, path: str) -> None:
        """The whole model is its hyperparameters, which the registry row stores."""


@dataclass
class EloTrainer:
    """Means from the training rows; advantage and slope as given, else from the grid on validation rows."""

    max_goals: int = 10
    K: float | None = None
    HFA: float | None = None
    beta_1: float | None = None
    name: str = "elo_baseline"

    def fit(self, train: DataFrame, val: DataFrame | None = None, seed: int | None = None) -> EloModel:
        b = with_valid_elo(train).agg(*intercepts(), F.count("*").alias("n")).first()
        if not b["n"]:
            raise ValueError("no training rows with ratings")
        best = (GRID_HFA[0], GRID_BETA[1])
        loss = None
        if val is not None and (self.HFA is None or self.beta_1 is None):
            rows = with_valid_elo(val).withColumns({k: F.lit(b[k]) for k in ("beta_0_home", "beta_0_away")})
            r = elo_grid_losses(rows, [], self.max_goals).first()
            if r is None:
                raise ValueError("no validation rows with ratings")
            best, loss = pick_grid_point(r)
        return EloModel(
            {
                "K": GRID_K[0] if self.K is None else self.K,
                "HFA": float(best[0] if self.HFA is None else self.HFA),
                "beta_0_home": b["beta_0_home"],
                "beta_0_away": b["beta_0_away"],
                "beta_1": best[1] if self.beta_1 is None else self.beta_1,
                "max_goals": self.max_goals,
                "val_log_loss": loss,
            }
        )


def pick_grid_point(row) -> tuple[tuple[float, float], float]:
    """First grid point in (HFA, beta) order that no later one beats by more than 1e-12."""
    best, loss = None, math.inf
    for i, hfa in enumerate(GRID_HFA):
        for j, beta in enumerate(GRID_BETA):
            if row[f"l{i}{j}"] < loss - 1e-12:
                best, loss = (hfa, beta), row[f"l{i}{j}"]
    return best, loss


# --- Poisson regression ---------------------------------------------------------------------


def _single(name: str) -> Column:
    return F.col(name).cast("float").cast("double")


def head_means(train: DataFrame, side: str) -> dict[str, float]:
    """Mean of each head column over its present values; 0 where the block has none."""
    r = train.agg(*[F.avg(_single(c)).alias(c) for c in N.HEAD[side]]).first()
    return {c: float(r[c]) if r[c] is not None else 0.0 for c in N.HEAD[side]}


@dataclass
class PoissonModel:
    heads: dict[str, Head]
    max_goals: int = 10
    hyper: dict = field(default_factory=dict)
    name: str = "poisson"

    @property
    def means(self) -> dict[str, dict[str, float]]:
        return {s: h.means for s, h in self.heads.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        rates = []
        for s in N.SIDES:
            h = self.heads[s]
            eta = F.lit(h.intercept)
            for c, w in zip(N.HEAD[s], h.coefficients.tolist(), strict=True):
                eta = eta + F.lit(w) * F.coalesce(_single(c), F.lit(h.means[c]))
            rates.append(usable_rate(F.exp(eta)))
        return with_rates(df, *rates, self.max_goals)

    def state(self) -> dict:
        heads = {s: {"intercept": h.intercept, "coefficients": h.coefficients.tolist(), "means": h.means} for s, h in self.heads.items()}
        return {"heads": heads, "max_goals": self.max_goals}

    def save(self, path: str) -> None:
        """The registry row holds the whole model."""


def usable_rate(r: Column) -> Column:
    return F.when(X.finite(r) & (r > 0), F.least(r, F.lit(1e6))).otherwise(F.lit(0.1))


@dataclass
class PoissonTrainer:
    """Ridge Poisson regression per side."""

    l2: float = 0.01
    max_goals: int = 10
    name: str = "poisson"

    def fit_folds(self, rows: DataFrame, folds: dict[int, tuple[int | None, int | None]]) -> dict[int, PoissonModel]:
        """A model per fold, all in the same passes; a fold is the kickoff bounds of its train block."""
        hyper = {"regularization_l2": self.l2, "max_goals": self.max_goals}
        return {f: PoissonModel(heads, self.max_goals, hyper) for f, heads in fit_heads(rows, folds, self.l2).items()}

    def fit(self, train: DataFrame, val: DataFrame | None = None, seed: int | None = None) -> PoissonModel:
        return self.fit_folds(train, {0: (None, None)})[0]


# --- boosted trees --------------------------------------------------------------------------

# The two boosters differ in step size and in the scale of the curvature, p (1 - p) times 1 or K / (K - 1).
BOOSTING = {
    "gradient_boosting": {"learning_rate": 0.1, "rounds": 100, "leaves": 31, "curvature": 1.0},
    "lightgbm": {"learning_rate": 0.05, "rounds": 100, "leaves": 31, "curvature": 1.5},
}


@dataclass
class BoostedModel:
    trees: Trees
    hyper: dict
    name: str = "gradient_boosting"

    def transform(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self.trees)
        columns = self.trees.columns

        @F.pandas_udf(", ".join(f"{c} double" for c in P))
        def probabilities(values: pd.DataFrame) -> pd.DataFrame:
            wide = values.to_numpy(dtype=np.float32, na_value=np.nan).astype(np.float64)
            return pd.DataFrame(model.value.probabilities(wide), columns=P)

        scored = df.withColumn("_p", probabilities(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))
        return scored.withColumns({c: F.col("_p")[c] for c in P}).drop("_p")

    def state(self) -> dict:
        return {"trees": self.trees.as_dict()}

    def save(self, path: str) -> None:
        """The registry row holds the whole model."""


@dataclass
class BoostedTrainer:
    """Softmax boosting over all columns; ``hyper`` overrides the family defaults."""

    name: str = "gradient_boosting"
    hyper: dict = field(default_factory=dict)

    def growth(self) -> Growth:
        return growth_of(BOOSTING[self.name], self.hyper)

    def fit(self, train: DataFrame, val: DataFrame | None = None, seed: int | None = None) -> BoostedModel:
        """Nothing is drawn at random, so ``seed`` has no effect."""
        return BoostedModel(fit_trees(train, [Group((0,), self.growth())])[(0,)], {**BOOSTING[self.name], **self.hyper}, self.name)


def load_model(name: str, hyper: dict, state: dict, path: str):
    """A model from what ``save`` and the registry row hold."""
    if name == "elo_baseline":
        return EloModel(hyper)
    if name == "poisson":
        heads = {s: Head(h["intercept"], np.array(h["coefficients"]), h["means"]) for s, h in state["heads"].items()}
        return PoissonModel(heads, state["max_goals"], hyper)
    if name not in BOOSTING:
        raise ValueError(f"unknown model {name!r}")
    return BoostedModel(Trees.from_dict(state["trees"]), hyper, name)


TRAINERS = {
    "elo_baseline": EloTrainer,
    "poisson": PoissonTrainer,
    "gradient_boosting": lambda **kw: BoostedTrainer("gradient_boosting", kw),
    "lightgbm": lambda **kw: BoostedTrainer("lightgbm", kw),
}


def trainer(name: str, **hyper):
    """Trainer by registry name."""
    if name not in TRAINERS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(TRAINERS)}")
    return TRAINERS[name](**hyper)
