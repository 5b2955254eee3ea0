"""Ridge Poisson regressions of both goal heads for all folds in the same Newton passes.

A pass is one aggregation over all rows: every task adds up, for each (fold, head), score vector, curvature matrix and
loss of its complete train rows, and the sums meet by (fold, head). The driver solves one small system per (fold, head).
Train rows are told by the kickoff bounds of the fold, so no row is copied.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import scalars as X
from touchline.session import materialise

MAX_LOG_RATE = 30.0
STEPS, TOLERANCE = 60, 1e-9


@dataclass
class Head:
    """Intercept and one weight per column of a side, with the column means that fill missing values."""

    intercept: float
    coefficients: np.ndarray
    means: dict[str, float] = field(default_factory=dict)
    gradient: float = 0.0


def prepared(rows: DataFrame) -> DataFrame:
    """Kickoff, goals and head columns as numbers, written once in a compact form."""
    columns = sorted({c for s in N.SIDES for c in N.HEAD[s]})
    at = X.instant("kickoff") if "kickoff" in rows.columns else F.lit(0).cast("long")
    single = [F.col(c).cast("float").cast("double").alias(c) for c in columns]
    return materialise(rows.select(at.alias("at"), *[F.col(f"{s}_goals").cast("double").alias(f"{s}_goals") for s in N.SIDES], *single), "heads")


def _sums(data: DataFrame, folds: dict, visit) -> dict:
    """Sums of the vectors that ``visit(x, y)`` returns for the (fold, side) matrices of complete rows, by one aggregation.

    ``visit`` is called with fold, side, values (rows, columns; NaN where missing) and goals of a batch.
    """

    def partial(batches):
        total = {}
        for b in batches:
            at = b.column("at").to_numpy()
            for side in N.SIDES:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in N.HEAD[side]], axis=1).astype(float)
                y = b.column(f"{side}_goals").to_numpy(zero_copy_only=False).astype(float)
                for fold, (low, high) in folds.items():
                    mine = np.ones(len(at), bool) if low is None else (at >= low) & (at <= high)
                    part = visit(fold, side, x[mine], y[mine])
                    if part is not None:
                        key = (fold, side)
                        total[key] = total[key] + part if key in total else part
        for (fold, side), v in total.items():
            yield pa.record_batch([pa.array([fold], pa.int64()), pa.array([side]), pa.array([v.tobytes()], pa.binary())], names=["fold", "side", "blob"])

    def merge(batches):
        total = {}
        for b in batches:
            for fold, side, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
                v = np.frombuffer(blob)
                total[fold, side] = total[fold, side] + v if (fold, side) in total else v
        for (fold, side), v in total.items():
            yield pa.record_batch([pa.array([fold], pa.int64()), pa.array([side]), pa.array([v.tobytes()], pa.binary())], names=["fold", "side", "blob"])

    schema = "fold long, side string, blob binary"
    rows = data.mapInArrow(partial, schema).repartition("fold", "side").mapInArrow(merge, schema).collect()  # one row per fold and side
    return {(r["fold"], r["side"]): np.frombuffer(r["blob"]) for r in rows}


def _newton(x, y, beta):
    """Loss, rows, score and curvature of one batch at ``beta``."""
    whole = ~(np.isnan(x).any(axis=1) | np.isnan(y))
    x, y = x[whole], y[whole]
    if not len(y):
        return None
    one = np.concatenate([np.ones((len(y), 1)), x], axis=1)
    eta = np.minimum(one @ beta, MAX_LOG_RATE)
    mu = np.exp(eta)
    return np.concatenate([[float((mu - y * eta).sum()), len(y)], one.T @ (mu - y), (one.T @ (one * mu[:, None])).ravel()])


def fit_heads(rows: DataFrame, folds: dict[int, tuple[int | None, int | None]], l2: float) -> dict[int, dict[str, Head]]:
    """Both heads of every fold; ``folds`` maps an id to the closed kickoff bounds (micros) of its train block."""
    data = prepared(rows)
    width = {s: len(N.HEAD[s]) for s in N.SIDES}

    def first(fold, side, x, y):
        known = ~np.isnan(x)
        whole = known.all(axis=1) & ~np.isnan(y)
        return np.concatenate([[whole.sum(), y[whole].sum()], known.sum(axis=0), np.where(known, x, 0.0).sum(axis=0)]).astype(float)

    opened = _sums(data, folds, first)
    heads, open_keys, state = {}, set(), {}
    for fold in folds:
        for side in N.SIDES:
            got = opened.get((fold, side), np.zeros(2 + 2 * width[side]))
            if not got[0] or got[1] <= 0:
                raise ValueError(f"no complete training rows with goals for the {side} head of fold {fold}")
            counts, totals = got[2 : 2 + width[side]], got[2 + width[side] :]
            means = {c: float(t / n) if n else 0.0 for c, t, n in zip(N.HEAD[side], totals, counts, strict=True)}
            beta = np.zeros(width[side] + 1)
            beta[0] = np.log(got[1] / got[0])
            heads[fold, side] = Head(0.0, np.zeros(0), means)
            state[fold, side] = {"beta": beta, "try": beta, "loss": np.inf, "step": None}
            open_keys.add((fold, side))
    for _ in range(STEPS):
        tries = {k: state[k]["try"] for k in open_keys}

        def visit(fold, side, x, y, tries=tries):
            return _newton(x, y, tries[fold, side]) if (fold, side) in tries else None

        for key, v in _sums(data, {f: folds[f] for f in {f for f, _ in open_keys}}, visit).items():
            s, p = state[key], width[key[1]] + 1
            n = v[1]
            weight = s["try"][1:]
            loss = v[0] / n + 0.5 * l2 * float(weight @ weight)
            if loss > s["loss"] + 1e-12 * abs(s["loss"]):
                s["step"] = s["step"] / 2  # too far: half the step from the last good place
                s["try"] = s["beta"] + s["step"]
                if np.abs(s["step"]).max() < 1e-14:
                    open_keys.discard(key)
                continue
            score = v[2 : 2 + p] / n
            score[1:] += l2 * weight
            curve = v[2 + p :].reshape(p, p) / n + np.diag([0.0] + [l2] * (p - 1))
            s["beta"], s["loss"] = s["try"], loss
            spread = np.sqrt(np.maximum(np.diag(curve), 1e-12))
            heads[key].gradient = float(np.abs(score / spread).max())
            scaled = curve / spread[:, None] / spread[None, :]
            s["step"] = -np.linalg.lstsq(scaled, score / spread, rcond=1e-14)[0] / spread
            s["try"] = s["beta"] + s["step"]
            if heads[key].gradient < TOLERANCE:
                open_keys.discard(key)
        if not open_keys:
            break
    out: dict[int, dict[str, Head]] = {}
    for (fold, side), h in heads.items():
        beta = state[fold, side]["beta"]
        h.intercept, h.coefficients = float(beta[0]), beta[1:]
        out.setdefault(fold, {})[side] = h
    return out
