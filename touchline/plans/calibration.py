"""Calibrators fitted per group on validation rows, all groups together.

The state of every group's fit is a row of a table. Each Newton step is one grouped aggregation of the rows joined to
that table, and an update of its rows; the table is written after each step, and only whether any group is still open
reaches the driver. So the number of groups is free. Every calibrator ends as one affine map of log-probabilities
followed by a softmax, so applying them is one column expression over the parameter table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from touchline.functions import scalars as X
from touchline.operators import metrics as Mx
from touchline.session import materialise

T_MIN, T_MAX = 0.1, 10.0
L2 = 0.1
ECE_LOW, ECE_HIGH, DIRICHLET_MIN_ROWS = 0.02, 0.05, 5000
CLIP = 1e-12
TOLERANCE = 1e-9

_W = [f"w{j}{k}" for j in range(3) for k in range(3)]
_B = [f"b{j}" for j in range(3)]
PARAMS = [*_W, *_B]


def _logs(df: DataFrame) -> DataFrame:
    return df.withColumns({f"lp{i}": X.clipped_log(F.col(c), CLIP) for i, c in enumerate(Mx.P)})


def choose(val: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calibrator kind per group from validation rows only."""
    s = Mx.summary(val, by).select(*by, F.col("ece").alias("val_ece"), F.col("n_predictions").alias("val_n"))
    kind = (
        F.when(F.col("val_ece") < ECE_LOW, "identity")
        .when((F.col("val_ece") >= ECE_HIGH) & (F.col("val_n") >= DIRICHLET_MIN_ROWS), "dirichlet")
        .otherwise("temperature")
    )
    return s.withColumn("kind", kind)


def _fit_rows(val: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group, label and log-probabilities, written once: every step reads these and not what made them."""
    return materialise(_logs(val).select(*by, "label", "lp0", "lp1", "lp2"), "calibration-rows")


def _groups(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.select(*by).distinct()


def fit_temperature(val: DataFrame, by: Sequence[str], steps: int = 60) -> DataFrame:
    """Temperature per group: Newton on the inverse temperature u, in which the loss is convex, inside a shrinking bracket.

    Returns the group with ``temperature``, ``converged`` and ``gradient`` (size of the slope at the last point).
    """
    rows = _fit_rows(val, by)
    low, high = 1.0 / T_MAX, 1.0 / T_MIN
    start = {"_u": 1.0, "_low": low, "_high": high, "_size": float("inf")}
    state = _groups(rows, by).withColumns({c: F.lit(v) for c, v in start.items()} | {"_open": F.lit(True)})
    state = materialise(state, "temperature")
    lp = [F.col(f"lp{i}") for i in range(3)]
    u, g, below, above, ahead = (F.col(c) for c in ("_u", "_slope", "_low", "_high", "_next"))
    for _ in range(steps):
        if state.where("_open").isEmpty():
            break
        s = X.softmax3(*[u * x for x in lp])
        mean = s[0] * lp[0] + s[1] * lp[1] + s[2] * lp[2]
        square = s[0] * lp[0] * lp[0] + s[1] * lp[1] * lp[1] + s[2] * lp[2] * lp[2]
        sums = rows.join(state.where("_open").select(*by, "_u"), list(by)).groupBy(*by)
        sums = sums.agg(F.avg(mean - X.pick3(F.col("label"), *lp)).alias("_slope"), F.avg(square - mean * mean).alias("_curve"))
        moved = state.join(sums, list(by), "left")
        moved = moved.withColumns({"_low": F.when(g <= 0, u).otherwise(below), "_high": F.when(g > 0, u).otherwise(above)})
        newton = F.when(F.col("_curve") > 1e-14, u - g / F.col("_curve")).when(g > 0, below).otherwise(above)
        moved = moved.withColumn("_next", F.when(newton.between(below, above), newton).otherwise((below + above) / 2))
        ends = (F.abs(ahead - u) < TOLERANCE) | (above - below < TOLERANCE)
        # the search closes in on a bound without reaching it
        near = [F.when(ends & (F.abs(ahead - edge) < 10 * TOLERANCE), F.lit(edge)) for edge in (low, high)]
        moved = moved.select(
            *by,
            F.when(g.isNull(), u).otherwise(F.coalesce(*near, ahead)).alias("_u"),
            "_low",
            "_high",
            F.coalesce(F.abs(g), F.col("_size")).alias("_size"),
            (F.col("_open") & g.isNotNull() & ~ends).alias("_open"),
        )
        state = materialise(moved, "temperature")
    bounded = F.least(F.greatest(1.0 / u, F.lit(T_MIN)), F.lit(T_MAX))
    return state.select(*by, bounded.alias("temperature"), (~F.col("_open")).alias("converged"), F.col("_size").alias("gradient"))


_FIT = "_x array<double>, _try array<double>, _step array<double>, _loss double, _damp double, _gradient double, _open boolean"


def fit_dirichlet(val: DataFrame, by: Sequence[str], l2: float = L2, steps: int = 40) -> DataFrame:
    """Twelve parameters per group (3x3 map and 3 offsets) by damped Newton steps.

    Adding a constant to all offsets changes nothing, so the step uses a pseudo-inverse. Returns the group with ``x`` (the
    parameters in the order of ``PARAMS``), ``converged`` and ``gradient``.
    """
    rows = _fit_rows(val, by)
    begin = F.array(*[F.lit(float(v)) for v in np.concatenate([np.eye(3).ravel(), np.zeros(3)])])
    none = F.array(*[F.lit(0.0)] * 12)
    first = {"_x": begin, "_try": begin, "_step": none, "_loss": F.lit(float("inf")), "_damp": F.lit(1.0), "_gradient": F.lit(float("inf")), "_open": F.lit(True)}
    state = materialise(_groups(rows, by).withColumns(first), "dirichlet")
    keys = ", ".join(f"{b} {val.schema[b].dataType.simpleString()}" for b in by)
    z = [F.col("lp0"), F.col("lp1"), F.col("lp2"), F.lit(1.0)]
    pairs = [(j, m, k, n) for j in range(3) for m in range(j, 3) for k in range(4) for n in range(k, 4)]

    def update(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append({c: r[c] for c in [*by, "_x", "_try", "_step", "_loss", "_damp", "_gradient", "_open"]} | (_newton_step(r, pairs, l2) if r["_open"] and r["_mean_loss"] is not None else {}))
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = to_arrow_schema(state.schema)
    for _ in range(steps):
        if state.where("_open").isEmpty():
            break
        params = state.where("_open").select(*by, *[F.col("_try")[i].alias(p) for i, p in enumerate(PARAMS)])
        s = calibrated_columns()
        tried = rows.join(params, list(by)).withColumns({f"s{j}": s[j] for j in range(3)})
        y = [(F.col("label") == j).cast("double") for j in range(3)]
        grads = [F.avg((F.col(f"s{j}") - y[j]) * z[k]) for j in range(3) for k in range(4)]
        curve = {(j, m): F.col(f"s{j}") * ((1.0 if j == m else 0.0) - F.col(f"s{m}")) for j in range(3) for m in range(j, 3)}
        curves = [F.avg(curve[j, m] * z[k] * z[n]) for j, m, k, n in pairs]
        loss = F.avg(-F.log(F.greatest(X.pick3(F.col("label"), *[F.col(f"s{j}") for j in range(3)]), F.lit(X.EPS))))
        named = [c.alias(f"_a{i}") for i, c in enumerate([*grads, *curves])]
        sums = tried.groupBy(*by).agg(loss.alias("_mean_loss"), *named)
        sums = sums.select(*by, "_mean_loss", F.array(*[f"_a{i}" for i in range(12)]).alias("_g"), F.array(*[f"_a{12 + i}" for i in range(len(pairs))]).alias("_h"))
        state = materialise(state.join(sums, list(by), "left").mapInArrow(update, f"{keys}, {_FIT}"), "dirichlet")
    return state.select(*by, F.col("_x").alias("x"), (~F.col("_open")).alias("converged"), F.col("_gradient").alias("gradient"))


def _position(j: int, k: int) -> int:
    return j * 3 + k if k < 3 else 9 + j


def _newton_step(r: dict, pairs: list[tuple[int, int, int, int]], l2: float) -> dict:
    """Accept or shorten the tried point of one group, then set the next one."""
    x = np.array(r["_try"])
    penalty = x[:9] - np.eye(3).ravel()
    loss = r["_mean_loss"] + l2 * float(penalty @ penalty)
    if loss > r["_loss"] + 1e-12 and r["_damp"] > 1e-4:
        damp = r["_damp"] / 2
        return {"_damp": damp, "_try": (np.array(r["_x"]) - damp * np.array(r["_step"])).tolist()}
    improved = r["_loss"] - loss
    grad, hess = np.zeros(12), np.zeros((12, 12))
    for j in range(3):
        for k in range(4):
            grad[_position(j, k)] = r["_g"][4 * j + k]
    for (j, m, k, n), v in zip(pairs, r["_h"], strict=True):
        for a, b in ((_position(j, k), _position(m, n)), (_position(j, n), _position(m, k))):
            hess[a, b] = hess[b, a] = v
    grad[:9] += 2 * l2 * penalty
    hess[:9, :9] += 2 * l2 * np.eye(9)
    step = np.linalg.pinv(hess, rcond=1e-12) @ grad
    size = float(np.abs(grad).max())
    ends = size < 1e-8 or 0 <= improved < 1e-13
    return {"_x": x.tolist(), "_loss": loss, "_damp": 1.0, "_gradient": size, "_step": step.tolist(), "_try": (x - step).tolist(), "_open": not ends}


def calibrated_columns() -> list[Column]:
    """softmax(W log p + b) from the columns lp*, w** and b*."""
    logits = []
    for j in range(3):
        acc = F.col(f"b{j}")
        for k in range(3):
            acc = acc + F.col(f"w{j}{k}") * F.col(f"lp{k}")
        logits.append(acc)
    return X.softmax3(*logits)


def fit(val: DataFrame, by: Sequence[str]) -> DataFrame:
    """Choose and fit one calibrator per group; returns the parameter table.

    ``converged`` and ``gradient`` (largest component at the last accepted point) tell how each fit ended.
    """
    by = list(by)
    chosen = materialise(choose(val, by), "calibrators")
    identity = np.concatenate([np.eye(3).ravel(), np.zeros(3)])
    fitted = []
    for kind in ("identity", "temperature", "dirichlet"):
        mine = chosen.where(F.col("kind") == kind)
        if mine.isEmpty():
            continue
        one, ends = F.lit(1.0).alias("temperature"), ["converged", "gradient"]
        plain = F.array(*[F.lit(float(v)) for v in identity])
        rows = val.join(mine.select(*by), by, "left_semi")
        if kind == "identity":
            fitted.append(mine.select(*by, "kind", "val_ece", "val_n", one, plain.alias("x"), F.lit(True).alias("converged"), F.lit(0.0).alias("gradient")))
        elif kind == "temperature":
            scaled = F.array(*[F.lit(float(v)) / F.col("temperature") for v in identity[:9]], *[F.lit(0.0)] * 3)
            fitted.append(mine.join(fit_temperature(rows, by), by).select(*by, "kind", "val_ece", "val_n", "temperature", scaled.alias("x"), *ends))
        else:
            fitted.append(mine.join(fit_dirichlet(rows, by), by).select(*by, "kind", "val_ece", "val_n", one, "x", *ends))
    if not fitted:
        fitted.append(chosen.select(*by, "kind", "val_ece", "val_n", F.lit(1.0).alias("temperature"), F.array(*[F.lit(0.0)] * 12).alias("x"), F.lit(True).alias("converged"), F.lit(0.0).alias("gradient")))
    params = reduce(DataFrame.unionByName, fitted)
    flat = params.select(*by, "kind", "val_ece", F.col("val_n").cast("long").alias("val_n"), "temperature", *[F.col("x")[i].alias(p) for i, p in enumerate(PARAMS)], "converged", "gradient")
    return materialise(flat, "calibrators")


def apply(rows: DataFrame, params: DataFrame, by: Sequence[str]) -> DataFrame:
    """Replace the three probabilities by calibrated ones; identity leaves them as they are."""
    joined = _logs(rows.join(params.select(*by, "kind", *PARAMS), list(by)))
    s = calibrated_columns()
    new = {c: F.when(F.col("kind") == "identity", F.col(c)).otherwise(s[i]) for i, c in enumerate(Mx.P)}
    return joined.withColumns(new).drop("lp0", "lp1", "lp2", *PARAMS)
