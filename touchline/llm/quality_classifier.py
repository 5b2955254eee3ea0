"""Quality classifier by co-training of two views.

One view sees the text (``CONTENT`` measures of the whole text), the other only metadata (language, source and
stated length). Both are logistic models, fitted on the driver to bounded samples chosen by hash: at most about
``LABELLED`` labelled and ``POOL`` unlabelled rows of measures. For ``ROUNDS`` rounds each view labels the
pool rows that it is surest of, and the other view learns from them. Each view is calibrated on labelled rows
that neither has learned from; the calibrated log-odds add up, less the prior that both contain. Every document
is then scored with built-in expressions.

Several labels of one id count by their mean; labels that are null are no labels. Without labels of both
classes every document gets the share of good labels, or 1, and is kept. Null and empty texts have measures of
zero; null metadata is a value of its own; repeated rows are scored one by one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise

from .columns import SPACED, let, text_rows

LABELLED, POOL = 8_000, 8_000
ROUNDS, SURE, GROW = 4, 0.97, 400
LANGS, SOURCES = 8, 16
CONTENT = 10
SALT = 4


def content_measures(text: Column) -> Column:
    """Array of ``CONTENT`` numbers."""
    chars = F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    per = lambda pattern, whole: F.sqrt(F.regexp_count(text, F.lit(pattern)) / whole)

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        again = F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False))))
        return F.array(F.log1p(F.size(w).cast("double")), F.length(F.array_join(w, "")) / n, F.size(F.array_distinct(w)) / n, F.sqrt(again / n), per("[|<>]", n), per("!", n))

    of_lines = let(lines, lambda x: 1 - F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)))
    return F.concat(
        let(F.regexp_extract_all(text, F.lit(SPACED), 0), of_words),
        F.array(per("[A-Z\\u00C0-\\u00DE]", chars), per("[#*$%&]", chars), per("[0-9]", chars), of_lines.cast("double")),
    )


def metadata_measures(lang: str, source: str, length: str) -> Column:
    """Array of the stated length and of hashed languages and sources."""
    hashed = lambda c, n: [(F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)) == i).cast("double") for i in range(n)]
    return F.array(F.log1p(F.coalesce(F.col(length).cast("double"), F.lit(0.0))), *hashed(lang, LANGS), *hashed(source, SOURCES))


class Logistic:
    """Ridge-penalised logistic fit by Newton steps on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-9] = 1.0
        z = self._columns(x)
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        ridge[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._columns(x) @ self.w

    def column(self, measures: str) -> Column:
        """The log-odds as an expression over an array column."""
        slope = self.w[1:] / self.scale
        shift = float(self.w[0] - (slope * self.mean).sum())
        return sum((F.get(F.col(measures), F.lit(i)) * float(s) for i, s in enumerate(slope)), F.lit(shift))


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> list[tuple[Logistic, Logistic]]:
    """Model and calibration of each of two views; every fourth labelled row is kept for calibration."""
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    learn = ~held
    extra_x = [np.zeros((0, v.shape[1])) for v in labelled]
    extra_y = [np.zeros(0), np.zeros(0)]
    free = np.ones(len(pool[0]), bool)
    fit = lambda v: Logistic(np.vstack([labelled[v][learn], extra_x[v]]), np.concatenate([y[learn], extra_y[v]]))
    models = [fit(0), fit(1)]
    for _ in range(rounds):
        for v in (0, 1):
            p = 1 / (1 + np.exp(-models[v].logit(pool[v])))
            for label, sureness in ((1.0, p), (0.0, 1 - p)):
                at = np.flatnonzero(free & (sureness >= SURE))
                at = at[np.argsort(-sureness[at], kind="stable")][:GROW]
                free[at] = False
                extra_x[1 - v] = np.vstack([extra_x[1 - v], pool[1 - v][at]])
                extra_y[1 - v] = np.concatenate([extra_y[1 - v], np.full(len(at), label)])
        models = [fit(0), fit(1)]
    check = held if held.any() else learn
    return [(m, Logistic(m.logit(labelled[v][check])[:, None], y[check])) for v, m in enumerate(models)]


def quality_classifier(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars", label_col: str = "quality", least: float = 0.5
) -> DataFrame:
    """One row per document: content_score, metadata_score, score (0 to 1), kept (score of at least ``least``)."""
    rows = text_rows(docs, id_col, text_col, lang=lang_col, source=source_col, length=length_col)
    measured = rows.select("id", content_measures(F.col("text")).alias("content"), metadata_measures("lang", "source", "length").alias("metadata"))
    measured = materialise(measured, "quality-views")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    joined = measured.join(known, "id", "left")
    counts = joined.agg(F.count("y").alias("labelled"), F.count("*").alias("n"), F.avg("y").alias("share")).first()
    key = F.xxhash64("id", "content", F.lit(SALT))
    some = lambda rows, n, most: rows.where(F.pmod(key, F.lit(max(1, -(-n // most)))) == 0).orderBy(key).limit(2 * most).collect()
    picked = some(joined.where("y is not null"), counts["labelled"], LABELLED)
    y = np.array([r["y"] for r in picked])
    if len(set(y.tolist())) < 2:
        score = F.lit(float(counts["share"] if counts["share"] is not None else 1.0))
        return measured.select(F.col("id").alias(id_col), score.alias("content_score"), score.alias("metadata_score"), score.alias("score"), F.lit(True).alias("kept"))
    pool = some(joined.where("y is null"), counts["n"] - counts["labelled"], POOL)
    views = lambda found: [np.array([r[v] for r in found], float).reshape(len(found), -1) for v in ("content", "metadata")]
    blank = [np.zeros((0, CONTENT)), np.zeros((0, 1 + LANGS + SOURCES))]
    (content, c_cal), (metadata, m_cal) = co_train(views(picked), y, views(pool) if pool else blank)
    odds = [model.column(view) * float(cal.w[1] / cal.scale[0]) + float(cal.w[0] - cal.w[1] * cal.mean[0] / cal.scale[0]) for model, cal, view in ((content, c_cal, "content"), (metadata, m_cal, "metadata"))]
    prior = float(np.log(y.mean() / (1 - y.mean())))
    sigmoid = lambda x: F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x)))), 6)
    scored = measured.select("id", odds[0].alias("c"), odds[1].alias("m")).select(F.col("id").alias(id_col), sigmoid(F.col("c")).alias("content_score"), sigmoid(F.col("m")).alias("metadata_score"), sigmoid(F.col("c") + F.col("m") - prior).alias("score"))
    return scored.withColumn("kept", F.col("score") >= least)
