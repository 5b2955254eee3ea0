"""Walk-forward folds as closed kickoff intervals.

Only the number of matches per distinct kickoff decides the bounds. Those counts are aggregated and
written in time order; the driver holds one total per calendar day, and the walk reads the kickoffs of
the few days in which a fold's blocks begin or end.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.session import materialise, require_utc

DAYS_HELD = 64


@dataclass(frozen=True)
class FoldParams:
    min_train_size: int = 200
    test_size: int = 50
    gap_days: int = 1
    mode: str = "expanding"
    val_ratio: float | None = 0.15
    val_size: int | None = None

    def check(self) -> FoldParams:
        if self.min_train_size < 1 or self.test_size < 1 or self.gap_days < 0:
            raise ValueError(f"fold sizes out of range: {self}")
        if (self.val_ratio is None) == (self.val_size is None):
            raise ValueError("give exactly one of val_ratio and val_size")
        if self.val_ratio is not None and not 0.0 < self.val_ratio < 1.0:
            raise ValueError(f"val_ratio must lie in (0, 1), got {self.val_ratio}")
        if self.val_size is not None and self.val_size < 1:
            raise ValueError(f"val_size must be positive, got {self.val_size}")
        if self.mode not in ("expanding", "sliding"):
            raise ValueError(f"mode must be expanding or sliding, got {self.mode!r}")
        return self

    def config(self) -> dict:
        return asdict(self)


def timeline(rows: DataFrame) -> DataFrame:
    """(at, first, last): row positions of each distinct kickoff in time order.

    Day totals are summed over the (calendar-sized) list of days, kickoffs inside their day; no
    window spans the rows themselves.
    """
    per = rows.groupBy(X.instant("kickoff").alias("at")).agg(F.count("*").alias("n"))
    per = per.withColumn("day", F.floor(F.col("at") / F.lit(X.DAY_MICROS)))
    before = Window.partitionBy(F.floor(F.col("day") / 366)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = per.groupBy("day").agg(F.sum("n").alias("n")).withColumn("span", F.floor(F.col("day") / 366))
    spans = days.groupBy("span").agg(F.sum("n").alias("n"))
    span_before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("n").over(span_before), F.lit(0)).alias("span_base"))
    days = days.select("day", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("day_base")).join(spans, "span")
    inside = Window.partitionBy("day").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("span_base") + F.col("day_base") + F.coalesce(F.col("in_day"), F.lit(0))
    return (
        per.withColumn("in_day", F.sum("n").over(inside))
        .join(days, "day")
        .select("at", first.alias("first"), (first + F.col("n") - 1).alias("last"))
    )


class _Line:
    """Positions of kickoffs: day totals on the driver (as many as the calendar has days), kickoffs per day on demand."""

    def __init__(self, rows: DataFrame):
        per = rows.groupBy(X.instant("kickoff").alias("at")).agg(F.count("*").alias("n"))
        per = per.withColumn("day", F.floor(F.col("at") / F.lit(X.DAY_MICROS)))
        self.per = materialise(per.repartitionByRange("at").sortWithinPartitions("at"), "timeline")
        days = self.per.groupBy("day").agg(F.sum("n").alias("n")).orderBy("day").collect()
        self.days = np.array([r["day"] for r in days], np.int64)
        self.base = np.concatenate([[0], np.cumsum([r["n"] for r in days])]).astype(np.int64)
        self.size = int(self.base[-1])
        self.held: dict[int, list[tuple[int, int, int]]] = {}

    def _day(self, i: int) -> list[tuple[int, int, int]]:
        """(at, first, last) of every kickoff of the i-th day; the scan skips files by their bounds."""
        if i not in self.held:
            if len(self.held) >= DAYS_HELD:
                self.held.pop(next(iter(self.held)))
            low = int(self.days[i]) * X.DAY_MICROS
            rows = self.per.where(F.col("at").between(low, low + X.DAY_MICROS - 1)).select("at", "n").orderBy("at").collect()
            last = self.base[i] - 1 + np.cumsum([r["n"] for r in rows])
            self.held[i] = [(r["at"], int(e) - r["n"] + 1, int(e)) for r, e in zip(rows, last, strict=True)]
        return self.held[i]

    def holding(self, position: int) -> tuple[int, int, int]:
        day = self._day(int(np.searchsorted(self.base, position, side="right")) - 1)
        return next(x for x in day if x[1] <= position <= x[2])

    def from_instant(self, at: int) -> tuple[int, int, int] | None:
        i = int(np.searchsorted(self.days, at // X.DAY_MICROS, side="left"))
        if i < len(self.days) and (found := next((x for x in self._day(i) if x[0] >= at), None)):
            return found
        later = int(np.searchsorted(self.days, at // X.DAY_MICROS, side="right"))
        return self._day(later)[0] if later < len(self.days) else None


def walk_forward(rows: DataFrame, params: FoldParams) -> list[dict]:
    """Fold bounds; a kickoff group is never split between blocks and partial blocks end the walk."""
    params.check()
    require_utc(rows.sparkSession)
    line = _Line(rows)
    gap = params.gap_days * X.DAY_MICROS
    folds: list[dict] = []
    if line.size < params.min_train_size:
        return folds
    start, end = 0, params.min_train_size - 1
    while True:
        at, first, last = line.holding(end)
        if last != end:
            # The group continues past the wanted tail: it belongs to the next block as a whole.
            end = first - 1
            at = line.holding(end)[0] if end >= 0 else None
        n_train = end - start + 1
        if n_train < params.min_train_size:
            return folds
        val = line.from_instant(max(at + gap, at + 1))
        if val is None:
            return folds
        wanted = params.val_size or max(1, round(n_train * params.val_ratio))
        if val[1] + wanted - 1 >= line.size:
            return folds
        val_end = line.holding(val[1] + wanted - 1)
        test = line.from_instant(max(val_end[0] + gap, val_end[0] + 1))
        if test is None or test[1] + params.test_size - 1 >= line.size:
            return folds
        test_end = line.holding(test[1] + params.test_size - 1)
        folds.append(
            {
                "fold_id": len(folds),
                "train_start": line.holding(start)[0],
                "train_end": at,
                "val_start": val[0],
                "val_end": val_end[0],
                "test_start": test[0],
                "test_end": test_end[0],
                "n_train": n_train,
                "n_val": val_end[2] - val[1] + 1,
                "n_test": test_end[2] - test[1] + 1,
            }
        )
        end = test_end[2]
        if end >= line.size - 1:
            return folds
        if params.mode == "sliding":
            start = line.holding(max(0, end - params.min_train_size + 1))[1]


_BOUNDS = (
    "fold_id long, train_start long, train_end long, val_start long, val_end long, test_start long, "
    "test_end long, n_train long, n_val long, n_test long"
)


def fold_table(spark, folds: list[dict]) -> DataFrame:
    """One row per fold: interval bounds, cutoffs and sizes."""
    df = spark.createDataFrame([tuple(f.values()) for f in folds], _BOUNDS)
    as_time = {c: F.timestamp_micros(c) for c in df.columns if c.endswith(("_start", "_end"))}
    return df.withColumns(as_time).withColumns(
        {
            "gap_end": F.col("val_start"),
            "training_cutoff": F.col("train_end"),
            "validation_cutoff": F.col("val_end"),
            "test_cutoff": F.col("test_end"),
        }
    )


def cells(bounds: DataFrame, blocks: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """The time line cut at every block's begin and end: (cell, lo, hi, block, first_fold, last_fold).

    Cells do not overlap. A cell that lies in the train block of many folds has one row with the range of these folds,
    not one per fold. The bounds are one row per fold and come from the driver's walk.
    """
    micros = [F.unix_micros(f"{b}_{e}").alias(f"{b}_{e}") for b in blocks for e in ("start", "end")]
    folds = sorted(bounds.select("fold_id", *micros).collect(), key=lambda r: r["fold_id"])
    cuts = sorted({r[f"{b}_start"] for r in folds for b in blocks} | {r[f"{b}_end"] + 1 for r in folds for b in blocks})
    out = []
    for cell, (lo, nxt) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for b in blocks:
            ids = [r["fold_id"] for r in folds if r[f"{b}_start"] <= lo and nxt - 1 <= r[f"{b}_end"]]
            while ids:
                last = next((x for x, y in zip(ids, ids[1:], strict=False) if y != x + 1), ids[-1])
                out.append((cell, lo, nxt - 1, b, ids[0], last))
                ids = [i for i in ids if i > last]
    return bounds.sparkSession.createDataFrame(out, "cell long, lo long, hi long, block string, first_fold long, last_fold long")


def with_cell(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows with the ``cell`` that holds their kickoff, by day and bounds; rows in no cell are left out.

    Cells are disjoint, so their days are as many as the calendar has, plus two per cell, whatever the number of folds.
    """
    one = cut.select("cell", "lo", "hi").distinct()
    first, last = (F.floor(F.col(c) / F.lit(X.DAY_MICROS)) for c in ("lo", "hi"))
    dated = one.withColumn("_day", F.explode(F.sequence(first, last)))
    at = X.instant("kickoff")
    placed = rows.withColumns({"_at": at, "_day": F.floor(at / F.lit(X.DAY_MICROS))}).join(dated, "_day")
    return placed.where(F.col("_at").between(F.col("lo"), F.col("hi"))).drop("_day", "_at", "lo", "hi")


def membership(rows: DataFrame, bounds: DataFrame, blocks: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Rows joined to every fold block that holds their kickoff.

    With "train" the result itself repeats a row for every fold that trains on it; ``train_sums`` and ``block_overlaps``
    work on cells and repeat nothing.
    """
    cut = cells(bounds, blocks)
    ranges = cut.select("cell", "block", "first_fold", "last_fold")
    placed = with_cell(rows, cut).join(ranges, "cell")
    return placed.withColumn("fold_id", F.explode(F.sequence("first_fold", "last_fold"))).drop("cell", "first_fold", "last_fold")


def block_overlaps(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per fold the rows that lie in more than one of its blocks, from row counts per cell and the blocks' bounds."""
    cut = cells(bounds)
    sizes = with_cell(rows.select("kickoff"), cut).groupBy("cell").agg(F.count("*").alias("n"))
    spread = cut.withColumn("fold_id", F.explode(F.sequence("first_fold", "last_fold"))).groupBy("fold_id", "cell").agg(F.count("*").alias("blocks"))
    found = bounds.select("fold_id").join(spread.join(sizes, "cell").where("blocks > 1"), "fold_id", "left")
    return found.groupBy("fold_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("overlap"))


def train_sums(rows: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """Per fold the number of train rows (``n``) and the sums of ``columns`` over them.

    A train block is the rows up to its end less the rows before its start. Sums up to an instant are those of
    the days before, from one running sum over calendar days, plus its own day's; no row is copied.
    """
    names = ["n", *columns]
    per = rows.groupBy(X.instant("kickoff").alias("at")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns])
    per = per.withColumn("day", F.floor(F.col("at") / F.lit(X.DAY_MICROS)))
    ends = F.array(
        F.struct(X.instant("train_end").alias("upto"), F.lit(1).alias("sign")),
        F.struct((X.instant("train_start") - 1).alias("upto"), F.lit(-1).alias("sign")),
    )
    asked = bounds.select("fold_id", F.explode(ends).alias("x")).select("fold_id", "x.*").withColumn("day", F.floor(F.col("upto") / F.lit(X.DAY_MICROS)))
    zero = [F.lit(0).alias(c) for c in names]
    days = per.select("day", *names).unionByName(asked.select("day", *zero)).groupBy("day").agg(*[F.sum(c).alias(c) for c in names])
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    base = days.select("day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in names])
    inside = asked.join(per, "day", "left").where(F.col("at").isNull() | (F.col("at") <= F.col("upto")))
    own = inside.groupBy("fold_id", "sign").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    upto = asked.join(base, "day").join(own, ["fold_id", "sign"], "left")
    return upto.groupBy("fold_id").agg(*[F.sum(F.col("sign") * (F.col(f"base_{c}") + F.coalesce(c, F.lit(0)))).alias(c) for c in names])
