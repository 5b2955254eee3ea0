"""Packing into optimal length buckets.

Lengths are word counts of whole texts; a text longer than ``max_len`` is cut into pieces, so lengths are at
most ``max_len`` and the global histogram has at most that many rows, whatever the input. Dynamic
programming over it picks the bucket bounds with the least padding. Inside a bucket pieces are numbered
without a global window: shards of about ``SHARD`` rows number their own rows, and running sums of the
shard sizes (one small row each) shift them. ``budget`` tokens of padded pieces make a batch; only the last
batch of a bucket may be short.

A text without words (null, empty, blanks) keeps one row with no bucket and no batch; repeated rows and ids
are packed one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import materialise

from .columns import SPACED, text_rows

SHARD = 50_000


def optimal_bounds(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """At most ``n_buckets`` upper bounds whose total padding is least; the last bound is the longest length."""
    lengths = np.array(sorted(histogram), np.int64)
    m = len(lengths)
    if not m:
        return []
    counts = np.array([histogram[x] for x in lengths], np.float64)
    n = np.concatenate([[0.0], np.cumsum(counts)])
    tokens = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    best, choice = np.concatenate([[0.0], np.full(m, np.inf)]), []
    for _ in range(min(n_buckets, m)):
        cost, cut = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        cost[0] = 0.0
        for j in range(1, m + 1):  # the bucket holds lengths i..j-1 and pads to the last of them
            total = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(total))
            cost[j] = total[cut[j]]
        best = cost
        choice.append(cut)
    bounds, j = [], m
    for cut in reversed(choice):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def cut_pieces(docs: DataFrame, max_len: int, id_col: str, text_col: str) -> DataFrame:
    """Row number, id, piece number and length of every piece; a text without words is one piece of length 0."""
    counted = text_rows(docs, id_col, text_col).select("id", F.regexp_count("text", F.lit(SPACED)).alias("n"))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / max_len).cast("int") - 1, F.lit(0)))
    cut = counted.select("id", "n", F.explode(pieces).alias("piece"))
    return cut.select(F.monotonically_increasing_id().alias("row"), "id", "piece", F.least(F.lit(max_len), F.col("n") - F.col("piece") * max_len).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, max_len: int = 2048, n_buckets: int = 8, budget: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, n_tokens, bucket, bound, batch (within the bucket), slot, padding."""
    if budget < max_len:
        raise ValueError("a batch must hold the longest piece")
    pieces = materialise(cut_pieces(docs, max_len, id_col, text_col), "packing-pieces")
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most max_len + 1 rows
    total = sum(histogram.values())
    bounds = optimal_bounds({k: v for k, v in histogram.items() if k}, n_buckets)
    known = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bound = F.array_min(F.filter(known, lambda b: b >= F.col("n_tokens")))
    sharded = pieces.withColumn("bound", F.when(F.col("n_tokens") > 0, bound)).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-total // SHARD)))))
    sizes = sharded.groupBy("bound", "shard").agg(F.count("*").alias("size"))
    before = Window.partitionBy("bound").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("bound").alias("b"), F.col("shard").alias("s"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("bound", "shard").orderBy("row")
    numbered = sharded.withColumn("n", F.row_number().over(inside)).join(shifts, F.col("bound").eqNullSafe(F.col("b")) & (F.col("shard") == F.col("s")))
    at, room = F.col("shift") + F.col("n") - 1, F.floor(F.lit(budget) / F.col("bound"))
    return numbered.select(
        F.col("id").alias(id_col), "piece", "n_tokens", (F.array_position(known, F.col("bound")) - 1).cast("int").alias("bucket"), "bound",
        F.when(F.col("bound").isNotNull(), F.floor(at / room)).cast("long").alias("batch"), F.when(F.col("bound").isNotNull(), at % room).cast("long").alias("slot"),
        (F.col("bound") - F.col("n_tokens")).alias("padding"),
    )
