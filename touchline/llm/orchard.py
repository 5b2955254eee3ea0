"""Centroid clustering (Lloyd's rounds) over integer vectors with Orchard's nearest-neighbour search.

For every centroid the other centroids are listed by distance. The search for a vector walks the list of its
present centroid; a centroid not yet visited is measured and marked, a closer one takes over and its own list is
begun, and the walk stops at the first entry strictly beyond twice the present distance: by the triangle
inequality nothing behind it is as close. Ties go to the smaller number, so the entry at exactly twice the
distance is still measured. All vectors of a batch walk in step, as numpy arrays. The lists (k x k) and centroids
(k x dims) have a size fixed by the parameters and go to the tasks; each task returns at most k rows of sums.

All arithmetic is on integers: components are floor(scale * x) with x as double. Vectors with another number of
components, or with a null or non-finite one, are not kept. Components, or sums of squares, beyond 64 bits are
computed with unbounded integers; a distance or inertia that no long can hold is null. Repeated ids and repeated
rows are vectors of their own; a null id is assigned like any other but does not start a centroid. With fewer
vectors than centroids there are as many centroids as vectors; no vector gives an empty result. Starts that tie by
hash are taken in the order of their components. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise

SAFE = 1 << 27  # components below it: 64 squares of differences stay below 2^62
LONG = (1 << 63) - 1
STEP = 4096  # vectors that walk together


def kept_vectors(df: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """Id and vector (array of double) of the rows that can be clustered."""
    x = F.transform(df[vector_col], lambda v: v.cast("double"))
    whole = F.coalesce((F.size(x) == dims) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    return df.where(whole).select(df[id_col].alias("id"), x.alias("x"))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): as int64 where squares are safe, else as unbounded integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not len(x) or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    out = np.empty(x.size, object)
    out[:] = [math.floor(Fraction(v) * scale) for v in x.ravel().tolist()]
    return out.reshape(x.shape)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two equally long matrices."""
    d = a - b
    return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


class Orchard:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, centroids: list[list[int]]):
        k = len(centroids)
        self.small = all(abs(v) < SAFE for c in centroids for v in c)
        self.points = np.array(centroids, np.int64 if self.small else object).reshape(k, -1)
        self.apart = np.array([squares(np.broadcast_to(p, self.points.shape), self.points) for p in self.points], self.points.dtype).reshape(k, k)
        self.lists = np.array([sorted((j for j in range(k) if j != i), key=lambda j: (self.apart[i, j], j)) for i in range(k)], np.int64).reshape(k, k - 1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance of each row."""
        points, apart = self.points, self.apart
        if (vectors.dtype == object) != (points.dtype == object):
            vectors, points, apart = vectors.astype(object), points.astype(object), apart.astype(object)
        n, k = len(vectors), len(points)
        now, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        near = squares(vectors, points[now])
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        walking = np.arange(n)
        while k > 1 and len(walking):
            walking = walking[at[walking] < k - 1]
            other = self.lists[now[walking], at[walking]]
            inside = (apart[now[walking], other] <= 4 * near[walking]).astype(bool)
            walking, other = walking[inside], other[inside]
            at[walking] += 1
            fresh = ~seen[walking, other]
            rows, tried = walking[fresh], other[fresh]
            if not len(rows):
                continue
            seen[rows, tried] = True
            found = squares(vectors[rows], points[tried])
            better = ((found < near[rows]) | ((found == near[rows]) & (tried < now[rows]))).astype(bool)
            rows = rows[better]
            now[rows], near[rows], at[rows] = tried[better], found[better], 0
        return now, near


def batches_of(batches, orchard: Orchard, scale: int):
    """(ids, vectors, cluster, distance) of blocks of vectors."""
    for batch in batches:
        for low in range(0, batch.num_rows, STEP):
            part = batch.slice(low, STEP)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            vectors = integers(flat.reshape(part.num_rows, -1), scale)
            yield part.column(0), vectors, *orchard.nearest(vectors)


def sums(vectors: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of every non-empty cluster; at most one row per centroid reaches the driver."""

    def run(batches):
        orchard, count, total = Orchard(centroids), {}, {}
        for _, x, cluster, _ in batches_of(batches, orchard, scale):
            for c in np.unique(cluster).tolist():
                rows = x[cluster == c]
                count[c] = count.get(c, 0) + len(rows)
                add = [int(v) for v in rows.sum(axis=0)]
                total[c] = [a + b for a, b in zip(total[c], add, strict=True)] if c in total else add
        # sums may exceed a long: three parts of 40 bits, the highest with the sign, are added apart
        low = (1 << 40) - 1
        parts = [[(v & low, v >> 40) for v in total[c]] for c in total]
        wide = [[p if -LONG <= p[1] <= LONG else (0, 0) for p in row] for row in parts]
        huge = [[str(v) if w != p else None for v, p, w in zip(total[c], row, fixed, strict=True)] for c, row, fixed in zip(total, parts, wide, strict=True)]
        yield pa.record_batch(
            [
                pa.array(list(total), pa.int32()), pa.array([count[c] for c in total], pa.int64()),
                pa.array([[p[0] for p in row] for row in wide], pa.list_(pa.int64())), pa.array([[p[1] for p in row] for row in wide], pa.list_(pa.int64())),
                pa.array(huge, pa.list_(pa.string())),
            ],
            names=["cluster", "n", "low", "high", "huge"],
        )

    part = vectors.mapInArrow(run, "cluster int, n long, low array<long>, high array<long>, huge array<string>")
    cell = part.select("cluster", "n", F.posexplode(F.arrays_zip("low", "high", "huge")).alias("j", "v"))
    cell = cell.groupBy("cluster", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("v.low").cast("decimal(38,0)")).alias("low"), F.sum(F.col("v.high").cast("decimal(38,0)")).alias("high"), F.collect_list("v.huge").alias("huge")
    )
    out: dict[int, tuple[int, list[int]]] = {}
    rows = cell.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("j", "low", "high", "huge"))).alias("cells"))
    for r in rows.collect():
        out[r["cluster"]] = (r["n"], [int(c["low"]) + (int(c["high"]) << 40) + sum(map(int, c["huge"])) for c in r["cells"]])
    return out


def first_centroids(vectors: DataFrame, k: int, salt: str, scale: int) -> list[list[int]]:
    """Vectors of the ``k`` least hashes of salt and id."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.where("id is not null").select(order.alias("order"), "x").orderBy("order", "x").limit(k).collect()
    return [integers(np.array([r["x"]], float), scale)[0].tolist() for r in rows]


def as_long(value: int) -> int | None:
    return value if value <= LONG else None


def cluster_vectors(
    df: DataFrame, k: int, rounds: int, dims: int, scale: int, salt: str, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """Id, ``cluster`` and ``distance`` (squared) of every kept vector, as a written table, and the final centroids."""
    spark = df.sparkSession
    vectors = materialise(kept_vectors(df, dims, id_col, vector_col), "vectors")
    centroids = first_centroids(vectors, k, salt, scale)
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in sums(vectors, centroids, scale).items():
            centroids[c] = [t // n for t in total]
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col), centroids

    def run(batches):
        orchard = Orchard(centroids)
        for ids, _, cluster, distance in batches_of(batches, orchard, scale):
            yield pa.record_batch([ids, pa.array(cluster, pa.int32()), pa.array([as_long(int(d)) for d in distance], pa.int64())], names=["id", "cluster", "distance"])

    return materialise(vectors.mapInArrow(run, schema), "clusters").withColumnRenamed("id", id_col), centroids


def inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignment with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; the table of centroids is broadcast."""
    spark = assigned.sparkSession
    wide: Column = F.col("distance").cast("decimal(38,0)")
    # one row per centroid
    rows = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), F.sum(wide)).alias("s")).collect()
    per = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in rows}
    total = None if None in per.values() else as_long(sum(per.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [(c, None if s is None else as_long(s), total, digest[c]) for c, s in sorted(per.items())]
    side = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(side), "cluster")
