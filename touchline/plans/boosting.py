"""Boosted trees with a softmax loss, grown from histograms; many groups (trial, fold) in the same passes.

Columns are cut once into at most ``bins`` - 1 quantile bins and one bin for missing values, which learns its own side
at every split. In each round one tree per class is grown from the sums of gradients and curvatures per (leaf, column,
bin). The leaves with the best gains are split first, at most half of the remaining leaf budget in one pass, and the
others stay in the running. Gradients are whole numbers (units of 2^-24), so sums are exact and the trees are the same
for any split of the rows into partitions, for either way below, and after a lost executor.

*Passes*: the rows lie in cached blocks with their scores and slopes. Each pass is one job for all groups, classes and new
leaves: tasks add up the smaller child of every split, the sums are added up by (group, class), which keeps the histograms
of its open leaves and has the larger child as the difference, and only the best split of each leaf reaches the driver.
Scores and slopes are carried on once per round and written every ``HELD`` rounds. *In one task per group*: groups of at most
``TASK_ROWS`` train rows are gathered by group and grown there, all groups side by side. Both call the same functions.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import scalars as X
from touchline.session import materialise, remove, require_checkpoints

UNIT = float(1 << 24)
HELD = 10
TASK_ROWS = 100_000
BLOCK_ROWS = 1 << 17
PART_ROWS = 1 << 20
CELLS = 4096  # most cells of columns that are counted together
NEVER = -(1 << 63)  # of rows without an instant
LEAST_GAIN = 1e-7
CLASSES = 3
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}  # types of key columns


@dataclass(frozen=True)
class Growth:
    """Parameters of one fit; ``curvature`` scales p (1 - p), as boosters differ in it."""

    learning_rate: float = 0.1
    rounds: int = 100
    leaves: int = 31
    min_leaf: int = 20
    curvature: float = 1.0
    bins: int = 64

    def check(self) -> Growth:
        if self.rounds < 1 or self.leaves < 2 or self.min_leaf < 1 or not 3 <= self.bins <= 256 or not 0 < self.learning_rate <= 1:
            raise ValueError(f"booster parameters out of range: {self}")
        return self


@dataclass(frozen=True)
class Group:
    """One fit: the rows with ``low <= kickoff <= high`` (micros; None: all) under its parameters."""

    key: tuple
    growth: Growth
    low: int | None = None
    high: int | None = None


# ---------------------------------------------------------------- bins


def bin_edges(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of the value bins of every column, by one pass of quantile sketches, which are merged column by column."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    values = rows.select(F.posexplode(F.array(*[F.col(c).cast("float").cast("double") for c in columns])).alias("j", "v"))
    sketches = values.groupBy("j").agg(F.percentile_approx("v", shares, 10_000).alias("e")).collect()  # columns x bins
    edges = {r["j"]: r["e"] for r in sketches}
    return [np.unique(np.array(edges.get(j) or [], float)) for j in range(len(columns))]


def to_bins(values: np.ndarray, edges: list[np.ndarray], bins: int) -> np.ndarray:
    """Bin numbers of a (rows, columns) matrix; NaN goes to the last bin."""
    out = np.empty(values.shape, np.uint8)
    for j, e in enumerate(edges):
        x = values[:, j]
        out[:, j] = np.where(np.isnan(x), bins - 1, np.searchsorted(e, x, "left"))
    return out


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """float32 values as doubles; missing is NaN."""
    cols = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
    return np.stack(cols, axis=1).astype(np.float32).astype(np.float64) if cols else np.empty((batch.num_rows, 0))


def binned(rows: DataFrame, edges: list[np.ndarray], columns: list[str], bins: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``bins``, one byte per column."""

    def run(batches):
        for b in batches:
            codes = to_bins(matrix(b, columns), edges, bins)
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in keep} | {"bins": pa.array([r.tobytes() for r in codes], pa.binary())})

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    typed = rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns if c not in keep])
    return typed.mapInArrow(run, f"{fields}, bins binary")


def codes_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


# ---------------------------------------------------------------- trees


class Tree:
    """Flat arrays of one growing tree; a leaf has feature -1. ``sums`` are (gradient, curvature, rows) per node, unknown for a root that was not split."""

    def __init__(self):
        self.feature, self.cut, self.missing_left, self.left, self.right, self.gain, self.sums = [-1], [0], [False], [-1], [-1], [0.0], [None]

    def split(self, node: int, found: dict) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node], self.gain[node] = (found[c] for c in ("feature", "cut", "missing_left", "gain"))
        if self.sums[node] is None:
            self.sums[node] = tuple(a + b for a, b in zip(found["below"], found["above"], strict=True))
        children = []
        for part in ("below", "above"):
            children.append(len(self.feature))
            for arr, v in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.gain, 0.0), (self.sums, found[part])):
                arr.append(v)
        self.left[node], self.right[node] = children
        return children[0], children[1]

    @property
    def rows(self) -> list[int]:
        return [0 if s is None else int(s[2]) for s in self.sums]


def reach(code, every: np.ndarray, tree, wanted: list[int] | None = None) -> dict[int, np.ndarray]:
    """Rows of each leaf, or of the wanted leaves only; ``code(column, rows)`` gives bin numbers and the one of missing values."""
    last = len(tree.feature)
    needed = set(range(last)) if wanted is None else set(wanted)
    for node in range(last - 1, -1, -1):  # children have larger numbers
        if tree.left[node] in needed or tree.right[node] in needed:
            needed.add(node)
    out, open_ = {}, [(0, every)]
    while open_:
        node, rows = open_.pop()
        if node not in needed:
            continue
        if tree.feature[node] < 0:
            out[node] = rows
            continue
        at, gone = code(tree.feature[node], rows)
        down = at <= tree.cut[node]
        if tree.missing_left[node]:
            down |= at == gone
        elif tree.cut[node] >= gone:
            down &= at != gone
        open_ += [(tree.left[node], rows[down]), (tree.right[node], rows[~down])]
    return out


def leaf_values(tree: Tree, rate: float) -> np.ndarray:
    return np.array([0.0 if s is None or s[1] <= 0 else -rate * s[0] / s[1] for s in tree.sums])


class Grower:
    """Order of the splits of one tree: best gains first, at most half of the remaining leaves in one pass."""

    def __init__(self, leaves: int):
        self.tree, self.budget, self.fresh, self.pool = Tree(), leaves - 1, [0], {}

    def offer(self, found: dict[int, dict]) -> list[tuple[int, int, int]]:
        """Take the best splits of the leaves asked for; returns (node, left, right) of those made now."""
        self.pool |= found
        ranked = sorted(self.pool, key=lambda n: (-self.pool[n]["gain"], n))[: (self.budget + 1) // 2]
        made = [(n, *self.tree.split(n, self.pool.pop(n))) for n in ranked]
        self.budget -= len(made)
        self.fresh = [c for _, *pair in made for c in pair] if self.budget else []
        return made


class Layout:
    """Columns whose bins in use make at most ``CELLS`` cells together share one cell number; ``sizes`` are bins in use, the last for missing values."""

    def __init__(self, sizes: list[int], bins: int):
        self.sizes, self.bins = sizes, bins
        self.packs: list[list[int]] = []
        self.cells: list[int] = []
        for j in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
            pack = next((i for i, n in enumerate(self.cells) if n * sizes[j] <= CELLS), len(self.packs))
            if pack == len(self.packs):
                self.packs.append([])
                self.cells.append(1)
            self.packs[pack].append(j)
            self.cells[pack] *= sizes[j]
        self.place = {}  # column -> (pack, cells of the columns after it)
        for i, (pack, rest) in enumerate(zip(self.packs, self.cells, strict=True)):
            for j in pack:
                rest //= sizes[j]
                self.place[j] = (i, rest)
        self.ends = np.cumsum(sizes).tolist()
        self.spots = np.concatenate([j * bins + np.append(np.arange(n - 1), bins - 1) for j, n in enumerate(sizes)])

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """(pack, rows): cell numbers of a (rows, columns) matrix of bin numbers."""
        out = np.zeros((len(self.packs), len(codes)), np.uint16)
        for j, (i, rest) in self.place.items():
            out[i] += np.minimum(codes[:, j], self.sizes[j] - 1).astype(np.uint16) * np.uint16(rest)
        return out

    def decode(self, j: int, cell: np.ndarray) -> np.ndarray:
        """Bins of a column, missing values last, from cell numbers of its pack."""
        i, rest = self.place[j]
        code = cell // np.uint16(rest) if rest > 1 else cell
        return code if j == self.packs[i][0] else code % np.uint16(self.sizes[j])

    def columns(self, pack: list[int], sums: np.ndarray):
        """Sums by bin of each column of a pack, from (node, cell) sums."""
        for j in pack:
            parts = sums.reshape(len(sums), self.sizes[j], -1)
            yield j, parts @ np.ones(parts.shape[2])
            sums = np.ones(self.sizes[j]) @ parts

    def part(self, j: int) -> slice:
        """Where the bins in use of a column lie."""
        return slice(self.ends[j] - self.sizes[j], self.ends[j])

    def whole(self, sums: np.ndarray) -> np.ndarray:
        """(..., column, bin), with missing values in the last bin, from (..., bins in use)."""
        out = np.zeros((*sums.shape[:-1], len(self.sizes) * self.bins))
        out[..., self.spots] = sums
        return out.reshape(*sums.shape[:-1], len(self.sizes), self.bins)


class Cells:
    """Packed codes of the rows at hand; adds up the histograms of several nodes together."""

    def __init__(self, codes: np.ndarray, bins: int, sizes: list[int] | None = None):
        self.layout = Layout(sizes or [bins] * codes.shape[1], bins)
        self.packed = self.layout.pack(codes)
        self.rows = len(codes)

    @classmethod
    def of(cls, layout: Layout, packed: np.ndarray) -> Cells:
        made = cls.__new__(cls)
        made.layout, made.packed, made.rows = layout, packed, packed.shape[1]
        return made

    def code(self, j: int, rows: np.ndarray) -> tuple[np.ndarray, int]:
        return self.layout.decode(j, self.packed[self.layout.place[j][0]].take(rows)), self.layout.sizes[j] - 1

    def add_up(self, nodes: list[np.ndarray], *weights: np.ndarray) -> np.ndarray:
        """(node, weight, column, bin): sums of every weight and, last, numbers of rows."""
        return self.layout.whole(self.sums(nodes, *weights))

    def sums(self, nodes: list[np.ndarray], *weights: np.ndarray) -> np.ndarray:
        """The same as (node, weight, bins in use of all columns).

        Nodes of many rows are counted by cells, which hold the sums of all columns of a pack; others column by column. The
        sums are whole numbers, so both ways give the same.
        """
        counts, lay = [len(rows) for rows in nodes], self.layout
        whole = len(nodes) == 1 and counts[0] == self.rows
        at = None if whole else np.concatenate(nodes)
        place = np.repeat(np.arange(len(nodes)), counts) if len(nodes) > 1 else 0
        weights = [*((w if whole else w.take(at)).astype(float, copy=False) for w in weights), None]
        out = np.empty((len(nodes), len(weights), lay.ends[-1]))
        for pack, size, packed in zip(lay.packs, lay.cells, self.packed, strict=True):
            cell = packed if whole else packed.take(at)
            if sum(counts) > len(nodes) * size:
                index = cell + place * np.int64(size)
                for i, w in enumerate(weights):
                    both = np.bincount(index, w, len(nodes) * size).reshape(len(nodes), size)
                    for j, part in lay.columns(pack, both):
                        out[:, i, lay.part(j)] = part
                continue
            for j in pack:
                n, part = lay.sizes[j], lay.part(j)
                index = lay.decode(j, cell) + place * np.int64(n)
                for i, w in enumerate(weights):
                    out[:, i, part] = np.bincount(index, w, len(nodes) * n).reshape(len(nodes), n)
        return out


def histogram(codes: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """(3, column, bin): sums of gradients, curvatures and rows."""
    return Cells(codes, bins).add_up([np.arange(len(codes))], g, h)[0]


def best_splits(hists: np.ndarray, growth: Growth) -> list[dict | None]:
    """Per node the split with the largest gain; ties go to the first column, then the lowest cut, then missing values above."""
    total = hists[:, :, 0].sum(axis=-1)[..., None, None]
    value = np.cumsum(hists[..., :-1], axis=-1)[..., :-1]  # cut after value bin b; the last value bin has nothing above it
    sides = (value, value + hists[..., -1:])  # missing above or below
    score = lambda s: s[:, 0] ** 2 / s[:, 1]
    gain = np.empty((*value[:, 0].shape, 2))
    for side, below in enumerate(sides):
        above = total - below
        ok = (below[:, 2] >= growth.min_leaf) & (above[:, 2] >= growth.min_leaf) & (below[:, 1] > 0) & (above[:, 1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain[..., side] = np.where(ok, score(below) + score(above) - score(total), -np.inf) / UNIT
    line = gain.reshape(len(hists), -1)
    # equal partitions may differ in the last bits
    at = (line >= line.max(axis=1, keepdims=True) * (1 - 1e-12)).argmax(axis=1)
    out: list[dict | None] = []
    for node, spot in enumerate(at.tolist()):
        if not line[node, spot] > LEAST_GAIN:
            out.append(None)
            continue
        j, cut, side = (int(x) for x in np.unravel_index(spot, gain.shape[1:]))
        below = sides[side][node, :, j, cut]
        out.append({
            "gain": float(line[node, spot]), "feature": j, "cut": cut, "missing_left": bool(side),
            "below": tuple(below.tolist()), "above": tuple((total[node, :, 0, 0] - below).tolist()),
        })
    return out


def best_split(hist: np.ndarray, growth: Growth) -> dict | None:
    """The best split of one node."""
    return best_splits(hist[None], growth)[0]


def small_first(tree: Tree, node: int, left: int, right: int) -> tuple[int, int, int]:
    """A split as (node, smaller child, larger child)."""
    return (node, left, right) if tree.sums[left][2] <= tree.sums[right][2] else (node, right, left)


def search(hists: dict[int, np.ndarray], fresh: list[int], pairs: list[tuple[int, int, int]], part: np.ndarray, layout: Layout, growth: Growth) -> dict[int, dict]:
    """Best splits of the new leaves of a tree; ``hists`` keeps the sums of the leaves that may be split later.

    ``part`` has the sums by bins in use of root, or of the smaller children; a larger child's is its parent's less its sibling's.
    """
    if fresh == [0]:
        hists[0] = part[0]
    for (node, small, large), mine in zip(pairs, part, strict=fresh != [0]):
        hists[small], hists[large] = mine, hists.pop(node) - mine
    found = {n: s for n, s in zip(fresh, best_splits(layout.whole(np.stack([hists[n] for n in fresh])), growth), strict=True) if s}
    for n in set(fresh) - set(found):
        hists.pop(n)
    return found


def by_class(sums: np.ndarray) -> list[np.ndarray]:
    """Sums per class, from those of the slopes of all classes."""
    return [sums[:, [2 * k, 2 * k + 1, -1]] for k in range(CLASSES)]


def slopes(p: np.ndarray, label: np.ndarray, k: int, curvature: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole-numbered gradient and curvature of class ``k`` at the probabilities ``p``."""
    p = p[:, k]
    return np.rint((p - (label == k)) * UNIT), np.rint(np.maximum(curvature * p * (1 - p), 1e-6) * UNIT)


def gradients(scores: np.ndarray, label: np.ndarray, k: int, curvature: float) -> tuple[np.ndarray, np.ndarray]:
    """The same at scores."""
    return slopes(softmax(scores), label, k, curvature)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def start_scores(counts) -> list[float]:
    """Log shares of the classes."""
    n = sum(counts)
    if sum(c > 0 for c in counts) < 2:
        raise ValueError(f"training rows hold fewer than two classes: {list(counts)}")
    return [math.log(c / n) if c else -30.0 for c in counts]


# ---------------------------------------------------------------- model


@dataclass
class Trees:
    """A fitted model: start scores, then per round one tree per class with its leaf values."""

    columns: list[str]
    edges: list[np.ndarray]
    bins: int
    start: list[float]
    trees: list[tuple[int, dict, np.ndarray]] = field(default_factory=list)  # (class, flat arrays, values)
    losses: list[float] = field(default_factory=list)  # mean train loss before each round and at the end

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.start, float), (len(codes), 1))
        one, every = np.ascontiguousarray(codes.T), np.arange(len(codes))
        for k, tree, values in self.trees:
            climb(out[:, k], lambda j, rows: (one[j].take(rows), self.bins - 1), every, tree, values)
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return softmax(self.scores(to_bins(values, self.edges, self.bins)))

    def as_dict(self) -> dict:
        trees = [{"k": k, "values": [float(v) for v in values], **{n: np.asarray(a).tolist() for n, a in t.items()}} for k, t, values in self.trees]
        return {"columns": self.columns, "edges": [e.tolist() for e in self.edges], "bins": self.bins, "start": self.start, "trees": trees, "losses": self.losses}

    @classmethod
    def from_dict(cls, d: dict) -> Trees:
        trees = [(t["k"], {n: np.asarray(t[n]) for n in FLAT}, np.asarray(t["values"])) for t in d["trees"]]
        return cls(d["columns"], [np.asarray(e, float) for e in d["edges"]], d["bins"], d["start"], trees, d["losses"])


FLAT = ("feature", "cut", "missing_left", "left", "right", "gain", "rows")


class _Flat:
    def __init__(self, arrays: dict):
        self.__dict__.update({n: np.asarray(a).tolist() for n, a in arrays.items()})


def climb(scores: np.ndarray, code, every: np.ndarray, tree: dict, values: np.ndarray) -> None:
    """Add a tree's values to the scores of its class."""
    for leaf, rows in reach(code, every, _Flat(tree)).items():
        scores[rows] += values[leaf]


def flat(tree: Tree) -> dict:
    kinds = (np.int16, np.uint8, bool, np.int32, np.int32, float, np.int64)
    return {n: np.asarray(getattr(tree, n), t) for n, t in zip(FLAT, kinds, strict=True)}


# ---------------------------------------------------------------- one task per group


def grow_here(codes: np.ndarray, label: np.ndarray, growth: Growth, rounds: int | None = None, sizes: list[int] | None = None) -> tuple[list[float], list, list[float]]:
    """Start scores, trees and losses of a fit whose rows are all here; a child's histogram is its parent's less its sibling's."""
    start = start_scores(np.bincount(label, minlength=CLASSES).tolist())
    scores = np.tile(np.array(start), (len(label), 1))
    cells, every = Cells(codes, growth.bins, sizes), np.arange(len(label))
    trees, losses = [], []
    for _ in range(growth.rounds if rounds is None else rounds):
        p = softmax(scores)
        losses.append(loss_at(p, label))
        steps = [slopes(p, label, k, growth.curvature) for k in range(CLASSES)]
        roots = by_class(cells.sums([every], *[w for pair in steps for w in pair]))
        for k, (g, h) in enumerate(steps):
            grower = Grower(growth.leaves)
            rows, hists, pairs = {0: every}, {}, []
            part = roots[k]
            while grower.fresh:
                found = search(hists, grower.fresh, pairs, part, cells.layout, growth)
                pairs = []
                for node, left, right in grower.offer(found):
                    mine, t = rows.pop(node), grower.tree
                    code, gone = cells.code(t.feature[node], mine)
                    down = code <= t.cut[node]
                    if t.missing_left[node]:
                        down |= code == gone
                    rows[left], rows[right] = mine[down], mine[~down]
                    pairs.append(small_first(t, node, left, right))
                if grower.fresh:
                    part = cells.sums([rows[s] for _, s, _ in pairs], g, h)
            values = leaf_values(grower.tree, growth.learning_rate)
            for node, at in rows.items():
                scores[at, k] += values[node]
            trees.append((k, flat(grower.tree), values))
    losses.append(loss_of(scores, label))
    return start, trees, losses


def loss_at(p: np.ndarray, label: np.ndarray) -> float:
    return float(-np.log(np.maximum(p[np.arange(len(label)), label], X.EPS)).mean())


def loss_of(scores: np.ndarray, label: np.ndarray) -> float:
    return loss_at(softmax(scores), label)


TREE_ROWS = "job int, start array<double>, losses array<double>, k array<int>, sizes array<int>, feature array<int>, cut array<int>, missing_left array<boolean>, left array<int>, right array<int>, gain array<double>, rows array<long>, value array<double>"


def deal(data: DataFrame, groups: list[Group]) -> DataFrame:
    """The rows of group i in partition i: by hash, groups would meet in one partition and wait for each other."""
    at = F.col("at")
    inside = [(F.lit(True) if g.low is None else at >= g.low) & (F.lit(True) if g.high is None else at <= g.high) for g in groups]
    dealt = data.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]))).alias("job"), "label", "bins")
    return dealt.repartitionById(len(groups), "job")


def fit_in_tasks(data: DataFrame, groups: list[Group], sizes: list[int]) -> dict[int, tuple]:
    """Groups grown in one task each; ``data`` has label, at, bins."""

    def run(batches):
        """A task has the rows of one group."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        job = table.column("job")[0].as_py()
        codes = codes_of(table.column("bins").combine_chunks(), len(sizes))
        start, trees, losses = grow_here(codes, table.column("label").to_numpy().astype(np.int64), groups[job].growth, sizes=sizes)
        joined = {n: [v.item() for _, t, _ in trees for v in t[n]] for n in FLAT}
        row = {"job": job, "start": start, "losses": losses, "k": [k for k, _, _ in trees], "sizes": [len(v) for _, _, v in trees], **joined, "value": [float(x) for _, _, v in trees for x in v]}
        ints, reals = pa.list_(pa.int32()), pa.list_(pa.float64())
        kinds = [pa.int32(), reals, reals, ints, ints, ints, ints, pa.list_(pa.bool_()), ints, ints, reals, pa.list_(pa.int64()), reals]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    out = {}
    for r in deal(data, groups).mapInArrow(run, TREE_ROWS).collect():  # models: rounds x leaves x groups
        ends = np.cumsum(r["sizes"])
        trees = []
        for k, end, size in zip(r["k"], ends, r["sizes"], strict=True):
            part = slice(int(end) - size, int(end))
            trees.append((k, {n: np.asarray(r[n][part]) for n in FLAT}, np.asarray(r["value"][part])))
        out[r["job"]] = (list(r["start"]), trees, list(r["losses"]))
    return out


# ---------------------------------------------------------------- passes over all rows


def blocks_of(data: DataFrame, parts: int, layout: Layout) -> RDD:
    """Blocks (cell numbers, label, at) of at most ``BLOCK_ROWS`` rows, dealt evenly over the partitions."""

    def join(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) + b.num_rows > BLOCK_ROWS:
                yield row(held)
                held = []
        if any(b.num_rows for b in held):
            yield row(held)

    def row(held):
        table = pa.Table.from_batches(held).combine_chunks()
        codes = codes_of(table.column("bins").combine_chunks(), len(layout.sizes))
        parts = layout.pack(codes), table.column("label").to_numpy().astype(np.int8), table.column("at").to_numpy().astype(np.int64)
        return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["cells", "label", "at"])

    def arrays(r):
        label, at = np.frombuffer(r[1], np.int8), np.frombuffer(r[2], np.int64)
        return np.frombuffer(r[0], np.uint16).reshape(-1, len(label)), label, at

    return data.select("label", F.coalesce("at", F.lit(NEVER)).alias("at"), "bins").repartition(parts).mapInArrow(join, "cells binary, label binary, at binary").rdd.map(arrays)


def rows_inside(at: np.ndarray, group: Group) -> np.ndarray:
    """Numbers of the group's rows; rows without an instant are in groups without bounds only."""
    if group.low is None and group.high is None:
        return np.arange(len(at))
    low, high = NEVER + 1 if group.low is None else group.low, at.max(initial=0) if group.high is None else group.high
    return np.flatnonzero((at >= low) & (at <= high))


def fit_in_passes(data: DataFrame, groups: list[Group], sizes: list[int], counts: list[list[int]]) -> dict[int, tuple]:
    """All groups grown together, one job over the rows per pass; ``data`` has label, at, bins, ``counts`` are rows per group and class."""
    sc, n_jobs, layout = data.sparkSession.sparkContext, len(groups), Layout(sizes, groups[0].growth.bins)
    require_checkpoints(data.sparkSession)
    starts = [start_scores(c) for c in counts]
    cores = sc.defaultParallelism
    spread = min(n_jobs * CLASSES, cores)
    kind = np.int32 if max(g.growth.curvature for g in groups) < 256 else np.int64

    def place(key: tuple[int, int]) -> int:
        return key[0] * CLASSES + key[1]

    def stepped(cells, label, at, scores) -> tuple:
        """A block with its slopes (job, class, 2, row) and the loss of every job."""
        steps, lost = np.empty((n_jobs, CLASSES, 2, len(label)), kind), []
        for i, g in enumerate(groups):
            p, mine = softmax(scores[i]), rows_inside(at, g)
            lost.append(float(-np.log(np.maximum(p[mine, label[mine]], X.EPS)).sum()))
            for k in range(CLASSES):
                steps[i, k] = slopes(p, label, k, g.growth.curvature)
        return cells, label, at, scores, steps, lost

    def opened(block) -> tuple:
        return stepped(*block, np.repeat(np.array(starts, float)[:, None], len(block[1]), axis=1))

    def one_pass(state: RDD, growers: dict[tuple[int, int], Grower], pairs: dict[tuple[int, int], list], kept: RDD | None) -> RDD:
        """((job, class), (histograms of open leaves, best splits of the new ones, loss))"""
        asked = {key: (g.tree, list(g.fresh), pairs.get(key, [])) for key, g in growers.items() if g.fresh}
        opening = kept is None

        def collect(blocks):
            total: dict[tuple[int, int], list] = {}
            for packed, _, at, _, steps, lost in blocks:
                cells = Cells.of(layout, packed)
                for job in {j for j, _ in asked}:
                    every = rows_inside(at, groups[job])
                    if opening:
                        parts = enumerate(by_class(cells.sums([every], *steps[job].reshape(2 * CLASSES, -1))))
                    else:
                        parts = ((k, children(cells, every, steps[job, k], *asked[job, k])) for k in range(CLASSES) if (job, k) in asked)
                    for k, part in parts:
                        t = total.setdefault((job, k), [0.0, 0.0])
                        t[0], t[1] = t[0] + part, t[1] + lost[job]
            return iter(total.items())

        def children(cells, every, steps, tree, _, made):
            rows = reach(cells.code, every, tree, [small for _, small, _ in made])
            return cells.sums([rows[small] for _, small, _ in made], *steps)

        def searched(items):
            parts: dict[tuple[int, int], list] = {}
            held = {}
            for key, v in items:
                if isinstance(v, dict):
                    held[key] = v
                elif key in parts:
                    parts[key] = [a + b for a, b in zip(parts[key], v, strict=True)]
                else:
                    parts[key] = v
            for key, (part, lost) in parts.items():
                _, fresh, made = asked[key]
                hists = held.get(key, {})
                yield key, (hists, search(hists, fresh, made, part, layout, groups[key[0]].growth), lost)

        sums = state.mapPartitions(collect).partitionBy(spread, place)
        if not opening:
            sums = sums.union(kept.mapValues(lambda v: v[0]))  # lies by the same keys
        return sums.mapPartitions(searched, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)

    def carried(trees: list[list[tuple]]):
        def carry(block) -> tuple:
            packed, label, at, scores = block[:4]
            cells, every = Cells.of(layout, packed), np.arange(len(label))
            for job, grown in enumerate(trees):
                for k, tree, values in grown:
                    climb(scores[job, :, k], cells.code, every, tree, values)
            return stepped(packed, label, at, scores)

        return carry

    last = max(g.growth.rounds for g in groups)
    parts = cores * max(1, math.ceil(data.count() / (cores * PART_ROWS)))
    state = blocks_of(data, parts, layout).map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    models: list[list] = [[] for _ in groups]
    losses: list[list[float]] = [[] for _ in groups]
    before, written = None, None  # the state of the last round, the file of the last written one
    for step in range(last):
        growers = {(i, k): Grower(g.growth.leaves) for i, g in enumerate(groups) if step < g.growth.rounds for k in range(CLASSES)}
        pairs: dict[tuple[int, int], list] = {}
        kept = None
        while any(g.fresh for g in growers.values()):
            now = one_pass(state, growers, pairs, kept)
            found = now.mapValues(lambda v: v[1:]).collect()  # splits, at most one per new leaf
            if kept is None:
                for i in sorted({i for i, _ in growers}):
                    losses[i].append(next(lost for key, (_, lost) in found if key == (i, 0)) / sum(counts[i]))
                if before is not None:
                    before.unpersist()
                if state.isCheckpointed() and state.getCheckpointFile() != written:
                    if written:
                        remove(data.sparkSession, written)
                    written = state.getCheckpointFile()
            else:
                kept.unpersist()
            kept = now
            splits = {key: s for key, (s, _) in found}
            pairs = {key: [small_first(g.tree, *made) for made in g.offer(splits.get(key, {}))] for key, g in growers.items() if g.fresh}
        kept.unpersist()
        grown: list[list[tuple]] = [[] for _ in groups]
        for (i, k), g in growers.items():
            grown[i].append((k, flat(g.tree), leaf_values(g.tree, groups[i].growth.learning_rate)))
        for i, entries in enumerate(grown):
            models[i] += entries
        before, state = state, state.map(carried(grown)).persist(StorageLevel.MEMORY_AND_DISK)
        if (step + 1) % HELD == 0 and step + 1 < last:
            state.checkpoint()
    ends = state.map(lambda block: block[5]).collect()  # one number per block and group
    for held in (before, state):
        held.unpersist()
    if written:
        remove(data.sparkSession, written)
    for i in range(n_jobs):
        losses[i].append(sum(e[i] for e in ends) / sum(counts[i]))
    return {i: (starts[i], models[i], losses[i]) for i in range(n_jobs)}


# ---------------------------------------------------------------- fit


def fit(rows: DataFrame, groups: list[Group], columns: list[str] | None = None, edges: list[np.ndarray] | None = None, task_rows: int = TASK_ROWS) -> dict[tuple, Trees]:
    """A model per group. ``rows`` have the targets, the columns, and kickoff where a group has bounds.

    Bin edges come from the rows up to the earliest end of a train block, so no group sees values from after its own
    train block, and all groups share them.
    """
    columns = columns or N.FEATURES
    bins = groups[0].growth.check().bins
    if any(g.growth.check().bins != bins for g in groups):
        raise ValueError("all groups must have the same number of bins")
    at = X.instant("kickoff") if "kickoff" in rows.columns else F.lit(0).cast("long")
    wide = rows.select(X.target_label(*[F.col(c) for c in N.TARGETS]).cast("int").alias("label"), at.alias("at"), *columns)
    ends = [g.high for g in groups if g.high is not None]
    if edges is None:
        edges = bin_edges(wide.where(F.col("at") <= min(ends)) if ends else wide, columns, bins)
    data = materialise(binned(wide, edges, columns, bins, ["label", "at"]), "binned")
    bound = [(F.lit(True) if g.low is None else F.col("at") >= g.low) & (F.lit(True) if g.high is None else F.col("at") <= g.high) for g in groups]
    counted = data.agg(*[F.count(F.when(c & (F.col("label") == k), 1)).alias(f"c{i}_{k}") for i, c in enumerate(bound) for k in range(CLASSES)]).first()
    counts = [[counted[f"c{i}_{k}"] for k in range(CLASSES)] for i in range(len(groups))]
    if not all(map(any, counts)):
        raise ValueError("a group has no training rows")
    sizes = [min(len(e) + 2, bins) for e in edges]  # bins in use
    fits = fit_in_tasks(data, groups, sizes) if max(map(sum, counts)) <= task_rows else fit_in_passes(data, groups, sizes, counts)
    return {g.key: Trees(list(columns), edges, bins, *fits[i]) for i, g in enumerate(groups)}


def forecast(rows: DataFrame, models: dict[tuple, Trees], keys: dict[str, str], keep: list[str], inside: dict[tuple, list[tuple[str, int, int]]] | None = None) -> DataFrame:
    """``keep``, the key columns (name -> type) and the three probabilities of every row under every model.

    ``inside`` limits a model to named kickoff intervals (name, low, high) and adds the name as ``block``. The models
    go to the tasks: rounds x leaves x groups, fixed by the parameters.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)
    columns = next(iter(models.values())).columns
    at = X.instant("kickoff") if inside is not None else F.lit(0).cast("long")
    typed = rows.select(*keep, at.alias("_at"), *[F.col(c).cast("double").alias(f"_f_{c}") for c in columns])
    fields = [*[f"{n} {t}" for n, t in keys.items()], *["block string"][: inside is not None], *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]]

    def run(batches):
        for b in batches:
            values, when = matrix(b, [f"_f_{c}" for c in columns]), b.column("_at").to_numpy()
            codes: dict[int, np.ndarray] = {}
            for key, model in shared.value.items():
                if id(model.edges) not in codes:
                    codes[id(model.edges)] = to_bins(values, model.edges, model.bins)
                for name, low, high in inside[key] if inside is not None else [("", 0, 0)]:
                    mine = np.flatnonzero((when >= low) & (when <= high))
                    if not len(mine):
                        continue
                    p = softmax(model.scores(codes[id(model.edges)][mine]))
                    part = b.take(pa.array(mine))
                    out = {n: pa.array([v] * len(mine), ARROW[t]) for (n, t), v in zip(keys.items(), key, strict=True)}
                    if inside is not None:
                        out["block"] = pa.array([name] * len(mine))
                    out |= {c: part.column(c) for c in keep}
                    yield pa.RecordBatch.from_pydict(out | {c: pa.array(p[:, i]) for i, c in enumerate(("p_home_win", "p_draw", "p_away_win"))})

    return typed.mapInArrow(run, ", ".join([*fields, "p_home_win double", "p_draw double", "p_away_win double"]))


def growth_of(defaults: dict, hyper: dict) -> Growth:
    merged = {**defaults, **hyper}
    known = set(asdict(Growth()))
    if unknown := set(merged) - known:
        raise ValueError(f"unknown booster parameters {sorted(unknown)}")
    return Growth(**merged).check()
