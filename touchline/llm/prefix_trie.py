"""Prefix trie of conversations: one node for each distinct sequence of first turns, with counts over its subtree.

Turns are ordered by one global range sort, so a conversation of any length lies over as many tasks as it needs.
A turn is known by a SHA-256 of role and text; a prefix by its depth and by sums of turn digests times powers of a
base, modulo a prime, in four lanes (124 bits). Such sums can be carried from task to task (one small row per
sort partition) and tell every prefix without walking a conversation in one place.

Nodes are the distinct (depth, prefix) with their members counted by partial aggregation. The *weight* of a node is
the number of turns of its members from its depth on. Nodes above a weight bound (hot first turns, hot conversations)
form the top; below them hang subtrees of at most that weight, which are dealt whole to shards. In a shard every
distinct prefix digest gets a slot of a minimal perfect hash (levels of bit arrays, ranked); slots are verified
against the full digests. Counts are scattered into flat numpy arrays and accumulated through the parent slots,
deepest first. What the subtrees add up to goes to the top, which is accumulated in the same way; a top of more than
``TOP`` nodes is accumulated by doubling joins, in as many steps as its depth has bits.

Conversations: a null id names none, its turns are left out. Order: number of the turn (null first), then the digest
of role and text, so turns that share a number have a fixed order; equal rows are turns of their own. Null role or
text counts as empty; empty and very long texts are turns like others (only their digest and length travel). An empty
table with no further conversations has no nodes, not even a root. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise

PRIME = (1 << 31) - 1
BASES = (48271, 1_343_624_437, 950_706_376, 1_226_874_159)  # four bases below PRIME
SHARD = 200_000  # nodes of a shard, on average
TOP = 500_000  # nodes of the top that one task accumulates
BROADCAST = 100_000  # keys of 24 bytes
BLOB = 1 << 16
KEY = ["depth", "hi", "lo"]


# ---------------------------------------------------------------- order and prefix sums


def turn_rows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = False) -> DataFrame:
    """conv, turn, digest of role and text, bytes of the text, with ``texts`` also both; rows without a conversation are left out."""
    role = F.coalesce(df[role_col].cast("string"), F.lit(""))
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    more = [role.alias("role"), text.alias("text")] if texts else []
    size = F.octet_length(text).cast("long")
    rows = df.select(df[conv_col].cast("long").alias("conv"), df[turn_col].cast("long").alias("turn"), digest.alias("digest"), size.alias("bytes"), *more)
    return rows.where("conv is not null")


def powers(base: int, n: int, first: int) -> np.ndarray:
    """base^(first + i) modulo PRIME for i below ``n``."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = pow(base, first, PRIME)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, PRIME)) % np.uint64(PRIME)
        size += more
    return out[:n]


def prefix_sums(batches):
    """Each turn with its number inside the part of its conversation that this sort partition holds, and the sums
    before it (q) and up to it (s)."""
    open_conv, done, held = None, 0, [0] * len(BASES)
    prime = np.uint64(PRIME)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv").to_numpy()
        lanes = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(n, 4).astype(np.uint64) % prime
        new = np.concatenate([[conv[0] != open_conv], conv[1:] != conv[:-1]])
        starts = np.union1d([0], np.flatnonzero(new))
        sizes = np.diff(np.append(starts, n))
        at = np.arange(n) - np.repeat(starts, sizes)
        carried = 0 if new[0] else done
        before, upto = np.empty((4, n), np.uint64), np.empty((4, n), np.uint64)
        for lane, base in enumerate(BASES):
            power = powers(base, int(sizes.max()), 0)[at]
            power[: sizes[0]] = power[: sizes[0]] * np.uint64(pow(base, carried, PRIME)) % prime
            term = lanes[:, lane] * power % prime
            total = np.cumsum(term)
            base_line = np.repeat((total - term)[starts], sizes)
            part = total - base_line
            if carried:
                part[: sizes[0]] += np.uint64(held[lane])
            upto[lane], before[lane] = part % prime, (part - term) % prime
        number = at.copy()
        number[: sizes[0]] += carried
        open_conv, done, held = conv[-1], int(number[-1]) + 1, [int(x[-1]) for x in upto]
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"number": pa.array(number, pa.int64())}
        columns |= {f"s{i}": pa.array(x.astype(np.int64)) for i, x in enumerate(upto)} | {f"q{i}": pa.array(x.astype(np.int64)) for i, x in enumerate(before)}
        yield pa.RecordBatch.from_pydict(columns)


def ordered(turns: DataFrame) -> DataFrame:
    """The turns with their ``number`` (from 0), the prefix sums s0..s3 up to them and q0..q3 before them, as a written table.

    A conversation that lies over several sort partitions gets the count and sums of its earlier parts; there are at
    most two such rows per partition, so these are broadcast.
    """
    lanes = range(len(BASES))
    spread = turns.withColumn("salt", F.rand(7))  # equal rows may be split
    sort = ["conv", "turn", "digest", "salt"]
    ranged = spread.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()).drop("salt")
    more = "number long, " + ", ".join(f"{q}{i} long" for q in "sq" for i in lanes)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    local = materialise(ranged.mapInArrow(prefix_sums, f"{fields}, {more}"), "turns")
    edges = local.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    edges = edges.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv"))
    last = F.max_by(F.struct(*[f"s{i}" for i in lanes]), "number")
    pieces = local.join(F.broadcast(edges), ["part", "conv"]).groupBy("conv", "part").agg(F.max("number").alias("number"), last.alias("s"))
    carry, by_conv = [], {}
    for r in sorted(pieces.collect(), key=lambda r: r["part"]):  # at most two rows per sort partition
        count, held = by_conv.get(r["conv"], (0, (0,) * len(BASES)))
        up = [pow(b, count, PRIME) for b in BASES]
        if count:
            carry.append((r["part"], r["conv"], count, *held, *up))
        by_conv[r["conv"]] = (count + r["number"] + 1, tuple((h + s * p) % PRIME for h, s, p in zip(held, r["s"], up, strict=True)))
    if not carry:
        return local.drop("part")
    schema = "part int, conv long, ahead long, " + ", ".join(f"{x}{i} long" for x in "hp" for i in lanes)
    joined = local.join(F.broadcast(turns.sparkSession.createDataFrame(carry, schema)), ["part", "conv"], "left")
    shifted = {f"{x}{i}": F.when(F.col("ahead").isNull(), F.col(f"{x}{i}")).otherwise((F.col(f"h{i}") + F.col(f"{x}{i}") * F.col(f"p{i}")) % PRIME) for x in "sq" for i in lanes}
    moved = joined.withColumns(shifted | {"number": F.col("number") + F.coalesce("ahead", F.lit(0))})
    return moved.select(*[c for c in local.columns if c != "part"])


# ---------------------------------------------------------------- minimal perfect hash and accumulation


def spread_bits(hi: np.ndarray, lo: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (hi + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) ^ (lo * np.uint64(0xC2B2AE3D27D4EB4F))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct 128-bit keys.

    Level by level the keys left are hashed into twice as many bits; a key alone on its bit stays there, the others
    go on to the next level. The slot is the rank of the bit among all set bits.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.levels, self.n = [], len(hi)
        below, left = 0, np.arange(len(hi))
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("keys are not distinct")
            size = 2 * len(left) + 1
            bit = (spread_bits(hi[left], lo[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(bit, minlength=size) == 1
            self.levels.append((size, alone, np.cumsum(alone) - 1 + below))
            below += int(alone.sum())
            left = left[~alone[bit]]
        self.hi, self.lo = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        at = self.find(hi, lo)
        self.hi[at], self.lo[at] = hi, lo

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slots of keys, not verified; -1 where no level has a bit."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (size, alone, rank) in enumerate(self.levels):
            bit = (spread_bits(hi[left], lo[left], level) % np.uint64(size)).astype(np.int64)
            hit = alone[bit]
            out[left[hit]] = rank[bit[hit]]
            left = left[~hit]
        return out

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slots of keys, verified against the stored keys; -1 for a key that is not there."""
        out = self.find(hi, lo)
        there = out >= 0
        there[there] = (self.hi[out[there]] == hi[there]) & (self.lo[out[there]] == lo[there])
        return np.where(there, out, -1)


def mixed(depth: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Depth and sums (124 bits) as one key of 128 bits: the depth turns the halves by reversible steps."""
    with np.errstate(over="ignore"):
        d = depth.astype(np.uint64)
        return hi.astype(np.uint64) + d * np.uint64(0x9E3779B97F4A7C15), lo.astype(np.uint64) ^ (d * np.uint64(0xD6E8FEB86659FD93))


def accumulate(table: pa.Table) -> pa.Table:
    """Subtree totals of one shard: leaves, saved tokens, children, and the parents' conversations where they are here."""
    col = {c: table.column(c).to_numpy() for c in (*KEY, "p_hi", "p_lo", "conv_id", "n_convs", "leaves", "saved", "children")}
    hi, lo = mixed(col["depth"], col["hi"], col["lo"])
    p_hi, p_lo = mixed(col["depth"] - 1, col["p_hi"], col["p_lo"])
    names = PerfectHash(hi, lo)
    slot = names.slots(hi, lo)
    parent = np.where(col["depth"] > 0, names.slots(p_hi, p_lo), -1)
    n = len(slot)
    # flat arrays by slot
    depth, above = np.empty(n, np.int64), np.empty(n, np.int64)
    leaves, saved, children, first = (np.empty(n, np.int64) for _ in range(4))
    depth[slot], above[slot], first[slot] = col["depth"], parent, col["conv_id"]
    leaves[slot], saved[slot], children[slot] = col["leaves"], col["saved"], col["children"]
    inner = above >= 0
    np.add.at(children, above[inner], 1)
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        leaves[level] = np.where(children[level] == 0, 1, leaves[level])
        up = level[above[level] >= 0]
        np.add.at(leaves, above[up], leaves[up])
        np.add.at(saved, above[up], saved[up])
    outer = table.column("parent_conv_id").combine_chunks()
    conv = np.where(parent >= 0, first[np.maximum(parent, 0)], outer.fill_null(0).to_numpy(zero_copy_only=False))
    unknown = (parent < 0) & outer.is_null().to_numpy(zero_copy_only=False)
    keep = {c: table.column(c) for c in (*KEY, "p_hi", "p_lo", "conv_id", "n_convs")}
    return pa.table(keep | {"parent_conv_id": pa.array(conv, pa.int64(), mask=unknown), "n_children": children[slot], "n_leaves": leaves[slot], "saved_tokens": saved[slot], "is_root": parent < 0})


DONE = "depth long, hi long, lo long, p_hi long, p_lo long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, is_root boolean"


def doubled(top: DataFrame) -> DataFrame:
    """The same totals for a top of any size: step k adds what lies up to 2^k levels below, by joins."""
    sums = [F.sum(c).alias(f"add_{c}") for c in ("leaves", "saved")]
    child = top.groupBy((F.col("depth") - 1).alias("depth"), F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo")).agg(F.count("*").alias("more"))
    state = top.join(child, KEY, "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    state = state.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")))
    parent = top.select((F.col("depth") + 1).alias("d"), F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.col("conv_id").alias("above"))
    state = state.join(parent, (F.col("depth") == F.col("d")) & (F.col("p_hi") == F.col("q_hi")) & (F.col("p_lo") == F.col("q_lo")), "left").drop("d", "q_hi", "q_lo")
    state = state.withColumn("parent_conv_id", F.col("above")).drop("above")
    state = state.withColumns({"j_hi": F.col("p_hi"), "j_lo": F.col("p_lo")})  # key of the ancestor `step` levels up
    state, step = materialise(state, "top"), 1
    deepest = state.agg(F.max("depth")).first()[0] or 0
    while step <= deepest:
        far = state.where(F.col("depth") >= step)
        add = far.groupBy((F.col("depth") - step).alias("depth"), F.col("j_hi").alias("hi"), F.col("j_lo").alias("lo")).agg(*sums)
        jump = state.select(F.col("depth").alias("jd"), F.col("hi").alias("at_hi"), F.col("lo").alias("at_lo"), F.col("j_hi").alias("next_hi"), F.col("j_lo").alias("next_lo"))
        on = (jump["jd"] == state["depth"] - step) & (jump["at_hi"] == state["j_hi"]) & (jump["at_lo"] == state["j_lo"])
        moved = state.join(jump, on, "left").drop("jd", "at_hi", "at_lo", "j_hi", "j_lo").withColumnsRenamed({"next_hi": "j_hi", "next_lo": "j_lo"})
        moved = moved.join(add, KEY, "left")
        for c in ("leaves", "saved"):
            moved = moved.withColumn(c, F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).drop(f"add_{c}")
        state, step = materialise(moved, "top"), 2 * step
    return state.select(*KEY, "p_hi", "p_lo", "conv_id", "n_convs", "parent_conv_id", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


# ---------------------------------------------------------------- members that end at a node


def blobs(batches):
    """Comma-joined conversations of sorted (node, conv) rows, in pieces of about ``BLOB`` bytes."""
    node, first, names, size = None, None, [], 0
    out: list[tuple] = []

    def flush():
        if names:
            out.append((*node, first, ",".join(names)))
            names.clear()

    def table():
        cols = list(zip(*out, strict=True)) or [[]] * 5
        rows = pa.record_batch([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], names=[*KEY, "first", "blob"])
        out.clear()
        return rows

    for batch in batches:
        for *key, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != node or size >= BLOB:
                flush()
                node, first, size = key, conv, 0
            names.append(str(conv))
            size += len(names[-1])
        if len(out) > 1000:
            yield table()
    flush()
    yield table()


def digests(batches):
    """SHA-256 over the pieces of each node, which come in order."""
    node, state, out = None, None, []

    def table():
        cols = list(zip(*out, strict=True)) or [[]] * 4
        out.clear()
        return pa.record_batch([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=[*KEY, "ends_sha256"])

    for batch in batches:
        for *key, _, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key == node:
                state.update(b"," + blob.encode())
                continue
            if node is not None:
                out.append((*node, state.hexdigest()))
            node, state = key, hashlib.sha256(blob.encode())
        yield table()
    if node is not None:
        out.append((*node, state.hexdigest()))
    yield table()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the sorted members that end at each node: pieces are joined where the rows lie, a node's pieces then in one stream."""
    sort = [*KEY, "conv"]
    pieces = ends.repartitionByRange(*sort).sortWithinPartitions(*sort).select(*sort).mapInArrow(blobs, "depth long, hi long, lo long, first long, blob string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, hi long, lo long, ends_sha256 string")


# ---------------------------------------------------------------- the trie


def packed(lanes: list[Column]) -> tuple[Column, Column]:
    return F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3])


def members(turns: DataFrame) -> DataFrame:
    """One row per (conversation, prefix): conv, depth, digest, digest of the parent, bytes of the last turn, turns left."""
    rows = ordered(turns)
    (hi, lo), (p_hi, p_lo) = (packed([F.col(f"{x}{i}") for i in range(4)]) for x in "sq")
    rows = rows.select("conv", (F.col("number") + 1).alias("depth"), "bytes", hi.alias("hi"), lo.alias("lo"), p_hi.alias("p_hi"), p_lo.alias("p_lo"))
    count = rows.groupBy("conv").agg(F.max("depth").alias("n"))
    return materialise(rows.join(count, "conv").withColumn("rem", F.col("n") - F.col("depth") + 1).drop("n"), "members")


def few(keys: DataFrame, n: int) -> DataFrame:
    return F.broadcast(keys) if n <= BROADCAST else keys


def shard_of(light: DataFrame, rows: DataFrame, heavy: DataFrame, n_heavy: int) -> DataFrame:
    """The light nodes with the key of the topmost light node above them (their piece), found on their first member's path."""
    met = rows.join(few(heavy.select(*KEY), n_heavy), KEY, "left_semi").groupBy("conv").agg((F.count("*") + 1).alias("start"))
    starts = rows.join(met, "conv", "left").where(F.col("depth") == F.coalesce("start", F.lit(1)))
    starts = starts.select(F.col("conv").alias("conv_id"), F.xxhash64("depth", "hi", "lo").alias("piece"))
    return light.join(starts, "conv_id")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, weight: int | None = None, top: int = TOP) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv, turn, digest, bytes; see ``turn_rows``).

    ``convs`` (conv) names further conversations, which may have no turn; they end at the root. ``weight`` bounds the
    subtrees that are dealt whole to a shard; by default a quarter of an even share of all turns, at most ``SHARD``.
    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    and the digest (hi, lo) of each node, as a written table. ``node_turns`` brings role and text.
    """
    spark = turns.sparkSession
    rows = members(turns)
    named = rows.select("conv") if convs is None else rows.select("conv").unionByName(convs.where("conv is not null").select(F.col("conv").cast("long")))
    all_convs = named.groupBy("conv").agg(F.lit(1).alias("one"))
    none = all_convs.join(rows.where("depth = 1").select("conv"), "conv", "left_anti") if convs is not None else rows.limit(0).select("conv")
    ends = rows.where("rem = 1").select(*KEY, "conv").unionByName(none.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), "conv"))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = rows.groupBy(*KEY).agg(
        F.min("p_hi").alias("p_hi"), F.min("p_lo").alias("p_lo"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("rem").alias("weight"), F.min("bytes").alias("bytes")
    )
    zero = F.lit(0).cast("long")
    nodes = materialise(nodes.select(*KEY, "p_hi", "p_lo", "conv_id", "n_convs", "weight", zero.alias("leaves"), saved.alias("saved"), zero.alias("children")), "nodes")
    total = nodes.agg(F.count("*").alias("n"), F.sum(F.when(F.col("depth") == 1, F.col("weight"))).alias("w")).first()
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bound = weight or min(SHARD, max(1, (total["w"] or 0) // (4 * shuffles)))
    shards = max(shuffles, math.ceil((total["n"] or 0) / SHARD))

    root = all_convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*KEY, "p_hi", "p_lo")], "conv_id", "n_convs", zero.alias("weight"), zero.alias("leaves"), zero.alias("saved"), zero.alias("children"))
    heavy = materialise(nodes.where(F.col("weight") > bound).unionByName(root), "top")
    n_heavy = heavy.count()
    above = heavy.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"), F.col("conv_id").alias("parent_conv_id"))
    light = shard_of(nodes.where(F.col("weight") <= bound), rows, heavy, n_heavy).join(few(above, n_heavy), ["depth", "p_hi", "p_lo"], "left")
    dealt = light.withColumn("shard", F.pmod("piece", F.lit(shards))).drop("weight", "piece")
    below = materialise(dealt.groupBy("shard").applyInArrow(accumulate, DONE), "shards")

    add = below.where("is_root").groupBy((F.col("depth") - 1).alias("depth"), F.col("p_hi").alias("hi"), F.col("p_lo").alias("lo"))
    add = add.agg(F.sum("n_leaves").alias("a"), F.sum("saved_tokens").alias("b"), F.count("*").alias("c"))
    fed = heavy.drop("weight").join(add, KEY, "left")
    for to, of in (("leaves", "a"), ("saved", "b"), ("children", "c")):
        fed = fed.withColumn(to, F.col(to) + F.coalesce(of, F.lit(0))).drop(of)
    fed = fed.withColumn("parent_conv_id", F.lit(None).cast("long"))
    crown = fed.withColumn("shard", F.lit(0)).groupBy("shard").applyInArrow(accumulate, DONE).drop("is_root") if n_heavy <= top else doubled(fed)
    trie = below.drop("is_root").unionByName(crown).drop("p_hi", "p_lo").join(end_digests(ends), KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return materialise(trie.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))), "trie")


# ---------------------------------------------------------------- shared beginnings


def share_beginnings(turns: DataFrame, group: int, modulus: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first conversation of their group; h = crc32(id) % ``modulus``.

    Returns the turns (conv, turn, digest, bytes) of the rebuilt conversations and the ids of all. Only the first
    ``modulus - 1`` turns of a group's first conversation are joined, with at most ``group`` conversations on either side of 0.
    """
    numbered = ordered(turns).select("conv", "number", "digest", "bytes")
    convs = materialise(numbered.select("conv").distinct(), "convs")
    shared_turns = F.crc32(F.col("conv").cast("string")) % modulus
    own = numbered.where(F.col("number") >= shared_turns).select("conv", F.col("number").alias("turn"), "digest", "bytes")
    head = numbered.where((F.col("conv") % group == 0) & (F.col("number") < modulus - 1)).withColumnRenamed("conv", "base")
    joined = convs.withColumn("base", F.col("conv") - F.col("conv") % group).join(head, "base").where(F.col("number") < shared_turns)
    return own.unionByName(joined.select("conv", F.col("number").alias("turn"), "digest", "bytes")), convs


def node_turns(trie: DataFrame, df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes with role and text of their last turn, read from their smallest member in the conversations of the trie."""
    kept = turn_rows(df, conv_col, turn_col, role_col, text_col, texts=True)
    last = ordered(kept).select(F.col("conv").alias("conv_id"), (F.col("number") + 1).alias("depth"), "role", "text")
    return trie.join(last, ["conv_id", "depth"], "left")
