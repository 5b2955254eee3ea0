"""Plain-Python answers for the trie and the clustering."""

import hashlib
import math
import zlib
from collections import defaultdict


def rebuilt(rows):
    """rows: (conv_id, turn, role, text). Sequences of (role, text) by conversation, beginnings shared."""
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by_conv[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by_conv.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def trie(seqs):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in nodes.items()
    )


def clusters(rows, k=40, rounds=5, dims=64, scale=256, salt="2:"):
    """rows: (vec_id, list). (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, g in groups.items():
            cents[j] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = defaultdict(int)
    for _, d, j in found:
        per[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, per[j], sum(per.values()), name[j]) for i, d, j in found), key=repr)
