"""Sorted runs of strings: front coding, and merging with a loser tree that knows common prefixes.

A run is a sorted list of distinct strings, each with the length of the prefix it shares with the one before
it (lcp) and its owners. Front coding keeps only what follows that prefix.
"""

from __future__ import annotations

import zlib

import numpy as np


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes], owners: list[list[tuple[int, int]]]) -> bytes:
    """A compressed run; an owner is a text number and the start of the string's first window."""
    lcp, last = [], b""
    for s in strings:
        lcp.append(common_prefix(last, s, 0))
        last = s
    flat = np.array([x for own in owners for x in own], np.int64).reshape(-1, 2)
    head = np.array([len(strings), len(flat)], np.int64).tobytes()
    parts = [
        np.array(lcp, np.uint16), np.array([len(s) for s in strings], np.uint16), np.array([len(o) for o in owners], np.int32),
        flat[:, 0].copy(), flat[:, 1].copy(),
    ]
    return zlib.compress(head + b"".join(p.tobytes() for p in parts) + b"".join(s[h:] for s, h in zip(strings, lcp, strict=True)), 1)


def read_run(blob: bytes):
    """Yield (string, lcp with the one before, owners) of a front-coded run."""
    raw = zlib.decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16
    fields = []
    for kind, size in ((np.uint16, n), (np.uint16, n), (np.int32, n), (np.int64, m), (np.int64, m)):
        fields.append(np.frombuffer(raw, kind, size, at).tolist())
        at += np.dtype(kind).itemsize * size
    lcps, lengths, counts, texts, starts = fields
    last, o = b"", 0
    for h, length, c in zip(lcps, lengths, counts, strict=True):
        last = last[:h] + raw[at : at + length - h]
        at += length - h
        yield last, h, list(zip(texts[o : o + c], starts[o : o + c], strict=True))
        o += c


class LoserTree:
    """Merges sorted runs; every candidate carries its lcp with the last string given out.

    Of two candidates the one with the longer lcp is smaller and nothing is compared; only equal lcps need a
    comparison, and it begins behind the known prefix.
    """

    def __init__(self, runs):
        self.runs = list(runs)
        self.size = 1
        while self.size < max(1, len(self.runs)):
            self.size *= 2
        self.string: list[bytes | None] = [None] * self.size
        self.lcp = [0] * self.size
        self.owners: list = [None] * self.size
        for i in range(len(self.runs)):
            self._advance(i)
        self.loser = [0] * self.size
        self.winner = self._play(1)

    def _advance(self, i: int) -> None:
        self.string[i], self.lcp[i], self.owners[i] = next(self.runs[i], (None, 0, None))

    def _beats(self, a: int, b: int) -> bool:
        """Whether candidate ``a`` goes before ``b``; the later one's lcp becomes that with the earlier one."""
        x, y = self.string[a], self.string[b]
        if y is None:
            return True
        if x is None:
            return False
        h, g = self.lcp[a], self.lcp[b]
        if h != g:
            return h > g
        common = common_prefix(x, y, h)
        first = x[common : common + 1] <= y[common : common + 1]  # a prefix goes first
        self.lcp[b if first else a] = common
        return first

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.loser[node] = lost
        return won

    def __iter__(self):
        """Yield (string, lcp with the string given out before, owners) in order."""
        while self.string[self.winner] is not None:
            w = self.winner
            yield self.string[w], self.lcp[w], self.owners[w]
            self._advance(w)
            node = (w + self.size) // 2
            while node:
                other = self.loser[node]
                if not self._beats(w, other):
                    self.loser[node], w = w, other
                node //= 2
            self.winner = w
