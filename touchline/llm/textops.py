"""Vector helpers over batches of texts: whole columns are handled as one byte buffer with offsets.

A batch is cut into runs of whole documents of about ``SLICE`` bytes, so memory follows the longest
document and not the batch. Hashes are polynomials modulo 2^64 over a table of random odd numbers, taken
from running sums, so the hash of any byte range costs two lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE = 1 << 18
TEXT_ROWS = 1_000
U64 = np.uint64
NOT_SPACE = bytes(b not in (32, 9, 10, 11, 12, 13) for b in range(256))


def text_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of at most ``TEXT_ROWS`` rows.

    Spark's default of 10,000 rows suits numbers; of whole texts it makes tens of megabytes, several times over
    on either side. A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(31))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(29))


class Poly:
    """Range hashes of byte buffers; equal byte ranges have equal hashes wherever they stand."""

    def __init__(self, seed: int, fold=None):
        rng = np.random.default_rng(seed)
        draw = rng.integers(0, 1 << 62, 256, dtype=np.uint64)
        self.table = draw * U64(2) + U64(1)
        if fold is not None:
            self.table = self.table[fold]
        self.base = int(rng.integers(1 << 61, 1 << 62, dtype=np.uint64)) * 8 + 5
        self.base %= 1 << 64
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, self.base, U64)]))
                self.down = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, self.inverse, U64)]))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums with a leading zero."""
        self._powers(max(len(data) + 1, SLICE + 1))
        out = np.zeros(len(data) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start, end) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all windows of ``k`` bytes, by start."""
        n = len(sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            return mix((sums[k:] - sums[:n]) * self.down[:n])


def lower_ascii() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    fold = np.arange(256)
    fold[65:91] += 32
    return fold


def in_words(data: np.ndarray) -> np.ndarray:
    """True for all bytes but space and the bytes 9 to 13."""
    return np.frombuffer(data.tobytes().translate(NOT_SPACE), bool)


def slices(column: pa.Array):
    """Yield (first row, byte buffer, offsets) for runs of whole texts; a null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal true runs that do not cross the offsets."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(mask), bool)
    before[0], before[1:] = False, mask[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    before[inner] = False
    after = np.empty(len(mask), bool)
    after[-1], after[:-1] = False, mask[1:]
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of each start."""
    return np.searchsorted(offsets, starts, "right") - 1


def chain(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words of one text and the index of the first word of each."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * U64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(out[at]), at
