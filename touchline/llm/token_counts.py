"""Token counts by byte-pair merging with a heap over a linked list.

The ranks come from a vocabulary file whose path is a parameter; they have a fixed size and go to the
tasks once. Each text is cut by the pre-tokenizer's pattern; every piece is merged by popping the lowest-
ranked adjacent pair, leftmost first, and its count is its number of bytes minus its merges. Counts of
short pieces are remembered within a task, up to ``MEMO`` pieces, then forgotten and begun anew.

Null and empty texts have no bytes and no tokens; repeated rows are counted one by one; an empty table
gives an empty result; other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textops import text_batches

# The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 600_000
MEMO_LENGTH = 48
COLUMNS = "n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_ranks(path: str) -> tuple[list[dict[int, int]], list[int], list[str]]:
    """By left symbol the rank of each right symbol, the symbol that each rank makes, and the special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids: dict[str, int] = byte_letters()
    pairs: list[tuple[int, int]] = []
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append((ids[left], ids[right]))
        ids.setdefault(left + right, 256 + rank)
    rights: list[dict[int, int]] = [{} for _ in range(256 + len(pairs))]
    made = [ids[x] for x in ("".join(p) if not isinstance(p, str) else p.replace(" ", "") for p in spec["model"]["merges"])]
    for rank, (left, right) in enumerate(pairs):
        rights[left][right] = rank
    return rights, made, [t["content"] for t in spec["added_tokens"] if t["special"]]


def count_piece(piece: bytes, rights: list[dict[int, int]], made: list[int]) -> int:
    """Symbols left when no adjacent pair has a rank. A heap entry is rank * 2^32 + position of its left symbol."""
    n = len(piece)
    if n < 2:
        return n
    symbol = list(piece)
    heap = []
    for i in range(n - 1):
        if (rank := rights[symbol[i]].get(symbol[i + 1])) is not None:
            heap.append((rank << 32) + i)
    if not heap:
        return n
    heapq.heapify(heap)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
    left, pop, push = n, heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        j = ahead[i]
        if j >= n or symbol[i] < 0 or rights[symbol[i]].get(symbol[j]) != top >> 32:
            continue  # one of the two has been merged since
        symbol[i] = merged = made[top >> 32]
        symbol[j] = -1
        k = ahead[i] = ahead[j]
        left -= 1
        if k < n:
            behind[k] = i
            if (rank := rights[merged].get(symbol[k])) is not None:
                push(heap, (rank << 32) + i)
        if (h := behind[i]) >= 0 and (rank := rights[symbol[h]].get(merged)) is not None:
            push(heap, (rank << 32) + h)
    return left


class Memo(dict):
    """Counts by piece; computed when first asked for."""

    def __init__(self, rights, made):
        super().__init__()
        self.rights, self.made = rights, made

    def __missing__(self, piece: str) -> int:
        n = count_piece(piece.encode("utf-8", "surrogatepass"), self.rights, self.made)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(load_ranks(tokenizer_path))

    def count(batches):
        rights, made, special = shared.value
        memo, pieces = Memo(rights, made), regex.compile(PATTERN).findall
        cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                parts = cut.split(text) if cut else [text]
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(len(parts) - 1 + sum(sum(map(memo.__getitem__, pieces(part))) for part in parts))
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([x > limit for x in n_tokens], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    two = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = two.mapInArrow(count, f"id {two.schema['id'].dataType.simpleString()}, {COLUMNS}")
    return out.withColumnRenamed("id", id_col)
