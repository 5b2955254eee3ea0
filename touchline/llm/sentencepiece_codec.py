"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A list of pieces is the encoding of a text exactly if every two neighbours are the encoding of their own
concatenation. So the encoder takes the longest piece at a place (an Aho-Corasick automaton of the reversed pieces
reads the text backwards), checks it against the piece before it by merging the two anew (remembered per pair), goes to the
next shorter piece where they do not fit, and steps back where none does. A bitfield keeps the places from which
the text cannot be finished, so no place is left twice. Only pieces that the merges can make take part.

No piece has a space sign behind another sign, and none has a line feed, so words (with the spaces before them)
and line feeds are encoded one by one; where a model has such pieces, whole texts are. Ids of short words are
remembered within a worker process, up to ``MEMO`` words, then forgotten and begun anew. A sign without a piece becomes the
pieces of its UTF-8 bytes.

Null and empty texts have the end id only (none without ``end``) and decode to an empty text. A null list of ids
decodes to an empty text. Texts of any length are encoded whole; the work grows with the length. Repeated rows are
encoded one by one; an empty table gives an empty result; other columns of the input are not read, so their names
cannot clash. Models with a text normaliser, user-defined or unused pieces are refused with ValueError.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import text_batches

SPACE = "▁"
MEMO, MEMO_LENGTH = 1_000_000, 48
# The kinds of pieces in a model file, and the sign of bytes that are no UTF-8.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
REPLACEMENT = "�"


def message(raw: bytes):
    """(field number, value) of every field of one protocol-buffer message; numbers or bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, raw[at : at + size]
        at += size


class Model:
    """Pieces, scores and flags of a model file."""

    def __init__(self, path: str):
        pieces, trainer, normaliser = [], {}, {}
        with open(path, "rb") as f:
            raw = f.read()
        for field, value in message(raw):
            if field == 1:
                entry = dict(message(value))
                pieces.append((entry[1].decode(), struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0], entry.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(message(value))
            elif field == 3:
                normaliser = dict(message(value))
        if trainer.get(3, 1) != 2 or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only merge-type models with spaces before words and without a text normaliser are read")
        if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not read")
        self.scores = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.end = trainer.get(42, 2)
        self.prefix = bool(normaliser.get(3, 1))
        unk = trainer.get(44, " ⁇ ".encode()).decode()
        self.surface = [{CONTROL: "", UNKNOWN: unk}.get(kind, p.replace(SPACE, " ")) for p, _, kind in pieces]
        self.raw = {i: b for b, i in self.bytes.items()}
        self.controls = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.atoms = [p for p in self.ids if remerge(p, self.scores) == [p]]
        self.by_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.seen: Words | None = None

    def words(self) -> Words:
        """The words seen so far; a broadcast model keeps them from task to task of a worker process."""
        if self.seen is None:
            self.seen = Words(self)
        return self.seen


def remerge(text: str, scores: dict[str, float]) -> list[str]:
    """The merges themselves: always the adjacent pair whose piece has the best score, leftmost first."""
    parts = list(text)
    n = len(parts)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-scores[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in scores]
    heapq.heapify(heap)
    while heap:
        _, i, made = heapq.heappop(heap)
        j = ahead[i]
        if not parts[i] or j >= n or parts[i] + parts[j] != made:
            continue
        parts[i], parts[j] = made, ""
        k = ahead[i] = ahead[j]
        if k < n:
            behind[k] = i
            if (p := made + parts[k]) in scores:
                heapq.heappush(heap, (-scores[p], i, p))
        if (h := behind[i]) >= 0 and (p := parts[h] + made) in scores:
            heapq.heappush(heap, (-scores[p], h, p))
    return [p for p in parts if p]


class Pairs(dict):
    """By piece the pieces that have been tried behind it, and whether they may stand there; found by merging the two anew."""

    def __init__(self, scores):
        super().__init__()
        self.scores, self.n = scores, 0

    def __missing__(self, piece: str) -> dict[str, bool]:
        self[piece] = after = {}
        return after

    def fits(self, before: str, piece: str) -> bool:
        after = self[before]
        if (known := after.get(piece)) is None:
            if self.n >= MEMO:
                self.clear()
                self.n, after = 0, self[before]
            self.n += 1
            known = after[piece] = remerge(before + piece, self.scores) == [before, piece]
        return known


class Longest:
    """Aho-Corasick automaton of the reversed pieces: read backwards, a text gives the longest piece from every place.

    A state maps signs to next states; under ``PIECE`` it has the longest piece that ends here, under ``FALL`` the state
    of its longest proper suffix. Steps by way of suffixes are added when they are first taken, up to ``MEMO`` of them.
    """

    PIECE, FALL = "piece", "fall"  # keys longer than a sign

    def __init__(self, pieces):
        self.root: dict = {}
        for piece in pieces:
            state = self.root
            for sign in reversed(piece):
                state = state.setdefault(sign, {})
            state[self.PIECE] = piece
        wave: list[tuple[dict, dict | None]] = [(self.root, None)]
        while wave:
            deeper = []
            for state, fall in wave:
                children = [(sign, child) for sign, child in state.items() if len(sign) == 1]
                for sign, child in children:
                    low = fall
                    while low is not None and sign not in low:
                        low = low[self.FALL]
                    deeper.append((child, self.root if low is None else low[sign]))
                state[self.FALL] = fall
                state.setdefault(self.PIECE, fall and fall[self.PIECE])
            wave = deeper
        self.added = 0

    def step(self, state: dict, sign: str) -> dict:
        low = state
        while low is not None and sign not in low:
            low = low[self.FALL]
        to = self.root if low is None else low[sign]
        if self.added < MEMO:
            state[sign] = to
            self.added += 1
        return to

    def __call__(self, text: str) -> list[str]:
        """The longest piece that starts at each place; a sign without a piece stands for itself."""
        state, out = self.root, []
        for sign in reversed(text):
            state = state.get(sign) or self.step(state, sign)
            out.append(state["piece"] or sign)
        out.reverse()
        return out


class Words(dict):
    """Ids by word."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.pairs = model, Pairs(model.scores)
        self.known = set(model.atoms)
        self.longest = Longest(model.atoms)
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.known), None) for p in self.known}

    def split(self, text: str) -> list[str]:
        """Pieces of a text by longest matches, pair checks and steps back."""
        if text in self.known:
            return [text]
        n, longest, pairs, shorter = len(text), self.longest(text), self.pairs, self.shorter
        after: dict[str, bool] = {}  # known neighbours of the piece before
        failed: bytearray | None = None  # a bit per place, made when the first place fails
        done: list[str] = []
        before, at, piece = None, 0, longest[0] if n else None
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fits = after.get(piece)
                    if fits or before is None or (fits is None and pairs.fits(before, piece)):
                        break
                piece = shorter.get(piece)
            if piece is not None:
                done.append(piece)
                before, after, at = piece, pairs[piece], end
                piece = longest[at] if at < n else None
                continue
            if failed is None:
                failed = bytearray((n >> 3) + 1)
            failed[at >> 3] |= 1 << (at & 7)
            piece = done.pop()
            at -= len(piece)
            before = done[-1] if done else None
            after = pairs[before] if done else {}
        return done

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids, raw, unknown, known = [], self.model.bytes, self.model.unknown, self.model.ids
        for piece in self.split(word):
            if (number := known.get(piece)) is not None:
                ids.append(number)
            elif raw:
                ids.extend(raw[b] for b in piece.encode())
            else:
                ids.append(unknown)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[word] = tuple(ids)
        return tuple(ids)


CUT = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def encode_text(text: str | None, words: Words, end: bool = True) -> list[int]:
    """Ids of one text."""
    ids: list[int] = []
    if text:
        text = (SPACE if words.model.prefix else "") + text.replace(" ", SPACE)
        for word in CUT.findall(text) if words.model.by_words else [text]:
            ids += words[word]
    if end:
        ids.append(words.model.end)
    return ids


def decode_bytes(raw: bytes) -> str:
    """UTF-8, with a replacement sign for each byte that belongs to no code point."""
    out, at = [], 0
    while True:
        try:
            out.append(raw[at:].decode())
            return "".join(out)
        except UnicodeDecodeError as bad:
            out.append(raw[at : at + bad.start].decode() + REPLACEMENT)
            at += bad.start + 1


def decode_ids(ids, model: Model) -> str:
    """Text of a list of ids: neighbouring bytes joined, the space that was put before the text dropped, controls empty."""
    surface, raw, controls = model.surface, model.raw, model.controls
    ids = [i for i in ids if i is not None] if ids is not None else []
    first = next((i for i in ids if i not in controls), None)
    if raw and not raw.keys().isdisjoint(ids):
        out, run = [], bytearray()
        for i in ids:
            if i in raw:
                run.append(raw[i])
                continue
            if run:
                out.append(decode_bytes(bytes(run)))
                run.clear()
            out.append(surface[i])
        if run:
            out.append(decode_bytes(bytes(run)))
        text = "".join(out)
    else:
        text = "".join(map(surface.__getitem__, ids))
    cut = model.prefix and first is not None and first not in raw and first != model.unknown and text.startswith(" ")
    return text[1:] if cut else text


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def _arrow(df: DataFrame, id_col: str, value, fn, columns: str) -> DataFrame:
    text_batches(df.sparkSession)
    two = df.select(df[id_col].alias("id"), value.alias("value"))
    return two.mapInArrow(fn, f"id {two.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model_path: str, end: bool = True, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``ids``; with ``decoded`` also the text that the ids decode to."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        words = model.value.words()
        for batch in batches:
            ids = [encode_text(t, words, end) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if decoded:
                columns.append(pa.array([decode_ids(x, words.model) for x in ids], pa.string()))
            yield pa.record_batch(columns, names=["id", "ids", "decoded"][: len(columns)])

    return _arrow(docs, id_col, docs[text_col].cast("string"), run, "ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per list of ids: id and ``text``; ids outside the model raise IndexError."""
    model = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([decode_ids(x, model.value) for x in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return _arrow(encoded, id_col, encoded[ids_col].cast("array<int>"), run, "text string")
