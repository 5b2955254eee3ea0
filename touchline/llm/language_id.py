"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of labelled texts: at most ``TEXTS``
texts with a letter, chosen by hash, of longer ones ``TEXT_CHARS`` characters from the first letter on, together at
most ``CHARS`` symbols (shared out when there are many languages, and evenly among the texts when they hold more). The
most frequent letters are one symbol each, any other is four symbols that spell its code point, so no two letters of
any script run into each other. A text is parsed greedily into the longest pieces that the automaton
knows; phrases times the bits to name a place in the sample, per character, estimate the cross entropy, and
the least one wins (ties: first in order). Whole texts are parsed, in segments of ``SEGMENT`` characters that run
side by side; a phrase ends at a segment's end. The tables have a fixed size and go to the tasks once.

Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing is labelled;
repeated rows are scored one by one; an empty table gives an empty result; other columns are not read. A
null id is neither held out nor learned from.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import text_batches

TEXTS, TEXT_CHARS = 24, 20_000
CHARS, ALL_CHARS = 20_000, 400_000
SEGMENT = 256
OWN, CLASSES = 64, 96  # classes 1..63 are frequent letters, the rest are the digits that spell all others
DIGITS = np.array([15, 10, 5, 0])  # 20 bits of a code point, 5 a digit
LETTER = r"\p{L}"
BATCH_CHARS = 1 << 19


def fold_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Labelled texts by language, in an order fixed by hash. Rows are picked first, among those with a letter."""
    key = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    key = key.where(F.col("lang").isNotNull() & (fold_of("id") != 0) & F.col("text").rlike(LETTER)).withColumn("h", F.xxhash64("id")).withColumn("bucket", F.pmod("h", F.lit(TEXTS)))
    picked = key.groupBy("lang", "bucket").agg(F.min("h").alias("h"))  # a few rows per language
    texts = key.join(F.broadcast(picked.select("lang", "h")), ["lang", "h"])
    stretch = F.regexp_extract("text", f"(?s){LETTER}.{{0,{TEXT_CHARS - 1}}}", 0)
    texts = texts.withColumn("text", F.when(F.length("text") <= TEXT_CHARS, F.col("text")).otherwise(stretch))
    rows = texts.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def class_table(texts: dict[str, list[str]]) -> np.ndarray:
    """Class of each code point: 0 for what is not a letter, ``OWN`` for a letter that is spelled."""
    seen = Counter(c for own in texts.values() for t in own for c in t.lower() if c.isalpha())
    table = np.array([OWN if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint8)
    for n, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: OWN - 1], 1):
        table[ord(c)] = n
    return table


def classes(text: str, table: np.ndarray) -> np.ndarray:
    """Classes of the lower-cased text, with single separators between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = table[points]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    codes, points = codes[keep], points[keep]
    spelled = codes == OWN
    if not spelled.any():
        return codes
    size = np.where(spelled, len(DIGITS), 1)
    out = np.repeat(codes, size)
    out[np.repeat(spelled, size)] = (OWN + (points[spelled][:, None] >> DIGITS & 31)).ravel()
    return out


def share(sizes: list[int], room: int) -> list[int]:
    """Parts of the sizes that fit the room together: small ones whole, the others cut to one length."""
    out, left = [0] * len(sizes), room
    for n, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], left // (len(sizes) - n))
        left -= out[i]
    return out


def suffix_automaton(codes: np.ndarray) -> np.ndarray:
    """Dense transitions of the suffix automaton; state 0 is the root and 0 also means no transition."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = cur
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    dense = np.zeros((len(steps), CLASSES), np.uint16 if len(steps) < 1 << 16 else np.uint32)
    for s, own in enumerate(steps):
        for c, t in own.items():
            dense[s, c] = t
    return dense


def build(texts: dict[str, list[str]]) -> dict:
    """Automata of all languages in one flat table, with offsets and bits per phrase."""
    table = class_table(texts)
    room = min(CHARS, ALL_CHARS // max(1, len(texts)))
    langs, parts, bits = [], [], []
    for lang, own in sorted(texts.items()):
        coded = [classes(t + " ", table) for t in own]
        codes = np.concatenate([c[:n] for c, n in zip(coded, share([len(c) for c in coded], room), strict=True)])
        if len(codes):
            langs.append(lang)
            parts.append(suffix_automaton(codes))
            bits.append(math.log2(len(codes) + 1))
    sizes = [p.size for p in parts]
    return {
        "langs": langs, "classes": table, "flat": np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0, np.uint16),
        "offsets": np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[: len(parts), None] if parts else None, "bits": np.array(bits),
    }


def phrases(coded: list[np.ndarray], model: dict) -> np.ndarray:
    """Number of phrases per language (rows) and text (columns)."""
    lengths = np.array([len(c) for c in coded], np.int64)
    n_seg = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(coded)), n_seg)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    size = np.minimum(SEGMENT, lengths[owner] - within * SEGMENT)
    order = np.argsort(-size, kind="stable")
    owner, size = owner[order], size[order]
    begin = (np.cumsum(lengths) - lengths)[owner] + within[order] * SEGMENT
    flat_text = np.concatenate([*coded, np.zeros(SEGMENT, np.uint8)])
    active = np.searchsorted(-size, -np.arange(SEGMENT), "left")  # segments longer than t
    flat, offsets = model["flat"], model["offsets"]
    state = np.zeros((len(offsets), len(owner)), np.int64)
    count = np.zeros(state.shape, np.int32)
    for t in range(int(size[0]) if len(size) else 0):
        a = active[t]
        c = flat_text[begin[:a] + t].astype(np.int64)
        old = state[:, :a]
        new = flat[old * CLASSES + c + offsets].astype(np.int64)
        fresh = (old == 0) | (new == 0)
        count[:, :a] += fresh
        state[:, :a] = np.where(new == 0, flat[c + offsets], new)
    return np.stack([np.bincount(owner, weights=row, minlength=len(coded)) for row in count])


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every row as a struct ``doc`` with lang_pred, score (1 - best / second best cross entropy), bits and symbols.

    ``bits`` is the best cross entropy per symbol, null where nothing was compared; ``symbols`` counts what the text
    is parsed as, 0 for a text without a letter.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(build(sample(docs, id_col, text_col, lang_col)))

    def decide(texts: list[str | None], model: dict) -> list[tuple[str, float, float | None, int]]:
        coded = [classes(t or "", model["classes"]) for t in texts]
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if not model["langs"]:
            return [("und", 0.0, None, len(c) if ok else 0) for c, ok in zip(coded, lettered, strict=True)]
        chars = np.maximum(1, [len(c) for c in coded])
        cost = phrases(coded, model) * model["bits"][:, None] / chars
        ranked = np.sort(cost, axis=0)
        best, pick = ranked[0], np.argmin(cost, axis=0)
        margin = 1.0 - best / np.maximum(ranked[1], 1e-12) if len(cost) > 1 else np.ones(len(texts))
        scored = zip(lettered, pick, margin, best, coded, strict=True)
        return [(model["langs"][p], round(float(m), 6), round(float(b), 6), len(c)) if ok else ("und", 0.0, None, 0) for ok, p, m, b, c in scored]

    def predict(batches):
        model = shared.value
        for batch in batches:
            texts, got, begin = batch.column(0).field(0).to_pylist(), [], 0
            while begin < len(texts):
                end, room = begin, BATCH_CHARS
                while end < len(texts) and (end == begin or room > 0):
                    room -= len(texts[end] or "")
                    end += 1
                got += decide(texts[begin:end], model)
                begin = end
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.record_batch([batch.column(0), *columns], names=["row", "lang_pred", "score", "bits", "symbols"])

    packed = docs.select(F.struct(F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("rest")).alias("row"))
    out = packed.mapInArrow(predict, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double, bits double, symbols long")
    fields = [(F.col("row.text") if c == text_col else F.col("row.rest")[c]).alias(c) for c in docs.columns]
    return out.select(F.struct(*fields).alias("doc"), "lang_pred", "score", "bits", "symbols")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    out = with_language(docs.select(id_col, text_col, lang_col), id_col, text_col, lang_col).select(F.col("doc")[id_col].alias(id_col), "lang_pred", "score")
    return out.select(id_col, F.coalesce(fold_of(id_col) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
