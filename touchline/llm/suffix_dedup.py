"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers.

Sorting all suffixes would exchange a few hundred bytes for every byte of the input. So suffixes are sparse:
each window of ``LENGTH`` bytes points to the ``K`` bytes in it with the least hash, its anchor, and equal
windows have equal anchors at one offset. All windows of an anchor make one string: what follows the anchor,
then what stands before it, reversed, as far as these windows reach.

1. Anchors whose ``K`` bytes stand in one place only cannot be repeated; they are counted out by hash.
2. The other strings are sorted into front-coded runs, cut at sampled splitters, exchanged, and merged by
   loser trees that never compare a known prefix again. Equal strings: all their windows are repeated.
3. Neighbours that share the anchor but differ are compared window by window at equal offsets. Groups at
   the border of two ranges are settled by one small exchange of window fingerprints (128 bits).
4. Texts with repeated windows meet their spans, which are united and cut out.

Copies collapse in their run, so a large group of copies sends one string per run, and ranges split any
common passage. Whole-text copies collapse to one text; all of them are removed if they have ``LENGTH`` bytes.

Null text counts as empty; texts shorter than ``LENGTH`` bytes keep all; repeated rows are copies of each
other, whatever their id; an empty table gives an empty result; very long texts are read in overlapping
stretches; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise

from .columns import text_rows
from .suffix_merge import LoserTree, front_code, read_run
from .textops import Poly, slices, text_batches

LENGTH, K = 200, 32
SPAN = LENGTH - K + 1  # anchor positions of a window
STRETCH = 1 << 22
RUN_BYTES = 48 << 20
PER_RANGE = 20_000
SAMPLE_TEXTS = 2_000
SEEDS = (1, 101, 102)


def least_in_windows(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, from running minima of blocks."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, poly: Poly):
    """Text, first window, last window, anchor and anchor hash; windows do not cross texts."""
    out = []
    for begin in range(0, max(1, len(data) - LENGTH + 1), STRETCH):
        part = data[begin : begin + STRETCH + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        hashes = poly.windows(poly.sums(part), K)
        order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        at = (least_in_windows(order, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(begin, begin + len(at))
        text = np.searchsorted(offsets, start, "right") - 1
        valid = start + LENGTH <= offsets[text + 1]
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(valid & (change | ~np.concatenate([[False], valid[:-1]])))
        if not len(first):
            continue
        ends = np.flatnonzero(valid & np.concatenate([change[1:] | ~valid[1:], [True]]))
        out.append((text[first], first + begin, ends + begin, at[first] + begin, hashes[at[first]]))
    if not out:
        return tuple(np.zeros(0, np.uint64 if i == 4 else np.int64) for i in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchor_rows(texts: DataFrame) -> DataFrame:
    """Anchor hash and text key of every anchor, once for each text of a task."""

    def emit(batches):
        poly, seen = Poly(SEEDS[0]), set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            fresh = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            column = batch.column(1).take(pa.array(fresh, pa.int64()))
            for row, data, offsets in slices(column):
                text, _, _, _, hashes = anchors(data, offsets, poly)
                t = pa.array([keys[fresh[row + i]] for i in range(len(offsets) - 1)], pa.binary()).take(pa.array(text))
                yield pa.record_batch([pa.array(hashes.view(np.int64)), t], names=["h", "t"])

    return texts.mapInArrow(emit, "h long, t binary")


def sparse_suffixes(column: pa.Array, wanted: list[list[int]], numbers: list[int], poly: Poly):
    """Yield (string, text number, first window) for the wanted anchors of a column of texts."""
    for row, data, offsets in slices(column):
        text, first, last, at, hashes = anchors(data, offsets, poly)
        keep = np.zeros(len(text), bool)
        known = np.unique(np.array([h for own in wanted[row : row + len(offsets) - 1] for h in own], np.int64).view(np.uint64))
        if len(known):
            keep = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
        raw = data.tobytes()
        for d, i, j, a in zip(text[keep].tolist(), first[keep].tolist(), last[keep].tolist(), at[keep].tolist(), strict=True):
            yield raw[a : j + LENGTH] + raw[i:a][::-1] + (j + LENGTH - a).to_bytes(2, "big"), numbers[row + d], i - int(offsets[d])


def run_rows(texts: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Range number and front-coded part of a sorted run."""
    shared = texts.sparkSession.sparkContext.broadcast(splitters)

    def emit(batches):
        import bisect

        cuts, poly, held, room = shared.value, Poly(SEEDS[0]), {}, 0

        def flush():
            ordered = sorted(held)
            places = [0, *[bisect.bisect_left(ordered, c) for c in cuts], len(ordered)]
            full = [r for r in range(len(places) - 1) if places[r] < places[r + 1]]
            blobs = [front_code(ordered[places[r] : places[r + 1]], [held[s] for s in ordered[places[r] : places[r + 1]]]) for r in full]
            return pa.record_batch([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])

        for batch in batches:
            numbers, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for string, number, first in sparse_suffixes(batch.column(1), wanted, numbers, poly):
                if (own := held.get(string)) is None:
                    held[string] = [(number, first)]
                    room += len(string) + 150
                else:
                    own.append((number, first))
                    room += 100
                if room > RUN_BYTES:
                    yield flush()
                    held, room = {}, 0
        if held:
            yield flush()

    return texts.select("own", "text", "wanted").mapInArrow(emit, "part int, run binary")


class Windows:
    """Window fingerprints of strings that share anchors: rows are strings, columns are offsets of the anchor."""

    def __init__(self):
        self.polys = [Poly(s) for s in SEEDS[1:]]
        for p in self.polys:
            p._powers(2 * LENGTH)

    def __call__(self, strings: list[bytes]):
        """Two fingerprints and validity by string and offset (0 to SPAN - 1), and the offset of the first window."""
        n, before = len(strings), SPAN - 1
        table = np.zeros((n, before + LENGTH), np.uint8)
        right = np.array([int.from_bytes(s[-2:], "big") for s in strings])
        left = np.array([len(s) - 2 for s in strings]) - right
        for i, s in enumerate(strings):
            r = int(right[i])
            table[i, before : before + r] = np.frombuffer(s, np.uint8, r)
            if left[i]:
                table[i, before - int(left[i]) : before] = np.frombuffer(s, np.uint8, int(left[i]), r)[::-1]
        offset = np.arange(SPAN)
        valid = (offset[None, :] >= LENGTH - right[:, None]) & (offset[None, :] <= left[:, None])
        lanes = []
        for p in self.polys:
            sums = np.zeros((n, before + LENGTH + 1), np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(p.table[table] * p.up[: before + LENGTH], axis=1, out=sums[:, 1:])
                begin = before - offset
                lanes.append((sums[:, begin + LENGTH] - sums[:, begin]) * p.down[begin])
        return lanes[0], lanes[1], valid, left


def repeated(h1: np.ndarray, h2: np.ndarray, valid: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Windows that another string has too, or all of them for strings that stand in several places."""
    out = valid & sure[:, None]
    for d in np.flatnonzero(valid.sum(axis=0) > 1):
        rows = np.flatnonzero(valid[:, d])
        order = rows[np.lexsort((h2[rows, d], h1[rows, d]))]
        same = (h1[order[1:], d] == h1[order[:-1], d]) & (h2[order[1:], d] == h2[order[:-1], d])
        out[order[1:][same], d] = True
        out[order[:-1][same], d] = True
    return out


def merged_rows(runs: DataFrame) -> DataFrame:
    """Repeated spans (own, begin, end), and fingerprints of windows at the borders of ranges (h1, h2, own, begin)."""

    def emit(batches):
        windows = Windows()
        spans: list[tuple[int, int, int]] = []
        border: list[tuple[int, int, int | None, int | None]] = []

        def out():
            both = [(o, b, e, None, None) for o, b, e in spans] + [(o, b, None, x, y) for x, y, o, b in border]
            spans.clear()
            border.clear()
            return pa.record_batch([pa.array([r[i] for r in both], pa.int64()) for i in range(5)], names=["own", "begin", "end", "h1", "h2"])

        def settle(strings, owned, counts, at_border):
            """Compare the windows of neighbours; ``at_border`` marks strings whose group may go on in another range."""
            h1, h2, valid, left = windows(strings)
            known = repeated(h1, h2, valid, np.array(counts) > 1)
            edge = np.zeros((len(strings), 1), bool)
            rise = np.diff(np.concatenate([edge, known, edge], axis=1).astype(np.int8), axis=1)
            row, low = np.nonzero(rise == 1)
            _, high = np.nonzero(rise == -1)
            for i, lo, hi in zip(row.tolist(), low.tolist(), (high - 1).tolist(), strict=True):
                for own, first in owned[i]:
                    anchor = first + int(left[i])
                    spans.append((own, anchor - hi, anchor - lo + LENGTH))
            marked = np.flatnonzero(at_border)
            for i in marked.tolist():
                own, first = owned[i][0]
                for d in np.flatnonzero(valid[i]).tolist():
                    unknown = not known[i, d]
                    border.append((int(h1[i, d].view(np.int64)), int(h2[i, d].view(np.int64)), own if unknown else None, first + int(left[i]) - d if unknown else None))

        def one_range(blobs):
            strings, owned, counts, marks = [], [], [], []
            group, seen_groups = [], 0

            def close(last):
                nonlocal group, seen_groups
                at_border = seen_groups == 0 or last
                if len(group) == 1 and not at_border:
                    string, own = group[0]
                    if len(own) > 1:  # equal strings in several places: all their windows are repeated
                        spans.extend((o, first, first + len(string) - 2) for o, first in own)
                else:
                    for string, own in group:
                        strings.append(string)
                        owned.append(own)
                        counts.append(len(own))
                        marks.append(at_border)
                group = []
                seen_groups += 1

            previous = None
            for string, lcp, own in LoserTree(read_run(b) for b in blobs):
                if group and lcp == len(string) == len(previous):
                    group[-1][1].extend(own)
                    continue
                if group and lcp < K:
                    close(False)
                    if len(strings) >= 2048:
                        settle(strings, owned, counts, marks)
                        strings, owned, counts, marks = [], [], [], []
                group.append((string, own))
                previous = string
            if group:
                close(True)
            if strings:
                settle(strings, owned, counts, marks)

        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and blobs:
                    one_range(blobs)
                    yield out()
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            one_range(blobs)
            yield out()

    ranged = runs.repartition("part").sortWithinPartitions("part")
    return ranged.mapInArrow(emit, "own long, begin long, end long, h1 long, h2 long")


def splitters_of(texts: DataFrame, n_texts: int, n_ranges: int) -> list[bytes]:
    """Strings that cut the sorted order into about equal ranges, from a bounded sample of texts (it only balances)."""
    share = max(1, n_texts // SAMPLE_TEXTS)

    def emit(batches):
        poly = Poly(SEEDS[0])
        for batch in batches:
            some = [s for i, (s, *_) in enumerate(sparse_suffixes(batch.column(1), batch.column(2).to_pylist(), batch.column(0).to_pylist(), poly)) if i % 16 == 0]
            yield pa.record_batch([pa.array(some, pa.binary())], names=["s"])

    sampled = texts.where(F.pmod(F.xxhash64("own"), F.lit(share)) == 0).select("own", "text", "wanted").mapInArrow(emit, "s binary")
    found = sorted({bytes(r["s"]) for r in sampled.orderBy(F.xxhash64("s")).limit(50_000).collect()})
    return sorted({found[len(found) * i // n_ranges] for i in range(1, n_ranges)}) if found else []


def cut_out(rows: DataFrame) -> DataFrame:
    """Unite the spans of every text and digest what is left."""

    def emit(batches):
        for batch in batches:
            removed, spans, digests = [], [], []
            for text, begin, end in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw, kept, at, united = text.encode("utf-8"), hashlib.sha256(), 0, []
                for b, e in sorted(zip(begin, end, strict=True)):
                    if united and b <= united[-1][1]:
                        united[-1][1] = max(united[-1][1], e)
                    else:
                        united.append([b, e])
                for b, e in united:
                    kept.update(raw[at:b])
                    at = e
                kept.update(raw[at:])
                removed.append(sum(e - b for b, e in united))
                spans.append([{"begin": b, "end": e} for b, e in united])
                digests.append(kept.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(digests, pa.string())], names=["t", "n_removed", "spans", "kept"])

    return rows.select("t", "text", "begin", "end").mapInArrow(emit, "t binary, n_removed long, spans array<struct<begin:bigint,end:bigint>>, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256, spans (begin, end in bytes)."""
    text_batches(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col).withColumn("t", F.unhex(F.md5("text")))
    long = rows.where(F.octet_length("text") >= LENGTH).select("t", "text")
    found = anchor_rows(long)
    twice = materialise(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "repeat-anchors")  # a written side lets a hot anchor's rows be split in the join
    wanted = found.join(twice, "h").groupBy("t").agg(F.collect_set("h").alias("wanted"))
    texts = long.groupBy("t").agg(F.first("text").alias("text")).join(wanted, "t")
    texts = materialise(texts.withColumn("own", F.monotonically_increasing_id()), "repeat-texts")
    total = texts.agg(F.count("*").alias("n"), F.sum(F.size("wanted")).alias("anchors")).first()
    splitters = splitters_of(texts, total["n"], max(1, (total["anchors"] or 0) // PER_RANGE))
    merged = materialise(merged_rows(run_rows(texts, splitters)), "repeat-spans")
    across = merged.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("c"), F.collect_list(F.when(F.col("own").isNotNull(), F.struct("own", "begin"))).alias("x"))
    across = across.where("c > 1").select(F.explode("x").alias("x")).select("x.own", "x.begin", (F.col("x.begin") + LENGTH).alias("end"))
    spans = merged.where("h1 is null").select("own", "begin", "end").unionByName(across)
    spans = spans.groupBy("own").agg(F.collect_list("begin").alias("begin"), F.collect_list("end").alias("end"))
    cut = cut_out(texts.join(spans, "own"))
    copies = rows.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t", F.lit(True).alias("copied"))
    seen = rows.select("id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha"))
    out = seen.join(cut.join(copies, "t", "full"), "t", "left")
    whole = F.coalesce(F.col("copied"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    spans_of = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", none))
    return out.select(
        F.col("id").alias(id_col), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.size(spans_of).cast("long").alias("n_spans"), F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "own_sha")).alias("kept_sha256"), spans_of.alias("spans"),
    )
