"""Benchmark decontamination over canonical templates.

Texts become words whose numbers, names (capitalised words) and units are replaced by typed placeholders.
All windows of ``WINDOW`` canonical words with at least ``LITERALS`` plain ones (templates) are hashed and joined
to the windows of the benchmark, and besides all windows by their lower-cased words as they stand (literals), so a
verbatim item is found however many numbers and names it holds. Both sides carry the replaced values of the matched
windows; on each alignment (document, item, offset) every value of the item must stand for one value of the document
and the reverse, and windows with a value that does not are left out, so a re-parameterised question is found and a
chance likeness of templates is not. A document is contaminated when the windows left cover ``COVER`` of all windows
of an item, or of its templates where these hold ``COVER`` of its words, or when they are ``RUN`` windows in all.
Unit names that are also words or letters (``AFTER``) are units only behind a number.

The benchmark's window hashes prune inside the tasks and its rows are broadcast only when they are counted
to be at most ``SMALL``; beyond that every window goes into a shuffled join. Items shorter than ``WINDOW``
words are matched by one window of their own length, from ``SHORTEST`` words on; shorter ones match nothing.
Null texts have no windows; repeated rows are judged one by one; an empty table gives an empty result, an empty
benchmark leaves every document clean; ties between items go to the smallest id; other columns are not read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import Poly, chain, lower_ascii, owners, runs, slices, text_batches

WINDOW, LITERALS, SHORTEST = 8, 4, 4
COVER, RUN = 0.5, 6
SMALL = 1_000_000
# Names of units.
UNITS = "mm cm m km in ft yd mi g mg kg lb oz t s ms min h hr l ml kb mb gb hz khz mhz ghz w kw v a kmh mph percent usd eur dollars euros cents meters metres kilometers miles grams kilograms pounds liters litres hours minutes seconds days weeks months years degrees"
AFTER = "in t s m a g l h v w mi min"
SEED = 10
LITERAL = np.uint64(0x5851F42D4C957F2D)  # keeps the hashes of literal windows apart from those of templates


def word_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        out[a:b] = True
    return out


class Canon:
    """Canonical words of byte buffers: starts, ends, hash, type (0 plain, 1 number, 2 name, 3 unit) and hash of the word itself."""

    def __init__(self):
        self.poly, self.word = Poly(SEED, lower_ascii()), word_bytes()
        self.units, self.after = self.hashed(UNITS), self.hashed(AFTER)

    def hashed(self, names: str) -> np.ndarray:
        words = [np.frombuffer(u.encode(), np.uint8) for u in names.split()]
        return np.array(sorted(int(self.poly.ranges(self.poly.sums(u), np.array([0]), np.array([len(u)]))[0]) for u in words), np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends = runs(self.word[data], offsets)
        if not len(starts):
            return starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
        hashes = self.poly.ranges(self.poly.sums(data), starts, ends)
        first = data[starts]
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
        number = digits[ends] - digits[starts] == ends - starts
        second = data[np.minimum(starts + 1, len(data) - 1)]
        name = ((first >= 65) & (first < 91)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        owner = owners(starts, offsets)
        behind = np.concatenate([[False], number[:-1] & (owner[1:] == owner[:-1])])
        unit = np.isin(hashes, self.units) & (behind | ~np.isin(hashes, self.after))
        kind = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.int8)
        return starts, ends, np.where(kind > 0, kind.astype(np.uint64), hashes), kind, hashes


def windows(batches, lengths: list[int], wanted: np.ndarray | None, header: bool):
    """Matched windows as (id, text number, position, window hash, values); with ``header`` one row per text besides."""
    canon, number = Canon(), 0
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        for row, data, offsets in slices(column):
            starts, ends, canonical, kind, words = canon(data, offsets)
            owner = owners(starts, offsets)
            first = np.searchsorted(owner, np.arange(len(offsets) - 1), "left")
            plain = np.concatenate([[0], np.cumsum(kind == 0)])
            rows = list(range(len(offsets) - 1)) if header else []
            places, sizes, literal, hashes, values = ([None] * len(rows) for _ in range(5))
            raw = data.tobytes()
            for w, as_is in product(lengths, (False, True)):
                h, at = chain(words if as_is else canonical, owner, w)
                h = h ^ LITERAL if as_is else h
                keep = np.ones(len(h), bool) if as_is else plain[at + w] - plain[at] >= min(LITERALS, w - 1)
                if wanted is not None and len(h):
                    keep &= wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else False
                for i, x in zip(at[keep].tolist(), h[keep].view(np.int64).tolist(), strict=True):
                    rows.append(int(owner[i]))
                    places.append(int(i - first[owner[i]]))
                    sizes.append(w)
                    literal.append(as_is)
                    hashes.append(x)
                    values.append([f"{kind[j]}:{raw[starts[j]:ends[j]].decode('utf-8', 'replace').lower()}" for j in range(i, i + w) if kind[j]])
            yield pa.record_batch(
                [ids.take(pa.array([row + r for r in rows], pa.int64())), pa.array([number + r for r in rows], pa.int64()), pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(literal, pa.bool_()), pa.array(hashes, pa.int64()), pa.array(values, pa.list_(pa.string()))],
                names=["id", "n", "pos", "size", "literal", "h", "slots"],
            )
            number += len(offsets) - 1


def window_rows(docs: DataFrame, id_col: str, text_col: str, lengths: list[int], wanted: np.ndarray | None, header: bool) -> DataFrame:
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = two.schema["id"].dataType.simpleString()
    out = two.mapInArrow(lambda batches: windows(batches, lengths, wanted, header), f"id {kind}, n long, pos int, size int, literal boolean, h long, slots array<string>")
    return out.withColumn("row", F.struct(F.spark_partition_id().alias("part"), "n")).drop("n")


def word_counts(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def count(batches):
        canon = Canon()
        for batch in batches:
            for row, data, offsets in slices(batch.column(1)):
                starts, *_ = canon(data, offsets)
                n = np.bincount(owners(starts, offsets), minlength=len(offsets) - 1)
                yield pa.record_batch([batch.column(0).slice(row, len(n)), pa.array(n, pa.int64())], names=["id", "n"])

    two = bench.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(count, f"id {two.schema['id'].dataType.simpleString()}, n long")


def alignments(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """Windows of documents with those of the benchmark that have the same template; one row without a match per document."""
    sizes = word_counts(bench, item_col, item_text_col).where(F.col("n") >= SHORTEST)
    lengths = sorted(r["w"] for r in sizes.select(F.least("n", F.lit(WINDOW)).alias("w")).distinct().collect())  # at most WINDOW rows
    items = window_rows(bench, item_col, item_text_col, lengths, None, False)
    items = items.join(sizes.select(F.col("id").alias("sized"), F.col("n").alias("words")).distinct(), F.col("id").eqNullSafe(F.col("sized"))).where(F.col("size") == F.least("words", F.lit(WINDOW)))
    items = items.select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("size").alias("item_size"), F.col("literal").alias("item_literal"), F.col("h"), F.col("slots").alias("item_slots"), "words", F.greatest(F.col("words") - WINDOW + 1, F.lit(1)).alias("item_windows")).distinct()
    spans = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("item_pos", F.col("item_pos") + F.col("item_size") - 1)))))
    templates = items.where("not item_literal").groupBy(F.col("item").alias("of"), F.col("words").alias("of_words")).agg(F.countDistinct("item_pos").alias("item_templates"), spans.alias("spanned"))
    templates = templates.where(F.col("spanned") >= COVER * F.col("of_words")).drop("spanned")
    items = items.join(templates, F.col("item").eqNullSafe(F.col("of")) & (F.col("words") == F.col("of_words")), "left").drop("of", "of_words", "words")
    small = items.count() <= SMALL
    wanted = np.unique(np.array([r["h"] for r in items.select("h").distinct().collect()], np.int64).view(np.uint64)) if small else None
    found = window_rows(docs, id_col, text_col, lengths, wanted, True)
    same = (F.col("size") == F.col("item_size")) & (F.col("literal") == F.col("item_literal"))
    if small:
        return found.join(F.broadcast(items), (found["h"] == items["h"]) & same, "left")
    # rows that only stand for their document have no window; a key of their own spreads them over the partitions
    spread = F.coalesce(found["h"], F.xxhash64(found["row"]))
    return found.join(items, (spread == items["h"]) & same, "left")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: contaminated, n_items (items found), item (the best covered), coverage, windows."""
    text_batches(docs.sparkSession)
    pairs = alignments(docs, bench, id_col, text_col, item_col, item_text_col)
    align = ["row", "item", (F.col("pos") - F.col("item_pos")).alias("offset")]
    pair = lambda d: F.arrays_zip(d.alias("d"), F.col("item_slots").alias("b"))
    slots = F.when(F.col("item_literal"), pair(F.col("item_slots"))).when(F.size("slots") == F.size("item_slots"), pair(F.col("slots")))
    window = F.when(F.col("item").isNotNull() & slots.isNotNull(), F.struct(F.col("item_pos").alias("place"), F.col("item_literal").alias("literal"), slots.alias("slots")))
    seen = pairs.groupBy(*align).agg(F.first("id").alias("id"), F.first("item_windows").alias("item_windows"), F.first("item_templates").alias("item_templates"), F.collect_set(window).alias("seen"))
    seen = seen.withColumn("slots", F.array_distinct(F.flatten(F.col("seen.slots"))))
    # Values that stand for several of the other side: equal neighbours among the sorted ends of the distinct pairs.
    for side in "db":
        seen = seen.withColumn(side, F.array_sort(F.col("slots")[side]))
        seen = seen.withColumn(f"bad_{side}", F.expr(f"filter({side}, (x, i) -> i > 0 and x = get({side}, i - 1))"))
    seen = seen.withColumn("good", F.filter("seen", lambda w: ~F.arrays_overlap(w["slots"]["d"], F.col("bad_d")) & ~F.arrays_overlap(w["slots"]["b"], F.col("bad_b"))))
    places = lambda only: F.size(F.array_distinct(F.flatten(F.collect_list(F.transform(only, lambda w: w["place"])))))
    by_item = seen.groupBy("row", "item").agg(
        F.first("id").alias("id"), F.max("item_windows").alias("item_windows"), F.max("item_templates").alias("item_templates"),
        places(F.col("good")).alias("windows"), places(F.filter("good", lambda w: ~w["literal"])).alias("templates"),
    )
    share = F.greatest(F.col("windows") / F.col("item_windows"), F.col("templates") / F.col("item_templates"))
    cover = F.when(F.col("item").isNotNull(), F.least(share, F.lit(1.0))).otherwise(0.0)
    judged = by_item.withColumn("coverage", cover).withColumn("hit", (F.col("windows") > 0) & ((F.col("coverage") >= COVER) | (F.col("windows") >= RUN)))
    best = F.min(F.struct((~F.col("hit")).alias("missed"), (-F.col("coverage")).alias("less"), "item", "windows"))
    out = judged.groupBy("row").agg(F.first("id").alias("id"), F.max("hit").alias("contaminated"), F.count(F.when(F.col("hit"), 1)).alias("n_items"), best.alias("best"))
    item = F.when(F.col("contaminated"), F.col("best.item"))
    return out.select(F.col("id").alias(id_col), "contaminated", "n_items", item.alias("item"), F.round(-F.col("best.less") + 0.0, 6).alias("coverage"), F.col("best.windows").cast("long").alias("windows"))
