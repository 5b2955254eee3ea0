"""Self join of documents by the Jaccard overlap of their five-word shingles.

Documents with one shingle set form a class; all later work is on classes. Two sets that reach the threshold
share a token among the first ``n - ceil(t n) + 1`` of either, in any fixed order of tokens. The order here is
by hash, with frequent tokens put last: those that a task sees several times and ``SHARED_BY`` classes share, and
those in more than ``COMMON`` prefixes of a first count (at most ``FREQUENT`` of each). So a class meets few
others, and which tokens count as frequent changes the work but never the result.

Classes that meet in short lists (at most ``SHORT_LIST`` members) are counted pair by pair and go on when they
share as many prefix tokens as linked sets must. Every longer list, cut into bands of similar sizes, pairs its
members with its most central class (the one whose lists hold the most members; among edited copies that is
their source). Classes that such pairs connect are a family, so both ends of every link are in one. A family of at most ``BLOCK``
classes is joined in one block; a larger one is dealt into parts of half a block, and every two parts meet in a block
of their own, so the work splits. In a block every class asks once by T-occurrence search: inverted lists of the
block's tokens, for each query the short lists counted, the long ones probed by binary search for what the count left
over (DivideSkip), or counted as well where that is less, and candidates kept that reach the overlap their size needs.
A block returns links that connect its components, and for each class the documents it is linked to; pairs inside a
large group of copies are counted but never listed.

``n_links`` of a document are the other documents that reach the threshold with it, its copies among them.
Sets are compared by 64-bit hashes of shingles. Null and empty texts have no shingles and are linked with
nothing; fewer than five words form one shingle; repeated rows share a class; an empty table gives an empty
result; a null id is nobody's smallest id; other columns are not read.
"""

from __future__ import annotations

from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise

from .components import components
from .textops import Poly, chain, in_words, lower_ascii, mix, owners, runs, slices, text_batches

SEED = 6
WORDS = 5
FREQUENT, SHARED_BY, SEEN_IN_TASK = 1_000_000, 64, 3
SHORT_LIST, BLOCK = 16, 4096
ROUNDS = 4  # not read any more: parts of large families meet in blocks, without rounds
SCAN, PROBE = 1 << 20, 8  # entries counted at a time, cost of a probe against counting an entry
COMMON = 4
BROADCAST_KEYS = 2_000_000
MU = 0.0085  # weight of probing against merging


class Shingler:
    """Sorted distinct shingle hashes of every text of a column."""

    def __init__(self, k: int = WORDS):
        self.k, self.poly = k, Poly(SEED, lower_ascii())

    def __call__(self, column: pa.Array):
        """Yield (text number, set) in order."""
        for row, data, offsets in slices(column):
            starts, ends = runs(in_words(data), offsets)
            hashes = self.poly.ranges(self.poly.sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
            owner = owners(starts, offsets)
            shingles, at = chain(hashes, owner, self.k)
            first = np.searchsorted(starts, offsets, "left")
            edges = np.searchsorted(at, first, "left")
            for j in range(len(offsets) - 1):
                n = int(first[j + 1] - first[j])
                if n >= self.k:
                    own = np.sort(shingles[edges[j] : edges[j + 1]])
                    yield row + j, own[np.concatenate([[True], own[1:] != own[:-1]])]
                elif n:  # the whole sequence is one shingle
                    h, _ = chain(hashes[first[j] : first[j + 1]], owner[first[j] : first[j + 1]], n)
                    yield row + j, mix(h + np.uint64(n))
                else:
                    yield row + j, np.zeros(0, np.uint64)


def class_key(tokens: np.ndarray) -> int:
    """Equal for equal sets, whatever their order."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(mix(tokens)) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def least_overlap(n: int, m: int, percent: int) -> int:
    """Fewest common tokens with which sets of n and m tokens reach the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def set_rows(docs: DataFrame) -> DataFrame:
    """Id, hash of the text, size of the set and class of every document."""

    def measure(batches):
        shingler = Shingler()
        for batch in batches:
            n, k = [], []
            for _, tokens in shingler(batch.column(2)):
                n.append(len(tokens))
                k.append(class_key(tokens) if len(tokens) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=["id", "t", "n", "k"])

    return docs.select("id", "t", "text").mapInArrow(measure, f"id {docs.schema['id'].dataType.simpleString()}, t long, n long, k long")


def distinct_sets(batches, shingler: Shingler, column: int):
    """Class and set, once for each class of a task."""
    seen: set[int] = set()
    for batch in batches:
        for _, tokens in shingler(batch.column(column)):
            if len(tokens):
                k = class_key(tokens)
                if k not in seen:
                    seen.add(k)
                    yield k, tokens


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Sorted tokens that at least ``SHARED_BY`` classes share, counted where a task sees them several times."""

    def count(batches):
        held, room, shingler = [], 0, Shingler()

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= SEEN_IN_TASK
            return pa.record_batch([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["token", "c"])

        for _, tokens in distinct_sets(batches, shingler, 0):
            held.append(tokens)
            room += len(tokens)
            if room > 2_000_000:
                yield flush()
                held, room = [], 0
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= SHARED_BY)
    return most_frequent(counted)


def most_frequent(counted: DataFrame) -> np.ndarray:
    """The tokens with the largest counts, at most ``FREQUENT``, sorted."""
    rows = counted.orderBy(F.desc("c"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def postings(docs: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """Token and class for the first tokens of every class, frequent tokens last."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches):
        late, shingler = shared.value, Shingler()
        tokens_out, k_out, room = [], [], 0

        def flush():
            sizes = [len(x) for x in tokens_out]
            return pa.record_batch([pa.array(np.concatenate(tokens_out).view(np.int64)), pa.array(np.repeat(np.array(k_out, np.int64), sizes))], names=["token", "k"])

        for k, tokens in distinct_sets(batches, shingler, 0):
            p = prefix_length(len(tokens), percent)
            if len(late):
                is_late = late[np.minimum(np.searchsorted(late, tokens), len(late) - 1)] == tokens
                tokens = np.concatenate([tokens[~is_late], tokens[is_late]])
            tokens_out.append(tokens[:p])
            k_out.append(k)
            room += p
            if room > 50_000:
                yield flush()
                tokens_out, k_out, room = [], [], 0
        if tokens_out:
            yield flush()

    return docs.select("text").mapInArrow(emit, "token long, k long")


class Block:
    """Inverted lists over a block of sets, and T-occurrence searches in them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, len(sets)
        self.sizes = np.array([len(x) for x in sets])
        _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(ids, kind="stable")
        self.doc = owner[order]
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        self.keys = ids[order] * self.n + self.doc  # sorted, so one search probes any lists
        self.tokens = np.split(ids, np.cumsum(self.sizes)[:-1])
        self.counts = counts

    def tally(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens' lists hold each set."""
        seen, sizes = np.zeros(self.n, np.int64), self.counts[tokens]
        total = np.cumsum(sizes)
        at = 0
        while at < len(tokens):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SCAN, "right")))
            own = sizes[at:end]
            first = np.repeat(self.begin[tokens[at:end]] - (np.cumsum(own) - own), own)
            seen += np.bincount(self.doc[first + np.arange(len(first))], minlength=self.n)
            at = end
        return seen

    def probe(self, tokens: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many of the tokens each of the sets ``left`` holds."""
        seen, step = np.zeros(len(left), np.int64), max(1, SCAN // len(left))
        for at in range(0, len(tokens), step):
            probes = (tokens[at : at + step, None] * self.n + left[None, :]).ravel()
            place = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            seen += (self.keys[place] == probes).reshape(-1, len(left)).sum(axis=0)
        return seen

    def search(self, i: int, among: np.ndarray) -> list[int]:
        """Members of ``among`` (a mask) that reach the threshold with set ``i``."""
        return self.linked(i, among).tolist()

    def linked(self, i: int, among: np.ndarray) -> np.ndarray:
        size, tokens = int(self.sizes[i]), self.tokens[i]
        fits = among & (100 * self.sizes >= self.percent * size) & (100 * size >= self.percent * self.sizes)
        fits[i] = False
        none = np.zeros(0, np.int64)
        if not fits.any():
            return none
        need = -(-self.percent * (size + self.sizes) // (100 + self.percent))
        least = int(need[fits].min())
        tokens = tokens[self.counts[tokens] > 1]
        if len(tokens) < least:
            return none
        length = self.counts[tokens]
        by_length = tokens[np.argsort(length, kind="stable")]
        n_long = min(least - 1, int(least / (MU * log2(max(2, int(length.max()))) + 1)))
        short, long = by_length[: len(tokens) - n_long], by_length[len(tokens) - n_long :]
        seen = self.tally(short)
        left = np.flatnonzero(fits & (seen >= need - n_long))
        if len(left) and n_long:
            if int(self.counts[long].sum()) <= PROBE * n_long * len(left):
                seen += self.tally(long)
            else:
                seen[left] += self.probe(long, left)
        return left[seen[left] >= need[left]]


def block_answers(sets: list[np.ndarray], copies: np.ndarray, percent: int, first: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect all components, and for each set the documents (``copies``) of the sets it is linked to.

    Every set asks those behind it; with ``first``, the first so many ask all others, and these nobody.
    """
    block, comp, place = Block(sets, percent), np.arange(len(sets)), np.arange(len(sets))
    links, counts = [], np.zeros(len(sets), np.int64)
    for i in range(len(sets) if first is None else first):
        found = block.linked(i, place > i if first is None else place >= first)
        counts[i] += copies[found].sum()
        counts[found] += copies[i]
        while len(found := found[comp[found] != comp[i]]):
            j = int(found[0])
            links.append((i, j))
            comp[comp == comp[j]] = comp[i]
    return links, counts


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all components of the sets."""
    return block_answers(sets, np.ones(len(sets), np.int64), percent)[0]


def dealt(family: DataFrame) -> DataFrame:
    """Block rows (a, low, high, part, k, copies): every two parts of a family in a block."""
    parts = F.when(F.col("size") <= BLOCK, 1).otherwise(F.ceil(2 * F.col("size") / BLOCK)).cast("long")
    rows = family.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.select(F.col("comp").alias("a"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", F.col("node").alias("k"), "copies")


def verified(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all linked classes of each block; rows without b count a's linked documents in it."""
    rows = rows.join(texts.select("k", "text"), "k")

    def search(batches):
        shingler, held, names, sets, copies, parts = Shingler(), None, [], [], [], []

        def finish():
            if len(sets) < 2:
                return []
            first = None if held[1] == held[2] else sum(p == held[1] for p in parts)
            found, counts = block_answers(sets, np.array(copies, np.int64), percent, first)
            return [(names[i], names[j], 0) for i, j in found] + [(k, None, c) for k, c in zip(names, counts.tolist(), strict=True) if c]

        def answer(out):
            return pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["a", "b", "c"])

        for batch in batches:
            a, low, high, part, k, c = (batch.column(i).to_pylist() for i in range(6))
            out = []
            for i, tokens in shingler(batch.column(6)):
                if held != (a[i], low[i], high[i]):
                    out += finish()
                    held, names, sets, copies, parts = (a[i], low[i], high[i]), [], [], [], []
                names.append(k[i])
                sets.append(tokens)
                copies.append(c[i])
                parts.append(part[i])
            yield answer(out)
        yield answer(finish())

    by = ("a", "low", "high")
    return rows.select(*by, "part", "k", "copies", "text").repartition(*by).sortWithinPartitions(*by, "part", "k").mapInArrow(search, "a long, b long, c long")


def paired(lists: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists that share enough prefix tokens.

    Of two linked sets, the one whose prefix ends first has at most ``n - overlap`` prefix tokens that the other
    lacks, and all the others are in both prefixes. Pairs that also share a longer list meet there.
    """
    both = lists.select("token", F.col("k").alias("a")).join(lists.select("token", F.col("k").alias("b")), "token").where("a < b")
    counted = both.groupBy("a", "b").agg(F.count("*").alias("c"))
    counted = counted.join(sizes.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    overlap = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    spare = lambda n: (n - F.ceil(percent * n / 100) + 1) - (n - overlap)
    similar = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    return counted.where(similar & (F.col("c") >= F.least(spare(F.col("na")), spare(F.col("nb"))))).select("a", "b")


def class_links(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each linked class (node) with its component and the documents of other classes it is linked to."""
    often = frequent_tokens(docs)
    met = postings(docs, often, percent).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > COMMON)
    posted = postings(docs, np.union1d(often, most_frequent(met)), percent)
    shared = posted.groupBy("token").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high").select("token")
    shared = materialise(shared, "tokens-met")  # a written side lets a hot token's postings be split in the join
    met = materialise(posted.join(shared, "token").distinct(), "shared-tokens")
    counts = met.groupBy("token").agg(F.count("*").alias("c"))
    members = met.join(counts, "token")
    known = sets.join(met.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.min("t").alias("t"), F.first("n").alias("n"), F.count("*").alias("copies"))
    known = materialise(known.join(members.groupBy("k").agg(F.sum("c").alias("weight")), "k"), "classes-met")
    near = paired(members.where(F.col("c") <= SHORT_LIST).select("token", "k"), known, percent)
    # Longer lists are cut into overlapping bands of sizes, so only sets of similar size stand in one.
    band = F.floor(F.log(F.col("n")) / log(100 / percent) + 1e-9)
    banded = members.where(F.col("c") > SHORT_LIST).select("token", "k").join(known.select("k", "n"), "k")
    banded = banded.select(F.explode(F.array(band, band + 1)).alias("band"), "token", "k").select(F.xxhash64("token", "band").alias("token"), "k")
    rest = materialise(banded, "long-lists")
    weighed = rest.join(known.select("k", "weight"), "k")
    queries = weighed.groupBy("token").agg(F.max(F.struct("weight", "k"))["k"].alias("a"))
    pairs = weighed.join(queries, "token").where("k <> a").select("a", F.col("k").alias("b"))
    family = components(materialise(pairs.unionByName(near).distinct(), "class-pairs"))
    sizes = family.groupBy("comp").agg(F.count("*").alias("size"))
    family = materialise(family.join(sizes, "comp").join(known.select(F.col("k").alias("node"), "t", "copies"), "node"), "families")
    wanted = family.select("t", F.col("node").alias("k"))
    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    texts = materialise(docs.select("t", "text").join(keys, "t").groupBy("k").agg(F.first("text").alias("text")), "class-texts")
    found = materialise(verified(dealt(family), texts, percent), "class-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("c").alias("others"))
    labels = components(found.where("b is not null"))
    return labels.join(counts, F.col("node") == F.col("of")).select("node", "comp", "others")


def jaccard_join(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (smallest linked id), class_id (smallest id of an equal set), n_links."""
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    sets = materialise(set_rows(rows), "shingle-sets")
    labels = class_links(rows, sets.where("n > 0"), percent)
    classes = sets.where("n > 0").groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("copies")).join(labels, F.col("k") == F.col("node"), "left")
    classes = classes.select("k", F.coalesce("comp", "k").alias("comp"), "low", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    least = classes.groupBy("comp").agg(F.min("low").alias("component"))
    out = sets.join(classes.join(least, "comp").select("k", "component", "low", "links"), "k", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce("low", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )
