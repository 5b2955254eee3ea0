"""Secret scan with built-in expressions only: fixed patterns, and two character Markov models.

One pass over the whole texts cuts them at every match of each pattern and writes the few cut pieces to
the shared folder; positions are running sums of their lengths. The models are chains over character
pairs: one learns from the secrets that the patterns found, the other from the ordinary identifiers, both of all
documents; what reaches the driver is a table of character pairs. A long token becomes a
secret of kind ``markov`` when the mean log-likelihood ratio per character exceeds ``margin`` and it does
not overlap a pattern's span. Without any labelled secret there is no model and only patterns count.

Null text counts as empty; repeated rows are scanned one by one; an empty table gives an empty result;
other columns are not read; ties of starts go by kind. Counts and spans stay whole for texts of any length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import materialise

from .columns import text_rows

# Patterns with the group whose length counts, and that least length.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
# Ordinary identifiers are whole tokens whose letters and digits come in separate parts. The parts are looked at one by
# one, since a pattern that repeats a group would need the matcher's stack for every part of a long token.
WHOLE = r"[A-Za-z0-9+/_=-]{8,}"
SEPARATOR, PART = r"[-_/]", r"^(?:[A-Za-z]{2,}|[0-9]+)$"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
ORDER = [*KINDS, "markov"]
BACK_OFF = 4.0


def cuts(kind: str, pattern: str, group: int, text: Column) -> Column:
    """One struct per match: kind, number, length of the text before it, own length, and the part that counts."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    made = F.transform(
        F.arrays_zip(gaps.alias("g"), whole.alias("m"), part.alias("p")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["m"].alias("matched"), x["p"].alias("part")),
    )
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,matched:string,part:string>>")
    return F.when(text.rlike(pattern), F.filter(made, lambda x: x["matched"].isNotNull())).otherwise(none)


def pieces(rows: DataFrame) -> DataFrame:
    """Row number, id and every match with its start and end in code points; a row without matches stays once."""
    text = F.col("text")
    all_kinds = F.concat(*[cuts(k, p, g, text) for k, (p, g, _) in KINDS.items()], cuts("markov", TOKEN, 0, text))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", all_kinds.alias("found"))
    return numbered.select("row", "id", F.explode_outer("found").alias("x")).select("row", "id", "x.*")


def placed(found: DataFrame) -> DataFrame:
    """Starts and ends as running sums within each text and kind."""
    along = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(along)
    return found.where("kind is not null").withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))


def pair_counts(values: DataFrame, column: str) -> dict[tuple[int, int], int]:
    """Counts of adjacent character classes; class 0 is the start and every character outside ``LETTERS``."""
    codes = F.transform(F.split(column, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(LETTERS), c)))
    codes = F.concat(F.array(F.lit(0)), F.filter(codes, lambda c: c > 0))
    both = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * (len(LETTERS) + 1) + b)
    counts = values.select(F.explode(both).alias("k")).groupBy("k").count().collect()  # at most (classes + 1)^2 rows
    return {divmod(r["k"], len(LETTERS) + 1): r["count"] for r in counts}


def ratio_table(secret: dict, ordinary: dict) -> list[float]:
    """Log-likelihood ratio of each character pair; pairs seldom seen fall back to single characters."""
    n = len(LETTERS) + 1

    def chain(counts):
        single, total = [0.5] * n, [0] * n
        for (a, b), c in counts.items():
            single[b] += c
            total[a] += c
        all_singles = sum(single)
        return [[math.log((counts.get((a, b), 0) + BACK_OFF * single[b] / all_singles) / (total[a] + BACK_OFF)) for b in range(n)] for a in range(n)]

    s, o = chain(secret), chain(ordinary)
    return [s[a][b] - o[a][b] for a in range(n) for b in range(n)]


def mean_ratio(token: str, table: list[float]) -> Column:
    """Mean ratio per character of a token made of ``LETTERS``."""
    ratios = F.split(F.lit(" ".join(f"{x:.6f}" for x in table)), " ").cast("array<double>")  # folded into a constant
    codes = F.concat(F.array(F.lit(0)), F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(LETTERS), c)))
    score = lambda k: F.aggregate(F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k) - 1), lambda a, b: F.get(ratios, a * (len(LETTERS) + 1) + b)), F.lit(0.0), lambda t, x: t + x)
    return F.transform(F.array(codes), lambda k: score(k) / F.greatest(F.size(k) - 1, F.lit(1)))[0]


def identifiers(text: Column) -> Column:
    """The ordinary identifiers of a text."""
    return F.filter(F.regexp_extract_all(text, F.lit(WHOLE), F.lit(0)), lambda w: F.forall(F.split(w, SEPARATOR), lambda p: p.rlike(PART)))


def learn(rows: DataFrame, known: DataFrame) -> list[float] | None:
    """The ratio table from the known secrets and the identifiers of all documents."""
    secret = pair_counts(known, "part")
    if not secret:
        return None
    plain = F.col("text")
    for pattern, *_ in KINDS.values():
        plain = F.regexp_replace(plain, pattern, " ")
    ordinary = pair_counts(rows.select(F.explode(identifiers(plain)).alias("w")), "w")
    return ratio_table(secret, ordinary)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.5) -> DataFrame:
    """One row per document: row, id, base and all, arrays of (start, rank of the kind, end, kind)."""
    rows = text_rows(docs, id_col, text_col)
    found = materialise(pieces(rows), "secret-pieces")
    least = F.create_map(*[x for k, (_, _, n) in KINDS.items() for x in (F.lit(k), F.lit(n))])
    spans = placed(found)
    base = spans.where((F.col("kind") != "markov") & (F.length("part") >= least[F.col("kind")]))
    table = learn(rows, base)
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind")).cast("int")
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("kind"))
    guess = spans.where(F.col("kind") == "markov")
    guess = guess.where(mean_ratio("matched", table) > margin) if table else guess.limit(0)
    marked = base.select("row", span.alias("span")).unionByName(guess.select("row", span.alias("span")))
    by_row = found.select("row", "id").unionByName(marked, allowMissingColumns=True).groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), F.sort_array(F.collect_list("span")).alias("spans"))
    sure = F.filter("spans", lambda x: x["kind"] != "markov")
    free = lambda x, b: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    return by_row.withColumn("base", sure).withColumn("all", F.filter("spans", lambda x: (x["kind"] != "markov") | free(x, F.col("base")))).drop("spans")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.5) -> DataFrame:
    """One row per document: counts of each kind, a digest of the pattern spans, and all spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return secret_spans(docs, id_col, text_col, margin).select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"),
        F.size(F.filter("all", lambda x: x["kind"] == "markov")).cast("long").alias("n_markov"),
    )
