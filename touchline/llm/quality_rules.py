"""Quality rules by document and by host, with built-in expressions only.

Every document is measured once over its whole text; the measures, without the texts, are written to the
shared folder. Failures of every rule (too few or repeated words, word length, symbols, repeated lines) are then
counted by host over distinct texts, so that a large group of copies does not condemn its host, and shrunk with a beta
prior per rule, fitted to all hosts by moments. A host is rejected when even the lower end of one of its shrunk failure
rates exceeds ``max_rate``; its documents are not kept. Only the base rule rejects a document by itself.

Null text has no words; a null host is a host of its own; ties and repeated rows are measured alike; an
empty table gives an empty result; other columns are not read. Long texts cost time in proportion to
n log n of their words: repeated windows are found by sorting packed hashes and confirmed by the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import materialise

from .columns import SPACED, let, text_rows

MAX_RATE = 0.75
SPREADS = 2.0
# Rules by name, as conditions that Spark and other SQL engines read alike. ``base`` also rejects the document itself.
RULES = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "symbols": "10 * n_symbols > n_words AND n_symbols > 0",
    "repeated_lines": "n_lines > 2 AND 10 * n_dup_lines > 3 * n_lines",
}


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in ``words``."""

    def by_hash(n: Column) -> Column:
        bits = F.length(F.bin(n)).cast("int")  # enough for every position
        at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
        head = lambda x: F.call_function("shiftright", x, bits)
        packed = F.transform(
            F.slice(words, F.lit(1), n - 2),
            lambda w, i: F.call_function("shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")),
        )
        alike = lambda a, b: F.coalesce(a == b, F.lit(False))
        twice = lambda s: F.filter(s, lambda x, i: alike(head(x), head(F.get(s, i - 1))) | alike(head(x), head(F.get(s, i + 1))))
        spelled = lambda c: F.transform(c, lambda x: let(at(x).cast("int"), lambda p: F.struct(F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).alias("w"), p.alias("p"))))
        same = lambda s: F.filter(s, lambda x, i: alike(x["w"], F.get(s, i - 1)["w"]) | alike(x["w"], F.get(s, i + 1)["w"]))
        starts = let(F.sort_array(packed), lambda s: let(F.sort_array(spelled(twice(s))), lambda e: F.sort_array(F.transform(same(e), lambda x: x["p"]))))
        covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(starts, covered)

    return let(F.size(words), lambda n: F.when(n < 4, F.lit(0).cast("long")).otherwise(by_hash(n)))


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Counts of each document next to its host and a digest of its text."""
    rows = text_rows(docs, id_col, text_col, host=host_col)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(SPACED))
    counted = let(
        F.regexp_extract_all("text", F.lit(SPACED), 0),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")),
    )
    return rows.select(
        "id", "host", F.md5("text").alias("digest"), counted.alias("c"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    ).select("id", "host", "digest", "c.n_words", "c.word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"), "c.n_repeat_words")


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE, spreads: float = SPREADS) -> DataFrame:
    """Failure rate of each host and rule over distinct texts, shrunk by the rule's prior fitted to all hosts.

    ``measured`` has a flag ``failed_<rule>`` per rule. A host is rejected when one of its rates lies above ``max_rate``
    by ``spreads`` deviations; ``worst_rule`` is the rule with the highest shrunk rate.
    """
    texts = measured.groupBy("host", "digest").agg(*[F.max(F.col(f"failed_{r}").cast("int")).alias(r) for r in RULES])
    hosts = texts.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(r).alias(r) for r in RULES])
    rates = {r: F.col(r) / F.col("n") for r in RULES}
    m = hosts.agg(*[f(rates[r]).alias(f"{f.__name__}_{r}") for f in (F.avg, F.var_pop) for r in RULES]).first()
    found = []
    for r in RULES:
        mean = min(max(m[f"avg_{r}"] or 0.0, 1e-6), 1 - 1e-6)
        strength = max(mean * (1 - mean) / max(m[f"var_pop_{r}"] or 0.0, 1e-9) - 1, 2.0)
        a = F.col(r) + mean * strength
        b = F.col("n") - F.col(r) + (1 - mean) * strength
        spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        found.append(F.struct((a / (a + b)).alias("rate"), F.lit(r).alias("rule"), (a / (a + b) - spreads * spread > max_rate).alias("over")))
    judged = hosts.select("host", "n", F.col("base").alias("failures"), F.array(*found).alias("rules"))
    worst = F.array_max("rules")
    return judged.select("host", "n", "failures", F.get("rules", F.lit(0))["rate"].alias("shrunk_rate"), worst["rule"].alias("worst_rule"), F.exists("rules", lambda x: x["over"]).alias("rejected"))


def quality_rules(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """One row per document: measures, base_failed, kept, host_rate (shrunk, of the base rule), worst_rule and host_rejected."""
    measured = measures(docs, id_col, text_col, host_col)
    measured = materialise(measured.withColumns({f"failed_{r}": F.expr(rule) for r, rule in RULES.items()}), "quality-measures")
    hosts = host_verdicts(measured, max_rate)
    joined = measured.alias("d").join(hosts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left")
    rejected = F.coalesce(F.col("h.rejected"), F.lit(False))
    return joined.select(
        F.col("d.id").alias(id_col), "d.n_words", "d.word_chars", "d.n_symbols", "d.n_dup_lines", "d.n_repeat_words", F.col("d.failed_base").alias("base_failed"),
        (~F.col("d.failed_base") & ~rejected).alias("kept"), F.col("h.shrunk_rate").alias("host_rate"), "h.worst_rule", rejected.alias("host_rejected"),
    )
