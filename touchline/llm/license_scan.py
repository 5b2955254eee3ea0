"""License scan by diagonal voting, with built-in expressions only.

Templates are short fixed texts. All rolling two-word hashes of every whole text are joined to the template
positions (a broadcast of ``TEMPLATES``, whose size is fixed); a hit votes for the diagonal (text position
minus template position). A base phrase stands where one diagonal has all its votes. For notices,
neighbouring diagonals (at most ``SLACK`` apart) merge into one span, which counts when it covers enough of
the template within a bounded length. Votes are combined before the only shuffle.

Null and empty texts have no words and no labels; repeated rows are scanned one by one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import WORDLIKE, let, lower_ascii, text_rows

# Base phrases and notices with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version 2 0": "mpl-2.0",
    "all rights reserved": "all-rights-reserved",
}
SLACK = 2
COVER = 0.85


def templates(base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> list[tuple[int, bool, str, list[str]]]:
    """Number, whether base, label and words of every template."""
    both = [(True, *x) for x in (BASE if base is None else base).items()] + [(False, *x) for x in (NOTICES if notices is None else notices).items()]
    out = [(i, is_base, label, text.split()) for i, (is_base, text, label) in enumerate(both)]
    if any(not 2 <= len(words) <= 60 for *_, words in out):
        raise ValueError("a template has 2 to 60 words")
    return out


def grams(spark: SparkSession, found) -> DataFrame:
    """Hash, template and position of every two words of the templates."""
    rows = [(i, b, label, len(w) - 1, p, w[p], w[p + 1]) for i, b, label, w in found for p in range(len(w) - 1)]
    table = spark.createDataFrame(rows, "tpl int, is_base boolean, label string, n_grams int, tpos int, w0 string, w1 string")
    return table.withColumn("h", F.xxhash64("w0", "w1")).drop("w0", "w1")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, spans of notices."""
    rows = text_rows(docs, id_col, text_col)
    pairs = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    counted = let(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORDLIKE), 0), lambda w: F.struct(F.size(w).alias("n_words"), pairs(w).alias("pairs")))
    rolled = rows.select(F.monotonically_increasing_id().alias("row"), "id", counted.alias("c")).select("row", "id", "c.n_words", F.posexplode_outer("c.pairs").alias("pos", "h"))
    hits = rolled.join(F.broadcast(grams(docs.sparkSession, templates(base, notices))), "h", "left").where(F.col("tpl").isNotNull() | (F.coalesce(F.col("pos"), F.lit(0)) == 0))
    diagonals = hits.groupBy("row", "tpl", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("is_base").alias("is_base"), F.first("label").alias("label"),
        F.first("n_grams").alias("n_grams"), F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("votes"), F.min("pos").alias("begin"), F.max("pos").alias("end"),
    )
    along = Window.partitionBy("row", "tpl").orderBy("diagonal")
    apart = F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(along) > SLACK)
    numbered = diagonals.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(along))
    spans = numbered.groupBy("row", "tpl", "span").agg(
        *[F.first(c).alias(c) for c in ("id", "n_words", "is_base", "label", "n_grams")],
        F.min("diagonal").alias("diagonal"), F.bit_or("votes").alias("votes"), F.min("begin").alias("begin"), F.max("end").alias("end"),
    )
    cover = F.bit_count("votes") / F.col("n_grams")
    whole = F.col("is_base") & (F.bit_count("votes") == F.col("n_grams"))
    fits = F.col("end") - F.col("begin") <= 1.5 * F.col("n_grams")
    spans = spans.withColumn("cover", F.when(fits, cover)).withColumn("whole", whole).withColumn("found", whole | (~F.col("is_base") & (cover >= COVER) & fits))
    names = lambda condition: F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")
    out = spans.groupBy("row").agg(
        F.first("id").alias(id_col), F.max("n_words").cast("long").alias("n_words"), F.count(F.when(F.col("whole"), 1)).alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("last_word"),
        names(F.col("whole")).alias("base_labels"), names(F.col("found")).alias("labels"), F.round(F.coalesce(F.max("cover"), F.lit(0.0)), 6).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("found") & ~F.col("is_base"), F.struct("begin", F.col("end").alias("last"), "label")))).alias("notices"),
    )
    return out.drop("row")
