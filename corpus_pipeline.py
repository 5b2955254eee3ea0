"""From raw documents to packed sequences: language, near copies, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. Copies are told apart by id and a
hash of the text, so null and repeated ids are safe; verdicts on leaks and secrets are keyed by 128 bits of the text
and come back to the documents by a join that broadcasts them only when they are counted to be few.

In every stage a null text counts as empty, texts are read whole whatever their length, repeated rows are judged one
by one except where the stage is about copies, an empty table gives an empty table, and further columns pass through
(their names cannot clash). Each stage says what becomes of texts without content and of ties.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.decontamination import decontaminate
from touchline.llm.jaccard_join import jaccard_join
from touchline.llm.language_id import CLASSES, with_language
from touchline.llm.packing import pack
from touchline.llm.secret_scan import secret_spans
from touchline.session import materialise

FEW = 1_000_000
MARK = "[SECRET]"
# A text is rejected when the best language costs more bits than writing its symbols one by one; shorter ones say too little.
UNEXPLAINED, EVIDENCE = log2(CLASSES), 64


def text_key(docs: DataFrame) -> Column:
    return F.md5(F.coalesce(docs["text"], F.lit("")))


def copy_key(docs: DataFrame) -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def few(verdicts: DataFrame) -> DataFrame:
    """The written verdicts, broadcast when there are at most ``FEW``."""
    return F.broadcast(verdicts) if verdicts.count() <= FEW else verdicts


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that no learned language explains; a missing language is filled in.

    Null and empty texts have no letter and go. Languages that explain a text equally well: the first by name. With no
    labelled text there is nothing to judge by, and every text with a letter stays as it is.
    """
    judged = with_language(docs)
    unexplained = F.coalesce((F.col("symbols") >= EVIDENCE) & (F.col("bits") > UNEXPLAINED), F.lit(False))
    found = F.when(F.col("lang_pred") != "und", F.col("lang_pred"))
    lang = F.coalesce(F.col("doc.lang"), found.cast(docs.schema["lang"].dataType))
    return judged.where((F.col("symbols") > 0) & ~unexplained).select(*[lang.alias(c) if c == "lang" else F.col("doc")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of exact and near copies; of equal rows keep one.

    A null id comes before all others. Texts without a word are nobody's copy and stay. Of rows with the same id and
    text the one with the smallest further columns stays.
    """
    keyed = docs.select(F.struct(F.col("doc_id"), copy_key(docs).alias("t")).alias("key"), "text")
    grouped = materialise(jaccard_join(keyed, id_col="key"), "near-copies")
    linked = grouped.where("n_shingles > 0")
    lost = linked.where("not (key <=> component_id)").select("key", F.lit(False).alias("stays"))
    twice = linked.where("key <=> component_id").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.lit(True).alias("stays"))
    verdicts = materialise(lost.unionByName(twice).distinct().select(F.col("key.doc_id").alias("copy_id"), F.col("key.t").alias("copy_t"), "stays"), "copy-verdicts")
    names = docs.columns
    v = few(verdicts)
    judged = docs.join(v, docs["doc_id"].eqNullSafe(v["copy_id"]) & (copy_key(docs) == v["copy_t"]), "left")
    one = judged.where(v["stays"]).select(F.struct(v["copy_id"], v["copy_t"]).alias("copy"), F.struct(*[docs[c].alias(c) for c in names]).alias("doc"))
    one = one.groupBy("copy").agg(F.min("doc").alias("doc")).select("doc.*")
    return judged.where(v["stays"].isNull()).select(*[docs[c] for c in names]).unionByName(one)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; equal texts share the verdict, texts without content stay."""
    keyed = docs.select(text_key(docs).alias("leak_t"), "text")
    found = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="leak_t")
    verdicts = materialise(found.where("contaminated").select("leak_t").distinct(), "leak-verdicts")
    return docs.join(few(verdicts), text_key(docs) == verdicts["leak_t"], "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of every secret; the stated length follows the text.

    Spans that overlap become one mark; a text without secrets, null among them, stays as it is. All rows stay.
    """
    keyed = docs.select(text_key(docs).alias("secret_t"), "text")
    found = secret_spans(keyed, id_col="secret_t").where(F.size("all") > 0)
    spans = materialise(found.groupBy(F.col("id").alias("secret_t")).agg(F.first("all").alias("spans")), "secret-verdicts")
    v = few(spans)
    joined = docs.join(v, text_key(docs) == v["secret_t"], "left")
    text, start = docs["text"], F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))

    def cover(acc, s):
        fresh = F.when(s["start"] >= acc["at"], F.concat(piece(acc["at"], s["start"]), F.lit(MARK))).otherwise("")
        return F.struct(F.concat(acc["out"], fresh).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    masked = F.aggregate(v["spans"], start, cover, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text).cast("long"))))
    clean = F.when(v["secret_t"].isNull(), text).otherwise(masked)
    length = F.when(v["secret_t"].isNull(), docs["n_chars"]).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    changed = {"text": clean, "n_chars": length}
    return joined.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the kept texts into pieces and put these into token-budget batches of length buckets.

    A text without words keeps one row without a bucket. Pieces of equal length are dealt in the order of their rows.
    """
    return pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None  # automata, Markov chains and the bucket search have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
