"""Column helpers shared by the built-in-expression operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of whitespace-separated text, and of text cut at ASCII punctuation.
SPACED = r"[^\x20\x09-\x0D]+"
WORDLIKE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "K"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower case for matching ASCII words; the one other sign that lower-cases into ASCII is put aside."""
    return F.lower(F.replace(text, F.lit(KELVIN), F.lit("ĸ")))


def text_rows(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """Id, text (null becomes empty) and further columns under names that cannot clash."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(source).alias(name) for name, source in more.items()],
    )
