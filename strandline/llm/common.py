"""What the corpus operators share: row keys, ranks and small scalars.

Row keys.  ``doc_id`` may be null or repeated, so operators follow a row by two longs: ``_k1``
is the id, or a hash of the text where the id is null, and ``_k2`` a hash (of another seed) of
the id's nullness and the text.  Rows that agree in both hold the same id and text and get the
same result: two rows of one id are told apart by 64 bits, two rows without id by 128.

Clashing names.  Operators that hand on whole rows carry them as one struct (``rowed``), so no
column of the input can meet a column of the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, durable

__all__ = ["KEY", "GAP", "discard", "durable", "hash60", "keyed", "lower_ascii", "ranked", "rowed", "small_batches", "word_list", "words"]

KEY = ["_k1", "_k2"]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Inside, texts go to Python so many rows at a time at most: rows may be long, and the default of 10,000 counts rows, not bytes.

    The session's setting is put back at the end; what is to profit from it must be written inside.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """_k1 and _k2 of a row."""
    text = F.coalesce(text_col, F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("no id"), text)).alias("_k1"), F.xxhash64(F.col(id_col).isNull(), text).alias("_k2")]


def keyed(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and the named columns, with the row key; every other column is left behind."""
    return docs.select(*row_key(id_col, text_col), *dict.fromkeys([id_col, text_col, *more]))


def rowed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row key, and all columns of docs as one struct ``row``; select("row.*") gives them back."""
    return docs.select(*row_key(id_col, text_col), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def hash60(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """60 bits of md5 over id and text; SQL engines that have md5 can repeat it."""
    whole = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def lower_ascii(text: str | Column) -> Column:
    """A-Z in lower case, all else unchanged; the cheap built-in where every character has one byte."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


#: What parts words: words are runs of ASCII letters and digits and of everything outside ASCII.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """The lower-cased words of a text; none of a null. (Splitting is linear; extracting all matches copies the text for each.)"""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), GAP), ""), F.array().cast("array<string>"))


#: For Python: one byte table that lower-cases A-Z and turns what is no word into a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_list(text: str | None) -> list[bytes]:
    """words() in Python."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def ranked(df: DataFrame, *order: Column, name: str = "_rank") -> DataFrame:
    """df with each row's place (from 0) in the order. Sorted in ranges; only a count for each partition reaches the driver."""
    part = durable(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    place = F.shiftright("_mid", 33)
    counts = dict(part.groupBy(place.cast("int").alias("p")).count().collect())
    starts, at = [], 0
    for p in range(max(counts, default=0) + 1):  # a number for each partition of the sort
        starts.append(F.lit(at).cast("long"))
        at += counts.get(p, 0)
    start = F.element_at(F.array(*starts), (place + 1).cast("int"))
    out = part.withColumn(name, (start + F.col("_mid").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_mid")
    out._strandline_path = part._strandline_path
    return out
