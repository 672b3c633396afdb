"""FASTA text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import carried
from .lines import ranges


def renamed(lines: DataFrame, asm: str, sep: str = "#") -> DataFrame:
    """Lines with each header cut at the first blank and prefixed by the assembly."""
    head = F.concat(F.lit(f">{asm}{sep}"), F.regexp_extract("value", r"^>(\S*)", 1))
    return lines.withColumn("value", F.when(F.col("value").startswith(">"), head).otherwise(F.col("value")))


def sequences(lines: DataFrame) -> DataFrame:
    """name, seq; needs file and line_no."""
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S*)", 1))
    rows = carried(ranges(lines.withColumn("_head", head)), ["file"], ["line_no"], {"name": ("last", "_head")}).filter(~F.col("value").startswith(">"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    return rows.groupBy("file", "name").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("seq")).select("name", "seq")


def text(seq: DataFrame) -> DataFrame:
    """file, line_no, value: the projection's sequences as one file, each over two lines."""
    half = F.floor(F.length("seq") / 2).cast("int")
    parts = F.array(F.concat(F.lit(">n"), F.col("node").cast("string"), F.lit(" a node")), F.substring("seq", F.lit(1), half), F.substring("seq", half + 1, F.length("seq")))
    return seq.select(F.lit("seq").alias("file"), "node", F.posexplode(parts).alias("k", "value")).select("file", (F.col("node") * (1 << 20) + F.col("k")).alias("line_no"), "value")
