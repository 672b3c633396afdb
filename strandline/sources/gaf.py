"""Alignments to a graph (GAF)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lines import fields


def records(lines: DataFrame, min_mapq: int | None = None) -> DataFrame:
    """qname, qstart, path, plen, pstart, pend, mapq, cigar (tag cg, found by name); only mapq above min_mapq if given."""
    f = F.col("f")
    cigar = F.get(F.filter("f", lambda x: x.startswith("cg:Z:")), F.lit(0)).substr(F.lit(6), F.lit(1 << 30))
    keep = [c for c in ("line_no", "file") if c in lines.columns]
    out = fields(lines).select(f[0].alias("qname"), *[f[i].cast("long").alias(n) for i, n in ((2, "qstart"),)], f[5].alias("path"), *[f[i].cast("long").alias(n) for i, n in ((6, "plen"), (7, "pstart"), (8, "pend"), (11, "mapq"))], cigar.alias("cigar"), *keep)
    return out if min_mapq is None else out.filter(F.col("mapq") > min_mapq)


def sorted_paths(rows: DataFrame) -> DataFrame:
    """Of alignments of one query that start at the same place, the last line; with their place in the query's order."""
    last = W.partitionBy("qname", "qstart").orderBy(F.col("line_no").desc())
    kept = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("qname").orderBy("qstart")) - 1)


def text(aln: DataFrame) -> DataFrame:
    """Lines of the projection's alignments."""
    path = F.concat(F.lit(">s"), F.col("node1").cast("string"), F.coalesce(F.concat(F.lit(">s"), F.col("node2").cast("string")), F.lit("")))
    span = (F.col("pend") - F.col("pstart")).cast("string")
    cols = [F.col("qname"), span, F.lit("0"), span, F.lit("+"), path, F.col("plen"), F.col("pstart"), F.col("pend"), span, span, F.col("mapq"), F.lit("tp:A:P"), F.concat(F.lit("cg:Z:"), span, F.lit("M"))]
    return aln.select(F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value"))
