"""Tables of nodes and edges as tab-separated text with a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mark
from .lines import fields

#: Headers of both files (fixed values).
NODE_HEADER = "#Segment\tChr\tStart\tEnd\tLen\tRefOrNot"
EDGE_HEADER = "#Source\tTarget\tOrigin1\tOrigin2"


def nodes(lines: DataFrame) -> DataFrame:
    """node, chr, start_pos, end_pos, len, rank of lines (value); headers, comments and blank lines go."""
    f = F.col("f")
    at = lambda i: f[i].cast("long")
    return fields(lines).select(at(0).alias("node"), f[1].alias("chr"), at(2).alias("start_pos"), at(3).alias("end_pos"), at(4).alias("len"), f[5].cast("int").alias("rank"))


def edges(lines: DataFrame) -> DataFrame:
    """n1, n2, mark of lines (value)."""
    f = F.col("f")
    return fields(lines).select(f[0].cast("long").alias("n1"), f[1].cast("long").alias("n2"), mark(f[2], f[3], "+").alias("mark"))


def node_text(node: DataFrame) -> DataFrame:
    """value: the header and a line for each node."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("node", "chr", "start_pos", "end_pos", "len", "rank")]
    return _headed(node, NODE_HEADER, cols)


def edge_text(edge: DataFrame) -> DataFrame:
    """value: the header and a line for each edge (n1, n2, mark)."""
    signs = [F.when(F.col("mark").isin(2, 3), "+").otherwise("-"), F.when(F.col("mark").isin(2, 4), "+").otherwise("-")]
    return _headed(edge, EDGE_HEADER, [F.col("n1").cast("string"), F.col("n2").cast("string"), *signs])


def _headed(df: DataFrame, header: str, cols: list) -> DataFrame:
    head = df.sparkSession.range(1).select(F.lit(header).alias("value"))
    return head.unionByName(df.select(F.concat_ws("\t", *cols).alias("value")))
