"""Lookups by node, and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import reverse_complement
from ..tables import laid_out


def stored(df: DataFrame, by: str = "node") -> DataFrame:
    """df as a written table for lookups by one column: sorted by it over all files, in small row groups with bloom filters, so a lookup reads the row groups that may hold its key."""
    return laid_out(df, by, f"by-{by}")


def node(nodes: DataFrame, n: int) -> DataFrame:
    """The row of one node; of a stored() table the filter reaches the scan."""
    return nodes.filter(F.col("node") == n).select("node", "chr", "start_pos", "end_pos")


def genes_at(nodes: DataFrame, feature: DataFrame, n: int) -> DataFrame:
    """node, fid of the features over one reference node: its own row is looked up first, and its place reaches the scan of the features (stored by start_pos)."""
    own = nodes.filter((F.col("node") == n) & (F.col("rank") == 0)).select("chr", "start_pos", "end_pos").first()  # one row at most
    if own is None:
        return feature.select(F.lit(n).cast("long").alias("node"), "fid").limit(0)
    over = (F.col("chr") == own["chr"]) & (F.col("start_pos") <= own["end_pos"]) & (F.col("end_pos") >= own["start_pos"])
    return feature.filter(over).select(F.lit(n).cast("long").alias("node"), "fid")


def sequences(nodes: DataFrame, seq: DataFrame) -> DataFrame:
    """node, seq; a node without sequence is Ns of its length."""
    return nodes.select("node", "len").join(seq.select("node", "seq"), "node", "left").select("node", F.coalesce("seq", F.repeat(F.lit("N"), F.col("len").cast("int"))).alias("seq"))


def oriented(seq: DataFrame, flipped: DataFrame) -> DataFrame:
    """node, seq with the flipped nodes reverse-complemented."""
    turned = flipped.select("node").distinct().withColumn("_f", F.lit(True))
    return seq.join(turned, "node", "left").select("node", F.when(F.col("_f"), reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"))


def sequence_store(seq: DataFrame, flipped: DataFrame, shadow: DataFrame, jumps: DataFrame) -> DataFrame:
    """node, seq of a normalised graph: flipped nodes turned, shadows (new_id, node) with their source's sequence, jumps (node, len) as Ns."""
    own = oriented(seq, flipped)
    copies = shadow.select("new_id", "node").join(own, "node").select(F.col("new_id").alias("node"), "seq")
    return own.unionByName(copies).unionByName(jumps.select("node", F.repeat(F.lit("N"), F.col("len").cast("int")).alias("seq")))
