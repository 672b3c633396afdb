"""Coverage of nodes by assemblies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import coverage_class, saturated


def copy_number(visit: DataFrame) -> DataFrame:
    """asm, node, cov: visits, at most 65535."""
    return visit.groupBy("asm", "node").agg(saturated(F.count("*")).alias("cov"))


def fractional(step: DataFrame, min_mapq: int | None = 0) -> DataFrame:
    """asm, node, cov, cov_2dp (rounded half up in whole numbers) from steps of alignments (asm, node, len, idx, n, plen, pstart, pend, mapq).

    A path's first node is covered from pstart, its last to pend, a single one between the two, the
    others whole.  Only alignments with mapq above min_mapq count (None: all).  All pieces add up.
    """
    rows = step if min_mapq is None else step.filter(F.col("mapq") > min_mapq)
    only, first, last = F.col("n") == 1, F.col("idx") == 0, F.col("idx") == F.col("n") - 1
    bases = F.when(only, F.col("pend") - F.col("pstart")).when(first, F.col("len") - F.col("pstart")).when(last, F.col("len") + F.col("pend") - F.col("plen")).otherwise(F.col("len"))
    sums = rows.withColumn("bases", bases).groupBy("asm", "node").agg(F.sum("bases").alias("bases"), F.max("len").alias("len"))
    return sums.select("asm", "node", (F.col("bases") / F.col("len")).alias("cov"), (F.expr("(200 * bases + len) div (2 * len)").cast("double") / 100).alias("cov_2dp"))


def classes(cov: DataFrame, assemblies: DataFrame) -> DataFrame:
    """node, n_one, n_multi, is_dense (at least half of the assemblies cover it)."""
    total = assemblies.agg(F.count("*").alias("total"))
    cls = coverage_class("cov")
    per = cov.groupBy("node").agg(F.sum((cls == "one").cast("long")).alias("n_one"), F.sum((cls == "value").cast("long")).alias("n_multi"))
    dense = (F.col("n_one") + F.col("n_multi")) * 2 >= F.col("total")
    return per.join(F.broadcast(total)).select("node", "n_one", "n_multi", dense.alias("is_dense"))  # total is one row


def of_node(cov: DataFrame, assemblies: DataFrame, node: int) -> DataFrame:
    """asm, cov of every assembly at one node, 0 where it is not visited."""
    own = cov.filter(F.col("node") == node).select("asm", "cov")
    return assemblies.select("asm").join(own, "asm", "left").select("asm", F.coalesce("cov", F.lit(0)).alias("cov"))


def of_assembly(cov: DataFrame, nodes: DataFrame, asm: int) -> DataFrame:
    """node, cov of one assembly at every given node, 0 where it does not visit."""
    own = cov.filter(F.col("asm") == asm).select("node", "cov")
    return nodes.select("node").join(own, "node", "left").select("node", F.coalesce("cov", F.lit(0)).alias("cov"))


def as_maps(cov: DataFrame) -> DataFrame:
    """node, cov as a map from assembly."""
    return cov.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asm", "cov")))).alias("cov"))
