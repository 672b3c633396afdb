"""Features on the reference axis: joins of intervals, clusters and layers.

Interval joins are equi-joins on sequence, level and bin.  An interval's own level is the finest
whose bins are as wide as it is long; a pair meets at the longer one's level, so that no join
compares all with all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import carried, ranged

#: Intervals of a group that one task places at most, unless they are one cluster.
TOGETHER = 1 << 20

#: Widths of bins by level; the last holds any sequence in one bin.
WIDTHS = [1 << k for k in (4, 8, 12, 16, 20, 24, 28, 40)]


def own_level(start: str, end: str) -> Column:
    """The finest level whose bins are as wide as the interval is long: there it is in two bins at most."""
    length, own = F.col(end) - F.col(start) + 1, F.lit(len(WIDTHS) - 1)
    for k in reversed(range(len(WIDTHS) - 1)):
        own = F.when(length <= WIDTHS[k], k).otherwise(own)
    return own


def in_bins(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each bin of ``level`` that the interval touches; one or two where the level is its own or coarser."""
    width = F.element_at(F.array(*map(F.lit, WIDTHS)), F.col("level") + 1)
    return df.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))))


def levels_used(*sides: tuple[DataFrame, str, str]) -> list[list[int]]:
    """The own levels that occur on each side: a number of bits a side, in one job."""
    rows = [df.select(F.lit(i).alias("side"), F.element_at(F.array(*(F.lit(1 << k) for k in range(len(WIDTHS)))), own_level(start, end) + 1).alias("bit")) for i, (df, start, end) in enumerate(sides)]
    bits = dict(reduce(DataFrame.unionByName, rows).groupBy("side").agg(F.bit_or("bit")).collect())
    return [[k for k in range(len(WIDTHS)) if bits.get(i, 0) >> k & 1] for i in range(len(sides))]


def candidates(feature: DataFrame, other: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """The pairs that share a bin of the longer one's level, once for each such bin: the columns of both, level, bin.

    Two disjoint equi-joins: features at their own level meet others of that level or finer ones,
    and others at their own level meet strictly finer features.  An interval is put only into
    coarser levels at which the other side has intervals of its own.  So sparse intervals meet in
    proportion to their number, whatever their lengths.
    """
    mine, theirs = levels_used((feature, "start_pos", "end_pos"), (other, "n_start", "n_end"))
    a, b = feature.withColumn("_own", own_level("start_pos", "end_pos")), other.withColumn("_own", own_level("n_start", "n_end"))
    lifted = lambda df, levels, strictly: df.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: (k > F.col("_own")) if strictly else (k >= F.col("_own")))))
    key = [*on, "level", "bin"]
    one = in_bins(a.withColumn("level", F.col("_own")), "start_pos", "end_pos").drop("_own").join(in_bins(lifted(b, mine, False), "n_start", "n_end").drop("_own"), key)
    two = in_bins(lifted(a, theirs, True), "start_pos", "end_pos").drop("_own").join(in_bins(b.withColumn("level", F.col("_own")), "n_start", "n_end").drop("_own"), key)
    return one.unionByName(two)


def overlapping(feature: DataFrame, other: DataFrame, keys: list[str], start: str = "n_start", end: str = "n_end", on: tuple[str, ...] = ("chr",)) -> DataFrame:
    """fid, on and keys of all pairs that overlap on the same sequence (``on``); ``other`` has on, keys, start, end.

    Of the bins that a pair shares, the one where the later of both starts is the pair's own, so no pair comes twice.
    """
    met = candidates(feature.select("fid", *on, "start_pos", "end_pos"), other.select(*on, *keys, F.col(start).alias("n_start"), F.col(end).alias("n_end")), on)
    width = F.element_at(F.array(*map(F.lit, WIDTHS)), F.col("level") + 1)
    once = F.floor(F.greatest("start_pos", "n_start") / width) == F.col("bin")
    return met.filter((F.col("start_pos") <= F.col("n_end")) & (F.col("end_pos") >= F.col("n_start")) & once).select("fid", *on, *keys)


def end_nodes(feature: DataFrame, node: DataFrame) -> DataFrame:
    """fid, node1, off1, node2, off2: the reference nodes in which a feature starts and ends, and how far in; null beyond the axis.

    Reference nodes do not overlap, so a place meets one at most; a node of any length is in two bins.
    """
    ref = node.filter("rank = 0").select("node", "chr", F.col("start_pos").alias("n_start"), F.col("end_pos").alias("n_end"))
    def point(pos: str, n: str, off: str) -> DataFrame:
        at = feature.select("fid", "chr", F.col(pos).alias("start_pos"), F.col(pos).alias("end_pos"))
        return candidates(at, ref, ("chr",)).filter("start_pos between n_start and n_end").select("fid", F.col("node").alias(n), (F.col("start_pos") - F.col("n_start")).alias(off))
    return feature.select("fid").join(point("start_pos", "node1", "off1"), "fid", "left").join(point("end_pos", "node2", "off2"), "fid", "left")


def gene_nodes(feature: DataFrame, node: DataFrame) -> DataFrame:
    """node, fid of every reference node and feature that overlap."""
    ref = node.filter("rank = 0").select("chr", "node", F.col("start_pos").alias("n_start"), F.col("end_pos").alias("n_end"))
    return overlapping(feature, ref, ["node"]).select("node", "fid")


def feature_chunks(feature: DataFrame, chunk: DataFrame) -> DataFrame:
    """fid, chunk of every feature and chunk that overlap."""
    return overlapping(feature, chunk, ["chunk"], "start_pos", "end_pos").select("fid", "chunk")


def gene_nodes_everywhere(feature: DataFrame, place: DataFrame) -> DataFrame:
    """asm, node, fid of every feature (asm, chr, ...) and node that overlap on the assembly's own axis; ``place`` has asm, chr, node, start_pos, end_pos."""
    own = place.select("asm", "chr", "node", F.col("start_pos").alias("n_start"), F.col("end_pos").alias("n_end"))
    return overlapping(feature, own, ["node"], on=("asm", "chr")).select("asm", "node", "fid").distinct()


def genes_kept(feature: DataFrame, place: DataFrame, reference: int) -> DataFrame:
    """asm, fid of the features that lie on any node of their assembly; the reference keeps all of its own."""
    met = gene_nodes_everywhere(feature.filter(F.col("asm") != reference), place.filter(F.col("asm") != reference))
    return met.select("asm", "fid").distinct().unionByName(feature.filter(F.col("asm") == reference).select("asm", "fid"))


def on_nodes(feature: DataFrame, node: DataFrame) -> DataFrame:
    """fid of features that overlap any reference node."""
    return gene_nodes(feature, node).select("fid").distinct()


def visible(ends: DataFrame, window: DataFrame) -> DataFrame:
    """Rows of end_nodes() with an end node inside the window, or one in the left and one in the right flank."""
    cls = window.select("node", "cls")
    both = ends.join(cls.select(F.col("node").alias("node1"), F.col("cls").alias("c1")), "node1", "left").join(cls.select(F.col("node").alias("node2"), F.col("cls").alias("c2")), "node2", "left")
    seen = (F.col("c1") == "0") | (F.col("c2") == "0") | ((F.col("c1") == "2") & (F.col("c2") == "1"))
    return both.filter(seen)


def clusters(feature: DataFrame, by: list[str]) -> DataFrame:
    """feature with its cluster (from 1): a new one begins where a start lies beyond all ends before it.

    Both steps run in ranges of the intervals, sorted once, so a chromosome of any size spreads over tasks.
    """
    part = carried(ranged(feature, [*by, "start_pos", "end_pos", "fid"]), by, ["_at"], {"_before": ("max", "end_pos")})
    new = (F.col("_before").isNull() | (F.col("start_pos") > F.col("_before"))).cast("long")
    return carried(part.withColumn("_new", new).drop("_before"), by, ["_at"], {"cluster": ("sum", "_new")}).drop("_new", "_at", "_range")


def islands(feature: DataFrame, by: list[str]) -> DataFrame:
    """by..., cluster, start_pos, end_pos, n."""
    return clusters(feature, by).groupBy(*by, "cluster").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n"))


def layers(feature: DataFrame, by: list[str], cap: int | None = None, together: int = TOGETHER) -> DataFrame:
    """by..., fid, layer: each interval in the lowest layer that is free, in the order of starts; layers above cap are left out.

    First fit is sequential by nature.  All layers are free where a cluster begins, so where a group
    has more than ``together`` intervals its clusters are placed apart, in tasks of their own, with
    the same result.  Sorted rows stream through a task and only the layers in use are held, so
    memory follows the depth.
    """
    rows, key = feature.select(*by, "fid", "start_pos", "end_pos"), list(by)
    most = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most > together:
        rows, key = clusters(rows, by), [*by, "cluster"]
    rows = rows.withColumn("_key", F.xxhash64(*key)).repartition(*key).sortWithinPartitions(*key, "start_pos", "end_pos", "fid")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, busy, free, used = None, [], [], 0
        for batch in batches:
            out = []
            for group, start, end in zip(*(batch.column(batch.num_columns - 3 + k).to_pylist() for k in range(3)), strict=True):
                if group != at:
                    at, busy, free, used = group, [], [], 0
                while busy and busy[0][0] < start:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    layer = heapq.heappop(free)
                else:
                    used += 1
                    layer = used
                heapq.heappush(busy, (end, layer))
                out.append(layer)
            own = batch.columns[: len(by) + 1]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.int32())], names=[*batch.schema.names[: len(by) + 1], "layer"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*by, "fid").dtypes)
    placed = rows.select(*by, "fid", "_key", "start_pos", "end_pos").mapInArrow(each, f"{kinds}, layer int")
    return placed if cap is None else placed.filter(F.col("layer") <= cap)


def track_layers(feature: DataFrame, scored: list[str], cap: int | None = 50) -> DataFrame:
    """track, layers, cum_layer, n: a track with scores takes one layer, others as many as they need (at most cap); layers add up over the tracks by name."""
    depth = layers(feature, ["track", "chr"], cap).groupBy("track").agg(F.max("layer").alias("depth"))
    per = feature.groupBy("track").agg(F.count("*").alias("n")).join(depth, "track")
    per = per.withColumn("layers", F.when(F.col("track").isin(scored), 1).otherwise(F.col("depth")).cast("long"))
    return per.select("track", "layers", F.sum("layers").over(W.orderBy("track")).alias("cum_layer"), "n")  # one row a track


def gene_blocks(clustered: DataFrame, placed: DataFrame, isoforms: DataFrame) -> DataFrame:
    """chr, cluster, layer, offset: a layer's block starts one above all layers before it, each of which takes its largest number of transcripts and one more."""
    rows = clustered.select("chr", "cluster", "fid").join(placed.select("fid", "layer"), "fid").join(isoforms, "fid", "left")
    most = rows.groupBy("chr", "cluster", "layer").agg(F.max(F.coalesce("n_iso", F.lit(0))).alias("m"))
    w = W.partitionBy("chr", "cluster").orderBy("layer")
    return most.select("chr", "cluster", "layer", (F.sum(F.col("m") + 1).over(w) - F.col("m")).cast("long").alias("offset"))


def ordinals(part: DataFrame, by: list[str]) -> DataFrame:
    """by..., fid, num: place of an exon in its transcript."""
    return part.select(*by, "fid", F.row_number().over(W.partitionBy(*by).orderBy("start_pos", "end_pos", "fid")).cast("long").alias("num"))


def first_isoforms(child: DataFrame, cap: int = 20) -> DataFrame:
    """Children (gene, parent, line_no) of the first ``cap`` transcripts of each gene, in the order in which they appear."""
    seen = child.withColumn("_f", F.min("line_no").over(W.partitionBy("gene", "parent")))
    return seen.withColumn("_r", F.dense_rank().over(W.partitionBy("gene").orderBy("_f"))).filter(F.col("_r") <= cap).drop("_f", "_r")


def model_counts(model: DataFrame) -> DataFrame:
    """gene, parent, exons, cds: parts of each transcript by kind."""
    return model.groupBy("gene", "parent").agg(F.count_if(F.col("type") == "exon").alias("exons"), F.count_if(F.col("type") == "CDS").alias("cds"))


def truncated(exon: DataFrame) -> DataFrame:
    """transcript, flag: '2' where the first visible exon is not exon 1, else '0'."""
    return exon.groupBy("transcript").agg(F.when(F.min_by("num", "start_pos") != 1, "2").otherwise("0").alias("flag"))
