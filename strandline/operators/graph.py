"""Nodes, edges and their neighbourhood: windows, extents, edge identity, bounded search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import canonical, mark, signs
from ..tables import bucketed, carried, discard, durable, ranged

#: How far beyond a window reference nodes still bound a search.
EXTENSION = 1_000_000


def window_nodes(node: DataFrame, chrom: str, start: int, end: int, ex: int = EXTENSION) -> DataFrame:
    """Reference nodes near chrom:start-end with cls '0' (inside), '2' (left flank), '1' (right flank)."""
    near = node.filter((F.col("rank") == 0) & (F.col("chr") == chrom) & (F.col("end_pos") >= max(start - ex, 1)) & (F.col("start_pos") <= end + ex))
    cls = F.when(F.col("end_pos") < start, "2").when(F.col("start_pos") > end, "1").otherwise("0")
    return near.select("node", "start_pos", "end_pos", "len", cls.alias("cls"))


def default_window(node: DataFrame, length: int = 10_000) -> DataFrame:
    """One row chr, start_pos, end_pos: what is shown first, the beginning of the first chromosome by name."""
    first = node.filter("rank = 0").agg(F.min("chr").alias("chr")).filter("chr is not null")
    return first.select("chr", F.lit(1).cast("long").alias("start_pos"), F.lit(length).cast("long").alias("end_pos"))


def on_chromosomes(node: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes on the listed chromosomes (column chr)."""
    return node.join(names.select("chr"), "chr", "left_semi")


def extents(node: DataFrame) -> DataFrame:
    """First start and last end of each reference chromosome."""
    return node.filter("rank = 0").groupBy("chr").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))


def ordinals(df: DataFrame, name: Column, first: Column) -> DataFrame:
    """Distinct names with the ordinal of their first appearance (ties by name), from 0. A dimension: one row a name."""
    each = df.select(name.alias("name"), first.alias("_f")).distinct()  # by hash; to take the least text of a group at once sorts all its rows
    seen = each.withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy(F.asc_nulls_last("_f")))).filter("_n = 1")
    return seen.select("name", (F.row_number().over(W.orderBy("_f", "name")).cast("long") - 1).alias("ordinal"))


def edges_of_steps(step: DataFrame, path: list[str]) -> DataFrame:
    """Distinct edges between consecutive steps of each path."""
    w = W.partitionBy(*path).orderBy("idx")
    pairs = step.select(F.lag("node").over(w).alias("n1"), F.lag("ori").over(w).alias("o1"), F.col("node").alias("n2"), F.col("ori").alias("o2"))
    return pairs.filter("n1 is not null").select("n1", "n2", mark("o1", "o2", ">").alias("mark")).distinct()


def distinct_edges(edge: DataFrame) -> DataFrame:
    """Each edge once, an edge and its reverse being the same."""
    return edge.select(canonical("n1", "n2", "mark").alias("e")).select("e.*").distinct()


def flipped_edges(edge: DataFrame, flipped: DataFrame) -> DataFrame:
    """n1, n2, sign1, sign2 once the flipped nodes (column node) are turned round."""
    turned = flipped.select("node").distinct().withColumn("f", F.lit(True))
    a, b = turned.select(F.col("node").alias("n1"), F.col("f").alias("f1")), turned.select(F.col("node").alias("n2"), F.col("f").alias("f2"))
    return edge.join(a, "n1", "left").join(b, "n2", "left").select("n1", "n2", signs("mark", "f1", "f2").alias("s")).select("n1", "n2", "s.sign1", "s.sign2")


def edges_without(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes."""
    return edge.join(nodes.select(F.col("node").alias("n1")), "n1", "left_anti").join(nodes.select(F.col("node").alias("n2")), "n2", "left_anti").select("n1", "n2", "mark")


def edges_touching(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch any of the nodes, each once."""
    a = edge.join(nodes.select(F.col("node").alias("n1")), "n1", "left_semi").select("n1", "n2", "mark")
    b = edge.join(nodes.select(F.col("node").alias("n2")), "n2", "left_semi").select("n1", "n2", "mark")
    return a.unionByName(b).distinct()


def adjacency(edge: DataFrame, drop: DataFrame | None = None, place: DataFrame | None = None) -> DataFrame:
    """a, b for both directions of every edge, without those that enter ``drop`` (node), with what ``place`` (b, ...) tells of b: written in buckets by a, for discard()."""
    both = edge.select(F.col("n1").alias("a"), F.col("n2").alias("b")).unionByName(edge.select(F.col("n2").alias("a"), F.col("n1").alias("b")))
    if drop is not None:
        both = both.join(drop.select(F.col("node").alias("b")), "b", "left_anti")
    both = both.select("a", "b") if place is None else both.join(place, "b", "left").select("a", "b", *(c for c in place.columns if c != "b"))
    n = int(edge.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(both.repartition(n, "a").distinct(), "a", "adjacency")


def fresh(ahead: DataFrame, known: list[DataFrame], key: list[str], *least: str) -> DataFrame:
    """key and the least of some columns of the rows of ``ahead`` whose key none of ``known`` holds: one aggregation in place of a distinct and anti joins."""
    none = [F.lit(None).cast(t).alias(c) for c, t in ahead.select(*least).dtypes]
    both = ahead.select(*key, *least, F.lit(False).alias("_k"))
    for df in known:
        both = both.unionByName(df.select(*key, *none, F.lit(True).alias("_k")))
    return both.groupBy(*key).agg(F.bool_or("_k").alias("_k"), *(F.min(c).alias(c) for c in least)).filter(~F.col("_k")).drop("_k")


def search(adjacent: DataFrame, seeds: DataFrame, wall: Column | None, depth: int, by: list[str] | None = None) -> DataFrame:
    """Breadth-first from all seeds at once: by..., node, depth (the least).

    Seeds (by..., node) have depth 0; a node is left by its edges when its depth is at most
    ``depth``, so depth + 1 is reached.  A step for which ``wall`` (of by and adjacency's columns)
    holds is not taken; None where there are no walls.  ``adjacent`` is of adjacency(): bucketed by
    a, so a level moves its frontier alone.  It runs both ways, so what a level reaches lies on the
    level before, on its own or on the next, and only two levels need be known to find the new ones.
    Every level is a join, written before the next one, and the search stops at the first empty
    level.  The frontier of searches by a key may be as large as the graph, whatever the size of its
    file, so it is not broadcast.
    """
    by = by or []
    key = [*by, "node"]
    levels = [durable(seeds.select(key).distinct().withColumn("depth", F.lit(0)), "search-0")]
    for level in range(depth + 1):
        ahead = (levels[-1].hint("merge") if by else levels[-1]).join(adjacent, F.col("node") == F.col("a"))
        ahead = (ahead if wall is None else ahead.filter(~wall)).select(*by, F.col("b").alias("node"))
        levels.append(durable(fresh(ahead, levels[-2:], key).withColumn("depth", F.lit(level + 1)), f"search-{level + 1}"))
        if levels[-1].isEmpty():
            discard(levels.pop())
            break
    return reduce(DataFrame.unionByName, levels)


def window_search(edge: DataFrame, window: DataFrame, depth: int) -> DataFrame:
    """node, depth of the variant nodes around a window (window_nodes())."""
    # the walls are the same for all, so they leave the adjacency: once as ends, and as starts but for the seeds
    adjacent = adjacency(edge, window)
    inside = window.filter("cls = '0'").select(F.col("node").alias("a"))
    out = search(adjacent, adjacent.join(inside, "a", "left_semi").select(F.col("b").alias("node")), None, depth)
    discard(adjacent)
    return out


def chromosome_edges(edge: DataFrame, node: DataFrame, window: DataFrame) -> DataFrame:
    """The edges a search may use that must not cross into other chromosomes: those without a reference node, and those at the window's nodes."""
    free = edges_without(edge, node.filter("rank = 0").select("node"))
    return free.unionByName(edges_touching(edge, window.select("node"))).distinct()


def subgraph_edges(edge: DataFrame, window: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """Edges among the nodes inside the window and the nodes found, one end being left by its edges."""
    shown = window.filter("cls = '0'").select("node", F.lit(True).alias("open")).unionByName(found.select("node", (F.col("depth") <= depth).alias("open")))
    a, b = shown.select(F.col("node").alias("n1"), F.col("open").alias("o1")), shown.select(F.col("node").alias("n2"), F.col("open").alias("o2"))
    return edge.join(a, "n1").join(b, "n2").filter("o1 or o2").select("n1", "n2", "mark").distinct()


def chunked(node: DataFrame, size: int = 2000) -> DataFrame:
    """Reference nodes with their chunk: every ``size`` nodes of a chromosome by position, counted in ranges of the sorted nodes."""
    part = ranged(node.filter("rank = 0"), ["chr", "start_pos", "node"])
    return carried(part, ["chr"], ["_at"], {"chunk": ("count", "")}).withColumn("chunk", F.floor((F.col("chunk") - 1) / size).cast("long")).drop("_at", "_range")


def chunks(node: DataFrame, size: int = 2000) -> DataFrame:
    """chr, chunk, start_pos, end_pos, n."""
    return chunked(node, size).groupBy("chr", "chunk").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n"))


def search_chunks(edge: DataFrame, node: DataFrame, size: int, depth: int, ex: int = EXTENSION, nocross: bool = False) -> DataFrame:
    """chr, chunk, node: the search around every chunk, all chunks at once.

    With ``nocross`` a search leaves its chunk by any edge and then runs along edges without a
    reference node only, so it cannot come out on another chromosome.
    """
    # walls are the reference nodes of the chromosome within ex of a chunk: every step of the adjacency knows the place that it enters and
    # every search the extent of its chunk, so they are told row by row and never listed (a list would hold a stretch of the axis a chunk)
    whole = W.partitionBy("chr", "chunk")
    own = chunked(node, size).select("chr", "chunk", "node", F.min("start_pos").over(whole).alias("lo"), F.max("end_pos").over(whole).alias("hi"))
    place = node.filter("rank = 0").select(F.col("node").alias("b"), F.col("chr").alias("b_chr"), F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    wall = F.coalesce((F.col("b_chr") == F.col("chr")) & (F.col("b_end") >= F.col("lo") - ex) & (F.col("b_start") <= F.col("hi") + ex), F.lit(False))
    by = ["chr", "chunk", "lo", "hi"]
    first = adjacency(edge, None, place)
    seeds = own.withColumnRenamed("node", "a").hint("merge").join(first, "a").filter(~wall).select(*by, F.col("b").alias("node"))
    adjacent = adjacency(edges_without(edge, node.filter("rank = 0").select("node")), None, place) if nocross else first
    out = search(adjacent, seeds, wall, depth, by).select("chr", "chunk", "node")
    for table in (first, *([adjacent] if nocross else [])):
        discard(table)
    return out


def nearest_reference(edge: DataFrame, node: DataFrame, depth: int = 500) -> DataFrame:
    """node, ref_node, dist of every variant node from which a reference node can be reached by variant nodes; the least id of the nearest."""
    adjacent = adjacency(edge, node.filter("rank = 0"))
    levels = [durable(node.filter("rank = 0").select("node", F.col("node").alias("ref_node"), F.lit(0).alias("dist")), "nearest-0")]
    for level in range(1, depth + 1):
        ahead = levels[-1].join(adjacent, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "ref_node")
        ahead = fresh(ahead, levels[-2:], ["node"], "ref_node")  # as in search(): no older level can be met
        levels.append(durable(ahead.select("node", "ref_node", F.lit(level).alias("dist")), f"nearest-{level}"))
        if levels[-1].isEmpty():
            discard(levels.pop())
            break
    discard(adjacent)
    return reduce(DataFrame.unionByName, levels).filter("dist > 0")
