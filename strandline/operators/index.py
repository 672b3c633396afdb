"""A written index of a whole graph, from which windows are answered without reading the rest.

Every node has a home, a chunk of a reference chromosome: a reference node its own, any other that
of the reference node nearest to it along edges.  Nodes, edges, walks and coverage are stored once
an end at their nodes' homes, features in the chunks that they meet, all in folders by ``at_chr``
and ``at_chunk``.  A search starts in its window's chunks and at each level reads the homes of its
frontier alone, so it widens only when the frontier leaves for other chunks, to any depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import FOLDERS, discard, durable
from . import graph, intervals

AT = ["at_chr", "at_chunk"]
#: The home of nodes from which no reference node can be reached.
NOWHERE = ("", -1)
TABLES = {
    "nodes": "node long, chr string, len long, rank int, start_pos long, end_pos long",
    "edges": "a long, b long, n1 long, n2 long, mark int, b_chr string, b_chunk long",
    "steps": "asm long, chr string, idx long, node long, ori string, qpos long, len long",
    "coverage": "asm long, node long, cov long",
    "features": "fid long, chr string, start_pos long, end_pos long, track string, strand string, node1 long, off1 long, node2 long, off2 long",
}


def homes(edge: DataFrame, node: DataFrame, size: int = 2000) -> DataFrame:
    """node, chr, len, rank, start_pos, end_pos of every node, with its home at_chr, at_chunk."""
    own = graph.chunked(node, size).select("node", F.col("chr").alias("at_chr"), F.col("chunk").alias("at_chunk"))
    near = graph.nearest_reference(edge, node).select("node", F.col("ref_node").alias("r"))
    far = near.join(own.withColumnRenamed("node", "r"), "r").select("node", *AT)
    cols = [x.split()[0] for x in TABLES["nodes"].split(", ")]
    return node.select(*cols).join(own.unionByName(far), "node", "left").fillna({"at_chr": NOWHERE[0], "at_chunk": NOWHERE[1]})


def write(path: str, node: DataFrame, edge: DataFrame, step: DataFrame, cov: DataFrame, feature: DataFrame, size: int = 2000, most: int = FOLDERS) -> None:
    """Write all tables under ``path``: chunks of ``size`` reference nodes, one file of each table a chunk, ordered by node within it.

    Where that makes more than ``most`` chunks they are larger; what is answered does not depend on their size.
    """
    size = max(size, -(-node.filter("rank = 0").count() // most))
    n = int(node.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    home = durable(homes(edge, node, size), "homes")
    at = home.select("node", *AT)
    ends = intervals.end_nodes(feature, node).join(feature, "fid")
    met = intervals.feature_chunks(feature, graph.chunks(node, size)).select("fid", F.col("chunk").alias("at_chunk"))
    there = at.select(F.col("node").alias("b"), F.col("at_chr").alias("b_chr"), F.col("at_chunk").alias("b_chunk"))
    both = edge.select(F.col("n1").alias("a"), F.col("n2").alias("b"), "n1", "n2", "mark").unionByName(edge.select(F.col("n2").alias("a"), F.col("n1").alias("b"), "n1", "n2", "mark")).distinct()
    made = {
        "nodes": home,
        "edges": both.join(there, "b").join(at.withColumnRenamed("node", "a"), "a"),
        "steps": step.join(at, "node"),
        "coverage": cov.join(at, "node"),
        "features": ends.join(met, "fid").withColumn("at_chr", F.col("chr")),
    }
    for name, df in made.items():
        cols = [x.split() for x in TABLES[name].split(", ")]
        rows = df.select(*(F.col(c).cast(t).alias(c) for c, t in cols), F.coalesce("at_chr", F.lit("")).alias("at_chr"), F.col("at_chunk").cast("long").alias("at_chunk"))
        first = {"edges": "a", "features": "start_pos"}.get(name, "node")
        rows.repartition(n, *AT).sortWithinPartitions(*AT, first).write.partitionBy(*AT).parquet(f"{path}/{name}")
    discard(home)


class Index:
    """An index under a path; each method reads the folders that it needs and no others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str, where: list[tuple[str, int]] | None = None) -> DataFrame:
        """A table, or its rows at the given homes; the filter is on folders alone."""
        df = self.spark.read.schema(f"{TABLES[name]}, at_chr string, at_chunk long").parquet(f"{self.path}/{name}")
        return df if where is None else df.filter(_folders(where))

    def window(self, chrom: str, start: int, end: int, ex: int = graph.EXTENSION) -> DataFrame:
        """graph.window_nodes(), with each node's chunk; only one chromosome's folders are read, and positions reach the scan."""
        node = self.table("nodes").filter((F.col("at_chr") == chrom) & (F.col("rank") == 0))
        cols = graph.window_nodes(node, chrom, start, end, ex)
        return cols.join(node.select("node", *AT), "node")

    def search(self, window: DataFrame, depth: int) -> DataFrame:
        """node, depth and home of the variant nodes around a window, as graph.window_search() finds them; written.

        A level reads the edges at the homes of the level before; the homes are a list of chunks on
        the driver, as many as a view can show.
        """
        walls = window.select("node")
        inside = window.filter("cls = '0'").select("node", *AT)
        key = ["node"]
        levels = [durable(self._ahead(inside, places(inside)).join(walls, key, "left_anti").withColumn("depth", F.lit(0)), "index-search-0")]
        for level in range(depth + 1):
            where = places(levels[-1])
            if not where:
                discard(levels.pop())
                break
            ahead = self._ahead(levels[-1], where).join(walls, key, "left_anti")
            for known in levels[-2:]:
                ahead = ahead.join(known.select(key), key, "left_anti")
            levels.append(durable(ahead.withColumn("depth", F.lit(level + 1)), f"index-search-{level + 1}"))
        if not levels:
            return inside.limit(0).withColumn("depth", F.lit(0))
        return reduce(DataFrame.unionByName, levels)

    def _ahead(self, frontier: DataFrame, where: list[tuple[str, int]]) -> DataFrame:
        edges = self.table("edges", where).select("a", F.col("b").alias("_b"), "b_chr", "b_chunk")
        met = frontier.select("node").join(edges, F.col("node") == F.col("a"))
        return met.select(F.col("_b").alias("node"), F.col("b_chr").alias("at_chr"), F.col("b_chunk").alias("at_chunk")).distinct()

    def edges(self, where: list[tuple[str, int]]) -> DataFrame:
        return self.table("edges", where).select("n1", "n2", "mark").distinct()

    def features(self, where: list[tuple[str, int]]) -> DataFrame:
        """Features that meet the chunks, each once, with their end nodes."""
        return self.table("features", where).drop(*AT).dropDuplicates(["fid"])


def places(df: DataFrame) -> list[tuple[str, int]]:
    """The homes that occur, on the driver."""
    return sorted(tuple(r) for r in df.select(*AT).distinct().collect())


def _folders(where: list[tuple[str, int]]) -> Column:
    by: dict[str, list[int]] = {}
    for chrom, chunk in where:
        by.setdefault(chrom, []).append(chunk)
    each = [(F.col("at_chr") == c) & F.col("at_chunk").isin(chunks) for c, chunks in by.items()]
    return reduce(lambda a, b: a | b, each) if each else F.lit(False)
