"""From a graph as written to one along the reference: flips, shadows, jumps, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import canonical, mark
from ..tables import durable, running
from .graph import edges_of_steps, flipped_edges


def unvisited(node: DataFrame, step: DataFrame) -> DataFrame:
    """Nodes on no path."""
    return node.join(step.select("node").distinct(), "node", "left_anti")


def edges_off_reference(edge: DataFrame, reference_step: DataFrame, path: list[str]) -> DataFrame:
    """Edges that the reference's paths do not run along, in either direction."""
    along = edges_of_steps(reference_step, path).select(canonical("n1", "n2", "mark").alias("_e"))
    return edge.withColumn("_e", canonical("n1", "n2", "mark")).join(along, "_e", "left_anti").select(edge.columns)


def jumps_off_reference(jump: DataFrame, reference_step: DataFrame, path: list[str]) -> DataFrame:
    """Jumps (n1, sign1, n2, sign2, ...) between nodes that do not follow each other on the reference's paths, in either direction."""
    along = edges_of_steps(reference_step, path).select(canonical("n1", "n2", "mark").alias("_e"))
    own = canonical("n1", "n2", mark("sign1", "sign2"))
    return jump.withColumn("_e", own).join(along, "_e", "left_anti").select(jump.columns)


def _next_ids(rows: DataFrame, node: DataFrame, order: list[str], name: str) -> DataFrame:
    """Ids above the largest node in the given order, counted in ranges."""
    top = node.agg(F.coalesce(F.max("node"), F.lit(0)).alias("_top"))
    counted = running(rows, [], order, {"_n": ("count", "")})
    return counted.join(F.broadcast(top)).withColumn(name, F.col("_top") + F.col("_n")).drop("_top", "_n")  # top is one row


def shadows(visit: DataFrame, node: DataFrame, path: str = "path_id") -> DataFrame:
    """path, idx, node, new_id: every further visit of a node on the reference's paths gets an id of its own."""
    w = W.partitionBy("node").orderBy(path, "idx")
    again = visit.select(path, "idx", "node", F.row_number().over(w).alias("_n")).filter("_n > 1").drop("_n")
    return _next_ids(again, node, [path, "idx"], "new_id")


def shadow_edges(visit: DataFrame, shadow: DataFrame, path: str = "path_id") -> DataFrame:
    """n1, n2, mark (2): from the predecessor on the path (itself perhaps a shadow) to each shadow; a path's first step has none."""
    w = W.partitionBy(path).orderBy("idx")
    own = visit.join(shadow.select(path, "idx", "new_id"), [path, "idx"], "left").withColumn("at", F.coalesce("new_id", "node"))
    return own.withColumn("n1", F.lag("at").over(w)).filter("new_id is not null and n1 is not null").select("n1", F.col("new_id").alias("n2"), F.lit(2).alias("mark"))


def flips(reference_step: DataFrame) -> DataFrame:
    """node: reference nodes whose first visit is backwards."""
    w = W.partitionBy("node").orderBy("path_id", "idx")
    return reference_step.withColumn("_n", F.row_number().over(w)).filter("_n = 1 and ori = '<'").select("node")


def first_backwards(visit: DataFrame) -> DataFrame:
    """node: nodes that the first assembly (a number) to visit them visits backwards; of two visits of one assembly a forward one counts.

    Assembly and direction are one number, whose least is kept by hash: text beside a least value would be sorted, all visits of a task at once.
    """
    first = visit.groupBy("node").agg(F.min(F.col("asm") * 2 + (F.col("ori") == "<").cast("long")).alias("_f"))
    return first.filter(F.col("_f") % 2 == 1).select("node")


def flipped_steps(step: DataFrame, flipped: DataFrame) -> DataFrame:
    """Steps with the orientation on flipped nodes turned round."""
    turned = flipped.select("node").distinct().withColumn("_f", F.lit(True))
    rows = step.join(turned, "node", "left")
    return rows.withColumn("ori", F.when(F.col("_f").isNull(), F.col("ori")).when(F.col("ori") == ">", "<").otherwise(">")).drop("_f").select(step.columns)


def reference_nodes(reference_step: DataFrame, walk_start: str = "walk_start") -> DataFrame:
    """node, chr, start_pos, end_pos, len: the first visit of each node on the reference's walks, by running length from the walk's start (0-based)."""
    w = W.partitionBy("path_id").orderBy("idx")
    at = reference_step.withColumn("end_pos", F.col(walk_start) + F.sum("len").over(w)).withColumn("start_pos", F.col("end_pos") - F.col("len") + 1)
    first = W.partitionBy("node").orderBy("path_id", "idx")
    return at.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("node", "chr", "start_pos", "end_pos", "len")


def variant_nodes(step: DataFrame, reference: DataFrame) -> DataFrame:
    """node, asm, chr, start_pos, end_pos, len: nodes off the reference, owned by the first path (by assembly, path, step) that visits them, placed on that path."""
    w = W.partitionBy("asm", "path_id").orderBy("idx")
    at = step.withColumn("end_pos", F.col("walk_start") + F.sum("len").over(w)).withColumn("start_pos", F.col("end_pos") - F.col("len") + 1)
    off = at.join(reference.select("node"), "node", "left_anti")
    first = W.partitionBy("node").orderBy("asm", "path_id", "idx")
    return off.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("node", "asm", "chr", "start_pos", "end_pos", "len")


def jump_nodes(jump: DataFrame, node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of jumps (n1, sign1, n2, sign2, distance): a node of the distance's length between two edges; ids in the order of the jumps' ends."""
    ids = _next_ids(jump, node, ["n1", "n2", "sign1", "sign2", "distance"], "node")
    nodes = ids.select("node", F.col("distance").alias("len"))
    into = ids.select("n1", F.col("node").alias("n2"), F.when(F.col("sign1") == "+", 2).otherwise(4).alias("mark"))
    out = ids.select(F.col("node").alias("n1"), "n2", F.when(F.col("sign2") == "+", 2).otherwise(3).alias("mark"))
    return nodes, into.unionByName(out)


def normalised_edges(edge: DataFrame, flipped: DataFrame) -> DataFrame:
    """Edges with flipped nodes turned: n1, n2, sign1, sign2."""
    return flipped_edges(edge, flipped)


def imported(segment: DataFrame, link: DataFrame, step: DataFrame, reference: str, jump: DataFrame | None = None) -> dict[str, DataFrame]:
    """A graph as written, on the reference's axis, as the tables ``node``, ``edge``, ``step`` and ``shadow``.

    segment: node, len.  link: n1, n2, mark.  step: asm, path_id, chr, walk_start, idx, node, ori,
    of all walks.  jump: gfa.jumps().  ``reference`` is the assembly that gives the axis.

    node: node, asm, chr, start_pos, end_pos, len, rank: those on the reference (rank 0) by its
    walks; the others (rank 1) on the first walk that visits them; jumps and nodes on no walk have
    no position (asm, chr null; rank 1).  edge: n1, n2, sign1, sign2 with nodes that the reference
    first visits backwards turned round, edges into shadows and those of jumps that the reference
    does not make.  step: turned likewise.  shadow: path_id, idx, node, new_id of the reference's
    repeated visits.
    """
    step = durable(step.join(segment.select("node", "len"), "node"), "import-steps")
    own = step.filter(F.col("asm") == reference)
    turned = durable(flips(own), "import-flips")
    ref = durable(reference_nodes(own), "import-reference")
    shadow = shadows(own, segment)
    shadow = durable(shadow, "import-shadows")
    other = variant_nodes(step.filter(F.col("asm") != reference), ref)
    none = lambda kind: F.lit(None).cast(kind)
    cols = ["node", "asm", "chr", "start_pos", "end_pos", "len", "rank"]
    nodes = ref.withColumns({"asm": F.lit(reference), "rank": F.lit(0)}).select(cols).unionByName(other.withColumn("rank", F.lit(1)).select(cols))
    lost = unvisited(segment.select("node", "len"), step)
    edges = normalised_edges(link, turned)
    into = shadow_edges(own.select("path_id", "idx", "node"), shadow)
    edges = edges.unionByName(into.select("n1", "n2", F.lit("+").alias("sign1"), F.lit("+").alias("sign2")))
    if jump is not None:
        apart = jumps_off_reference(jump, own.withColumn("chr", F.col("path_id").cast("string")), ["path_id"])
        top = segment.select("node").unionByName(shadow.select(F.col("new_id").alias("node")))
        made, joined = jump_nodes(apart, top)
        lost = lost.unionByName(made)
        edges = edges.unionByName(normalised_edges(joined, turned))
    nodes = nodes.unionByName(lost.select("node", none("string").alias("asm"), none("string").alias("chr"), none("long").alias("start_pos"), none("long").alias("end_pos"), "len", F.lit(1).alias("rank")))
    return {"node": nodes, "edge": edges, "step": flipped_steps(step, turned), "shadow": shadow}
