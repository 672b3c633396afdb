"""Chains of a graph folded into weighted edges, so that long searches follow branching and not length.

An inner node is a variant node with exactly two neighbours; a hub is any other.  From every arc
(a to b) one can only go on while b is inner.  Where that ends is found by doubling: an arc's end
after 2n steps is the end after n steps of its end after n steps, so a chain of 400 nodes takes
nine rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, durable
from .graph import adjacency


def inner_nodes(arc: DataFrame, node: DataFrame) -> DataFrame:
    """node of every variant node with two neighbours; ``arc`` (a, b) runs both ways."""
    return arc.filter("a <> b").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).filter("n = 2").join(node.filter("rank <> 0").select("node"), "node", "left_semi").select("node")


def folded(arc: DataFrame, inner: DataFrame) -> DataFrame:
    """a, b, end, steps: where each arc (a to b) comes out at a hub, and after how many edges; written. Arcs into rings and out of loops have none."""
    arcs = arc.filter("a <> b").join(inner.select(F.col("node").alias("b"), F.lit(True).alias("_in")), "b", "left").select("a", "b", F.coalesce("_in", F.lit(False)).alias("going"))
    arcs = durable(arcs, "chain-arcs")
    ahead = arcs.select(F.col("a").alias("b"), F.col("b").alias("_c"), F.col("going").alias("_going"))
    # (x, y) is the last arc of the way so far; an inner b has one way on besides the way back
    first = arcs.filter("going").join(ahead, "b").filter("_c <> a").select("a", "b", F.col("b").alias("x"), F.col("_c").alias("y"), F.lit(2).cast("long").alias("steps"), F.col("_going").alias("going"))
    done = [durable(arcs.filter("not going").select("a", "b", F.col("b").alias("end"), F.lit(1).cast("long").alias("steps")), "chains-0")]
    state = durable(first, "chain-state")
    for k in range(inner.count().bit_length() + 1):  # no chain has more nodes; what goes on is a ring
        ended = state.filter("not going").select("a", "b", F.col("y").alias("end"), "steps")
        done.append(durable(ended, f"chains-{k + 1}"))
        on = state.filter("going")
        if on.isEmpty():
            break
        # the way goes on with what is known of its last arc; that counts the arc itself once more
        known = state.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("steps").alias("_s"), F.col("going").alias("_g"))
        for df in done[1:-1]:  # of arcs that ended in earlier rounds only the ends matter
            known = known.unionByName(df.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(None).cast("long").alias("_x"), F.col("end").alias("_y"), F.col("steps").alias("_s"), F.lit(False).alias("_g")))
        now = on.join(known, ["x", "y"]).select("a", "b", F.col("_x").alias("x"), F.col("_y").alias("y"), (F.col("steps") + F.col("_s") - 1).alias("steps"), F.col("_g").alias("going"))
        before, state = state, durable(now, "chain-state")
        discard(before)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    result = durable(out, "chains")
    for df in (*done, arcs, state):
        discard(df)
    return result


def nearest_reference(edge: DataFrame, node: DataFrame, depth: int = 500) -> DataFrame:
    """graph.nearest_reference() by folded chains: node, ref_node, dist; a round for each branching on the way, not for each node."""
    arc = adjacency(edge)
    inner = durable(inner_nodes(arc, node), "inner")
    ways = folded(arc, inner)
    hubs = durable(ways.join(inner.withColumnRenamed("node", "a"), "a", "left_anti").groupBy("a", F.col("end").alias("e")).agg(F.min("steps").alias("w")), "hub-edges")
    ref = node.filter("rank = 0").select("node")
    # the best (dist, ref_node) of each hub; a round relaxes the edges of the hubs that it has bettered
    best = durable(ref.select("node", F.struct(F.lit(0).cast("long").alias("dist"), F.col("node").alias("ref_node")).alias("d"), F.lit(True).alias("new")), "nearest-hubs")
    while not best.filter("new").isEmpty():
        step = best.filter("new").join(hubs, F.col("node") == F.col("a")).select(F.col("e").alias("node"), F.struct((F.col("d.dist") + F.col("w")).alias("dist"), F.col("d.ref_node").alias("ref_node")).alias("d"), F.lit(True).alias("new"))
        step = step.filter(F.col("d.dist") <= depth).join(ref, "node", "left_anti")
        both = best.withColumn("new", F.lit(False)).unionByName(step).groupBy("node").agg(F.min("d").alias("d"), F.min(F.when(~F.col("new"), F.col("d"))).alias("o"))
        before, best = best, durable(both.select("node", "d", (F.col("o").isNull() | (F.col("d") < F.col("o"))).alias("new")), "nearest-hubs")
        discard(before)
    far = ways.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").join(best.select(F.col("node").alias("end"), "d"), "end")
    far = far.groupBy(F.col("a").alias("node")).agg(F.min(F.struct((F.col("d.dist") + F.col("steps")).alias("dist"), F.col("d.ref_node").alias("ref_node"))).alias("d"))
    out = best.filter("d.dist > 0").select("node", "d").unionByName(far).filter(F.col("d.dist") <= depth)
    result = durable(out.select("node", "d.ref_node", F.col("d.dist").cast("int").alias("dist")), "nearest")
    for df in (arc, inner, ways, hubs, best):
        discard(df)
    return result
