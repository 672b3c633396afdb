"""Hiding small variants and plain reference nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import discard, durable
from .graph import adjacency, fresh, search


def skips(edge: DataFrame, window: DataFrame, below: int) -> DataFrame:
    """n1, n2, mark, skipped_len: edges between reference nodes inside the window that only leave out fewer than ``below`` bases in reading order."""
    ref = window.filter("cls = '0'")
    a = ref.select(F.col("node").alias("n1"), F.col("start_pos").alias("s1"), F.col("end_pos").alias("e1"))
    b = ref.select(F.col("node").alias("n2"), F.col("start_pos").alias("s2"), F.col("end_pos").alias("e2"))
    both = edge.join(a, "n1").join(b, "n2")
    ahead = F.col("s2") > F.col("s1")
    gap = F.when(ahead, F.col("s2") - F.col("e1") - 1).otherwise(F.col("s1") - F.col("e2") - 1)
    plain = (ahead & (F.col("mark") == 2)) | (~ahead & (F.col("mark") == 5))
    return both.withColumn("skipped_len", gap).filter(plain & (F.col("skipped_len") < below)).select("n1", "n2", "mark", "skipped_len")


def bubbles(edge: DataFrame, window: DataFrame, depth: int, node: DataFrame | None = None, below: int | None = None) -> DataFrame:
    """seed_ref, node, depth: variant nodes reached from the out-edges of each reference node inside the window.

    With ``node`` (node, len) and ``below``, a bubble has a running size, its longest node of every
    level added up, and a seed whose size is ``below`` or more leaves the search there and then: it
    is not in the result, and the next level does not see it.
    """
    out = edge.join(window.filter("cls = '0'").select(F.col("node").alias("n1")), "n1").select(F.col("n1").alias("seed_ref"), F.col("n2").alias("node"))
    seeds = out.join(window.select("node"), "node", "left_anti").distinct()
    adjacent = adjacency(edge, window)
    if below is None:
        found = search(adjacent, durable(seeds, "bubble-seeds"), None, depth, ["seed_ref"])
        discard(adjacent)
        return found
    key = ["seed_ref", "node"]

    def sized(reached: DataFrame, sizes: DataFrame | None, level: int) -> tuple[DataFrame, DataFrame]:
        """The level of the seeds that are still small, and their sizes with it."""
        long = reached.join(node.select("node", "len"), "node").groupBy("seed_ref").agg(F.max("len").alias("size"))
        if sizes is not None:
            long = long.join(sizes.withColumnRenamed("size", "_s"), "seed_ref").withColumn("size", F.col("size") + F.col("_s")).drop("_s")
        small = durable(long.filter(F.col("size") < below), f"bubble-sizes-{level}")
        return durable(reached.join(small.select("seed_ref"), "seed_ref", "left_semi").withColumn("depth", F.lit(level)), f"bubble-{level}"), small

    level, sizes = sized(seeds, None, 0)
    levels, ended = [level], []
    for k in range(1, depth + 2):
        ahead = levels[-1].join(adjacent, F.col("node") == F.col("a")).select("seed_ref", F.col("b").alias("node"))
        ahead = durable(fresh(ahead, levels[-2:], key), f"bubble-ahead-{k}")
        if ahead.isEmpty():
            discard(ahead)
            break
        ended.append(sizes.join(ahead.select("seed_ref").distinct(), "seed_ref", "left_anti"))
        level, sizes = sized(ahead, sizes, k)
        levels.append(level)
    discard(adjacent)
    # a seed stayed small if it ended so, or is small at the last level
    kept = reduce(DataFrame.unionByName, [*ended, sizes]).select("seed_ref")
    return reduce(DataFrame.unionByName, levels).join(kept, "seed_ref", "left_semi").select("seed_ref", "node", "depth")


def bubble_sizes(found: DataFrame, node: DataFrame) -> DataFrame:
    """seed_ref, size: the longest node of every level, added up."""
    longest = found.join(node.select("node", "len"), "node").groupBy("seed_ref", "depth").agg(F.max("len").alias("m"))
    return longest.groupBy("seed_ref").agg(F.sum("m").alias("size"))


def collapsed(edge: DataFrame, node: DataFrame, window: DataFrame, depth: int, below: int) -> DataFrame:
    """node: variant nodes of bubbles whose size and skipped reference are both below ``below``.

    A bubble hangs on a reference node; it must land on a reference node to the left (leaving
    from the minus side) or to the right (leaving from the plus side), and not run inverted.
    Dead ends stay.
    """
    ref = window.filter("cls = '0'").select("node", "start_pos", "end_pos", (F.row_number().over(W.orderBy("start_pos")) - 1).alias("pos"))  # the window's nodes
    found = durable(bubbles(edge, window, depth, node, below), "small-bubbles")
    seed_mark = edge.select(F.col("n1").alias("seed_ref"), F.col("n2").alias("node"), F.col("mark").alias("seed_mark")).join(found.filter("depth = 0"), ["seed_ref", "node"], "left_semi")
    sides = seed_mark.groupBy("seed_ref").agg(F.min("seed_mark").alias("least"), F.max("seed_mark").alias("most"))
    inside = found.filter(F.col("depth") <= depth)
    to = inside.join(edge.select(F.col("n1").alias("node"), F.col("n2").alias("land"), "mark"), "node").withColumn("way", F.lit("o"))
    back = inside.join(edge.select(F.col("n2").alias("node"), F.col("n1").alias("land"), "mark"), "node").withColumn("way", F.lit("i"))
    at = ref.select(F.col("node").alias("land"), F.col("pos").alias("q"), F.col("start_pos").alias("qs"), F.col("end_pos").alias("qe"))
    own = ref.select(F.col("node").alias("seed_ref"), F.col("pos").alias("p"), F.col("start_pos").alias("ps"), F.col("end_pos").alias("pe"))
    landed = to.unionByName(back).join(at, "land").join(own, "seed_ref").join(sides, "seed_ref")
    place = F.struct("q", "qs", "qe", "mark", "way")
    arms = landed.groupBy("seed_ref", "p", "ps", "pe", "least", "most").agg(F.min(F.when(F.col("q") < F.col("p"), place)).alias("l"), F.max(F.when(F.col("q") > F.col("p"), place)).alias("r"))
    left_in = F.when(F.col("l.way") == "o", F.col("l.mark").isin(2, 4)).otherwise(F.col("l.mark").isin(4, 5))
    right_in = F.when(F.col("r.way") == "o", F.col("r.mark").isin(3, 5)).otherwise(F.col("r.mark").isin(2, 3))
    left_len = F.col("ps") - F.when(left_in, F.col("l.qs")).otherwise(F.col("l.qe") + 1)
    right_len = F.when(right_in, F.col("r.qe")).otherwise(F.col("r.qs") - 1) - F.col("pe")
    left_ok = F.col("l").isNull() | ((F.col("most") >= 4) & (left_len < below))
    right_ok = F.col("r").isNull() | ((F.col("least") < 4) & (right_len < below))
    hidden = arms.filter((F.col("l").isNotNull() | F.col("r").isNotNull()) & left_ok & right_ok).select("seed_ref")
    return found.join(hidden, "seed_ref", "left_semi").select("node").distinct()


def reference_kept(edge: DataFrame, window: DataFrame, below: int, hidden: DataFrame | None = None) -> DataFrame:
    """node, kept of the reference nodes inside the window once plain ones are left out.

    Kept are the first and the last, those with an edge that survives (to a variant node that is not
    hidden, or to a reference node by more than a small skip), and one without any variant edge that
    follows a node kept for its edges.
    """
    ref = window.filter("cls = '0'").select("node", "start_pos")
    both = edge.select(F.col("n1").alias("node"), F.col("n2").alias("other"), "n1", "n2", "mark").unionByName(edge.select(F.col("n2").alias("node"), F.col("n1").alias("other"), "n1", "n2", "mark")).join(ref.select("node"), "node", "left_semi")
    cls = window.select(F.col("node").alias("other"), "cls")
    gone = skips(edge, window, below).select("n1", "n2", "mark").withColumn("skip", F.lit(True))
    seen = both.join(cls, "other", "left").join(gone, ["n1", "n2", "mark"], "left")
    if hidden is not None:
        seen = seen.join(hidden.select(F.col("node").alias("other"), F.lit(True).alias("hid")), "other", "left")
    else:
        seen = seen.withColumn("hid", F.lit(None).cast("boolean"))
    variant = F.col("cls").isNull()
    alive = (variant & F.col("hid").isNull()) | ((F.col("cls") == "0") & F.col("skip").isNull())
    per = seen.groupBy("node").agg(F.max(F.coalesce(alive, F.lit(False))).alias("alive"), F.max(variant).alias("variant"))
    w = W.orderBy("start_pos")  # the window's nodes
    rows = ref.join(per, "node", "left").withColumns({"alive": F.coalesce("alive", F.lit(False)), "variant": F.coalesce("variant", F.lit(False))})
    rows = rows.withColumn("linked", F.col("alive") | F.lag("node").over(w).isNull() | F.lead("node").over(w).isNull())
    return rows.select("node", (F.col("linked") | (F.coalesce(F.lag("linked").over(w), F.lit(False)) & ~F.col("variant"))).alias("kept"))
