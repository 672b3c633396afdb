"""Layout of a window: spacers, scale, reference positions, variant segments, what is drawn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import running

WIDTH, LEFT, CUT, SPACER = 800, 50, 2000, 80


@dataclass(frozen=True)
class Scale:
    """Bases shown, reference nodes, first position, spacer in bases, pixels a base."""

    length: int
    nodes: int
    start: int | None
    cut: int
    scale: float


def scale_of(window: DataFrame, width: int = WIDTH, most: int = CUT) -> Scale:
    """The scalars of a window; one row reaches the driver."""
    n, length, start = window.filter("cls = '0'").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.min("start_pos")).first()
    base, cut = width - SPACER * (n - 1), most
    if base > 0 and n:
        cut = min(most, SPACER * length // base + 1)
    span = length + (n - 1) * cut
    return Scale(length, n, start, cut, width / span if n and span else 0.0)


def reference_x(window: DataFrame, s: Scale, left: int = LEFT) -> DataFrame:
    """node, i, x1, x2 of the reference nodes inside the window."""
    w = W.orderBy("start_pos")  # the window's nodes
    i = F.row_number().over(w) - 1
    before = F.sum("len").over(w) - F.col("len")
    rows = window.filter("cls = '0'").select("node", "len", i.alias("i"), before.alias("before"))
    x1 = F.lit(float(left)) + F.lit(s.scale) * (F.col("before") + F.col("i") * s.cut)
    return rows.select("node", "i", x1.alias("x1"), (x1 + F.lit(s.scale) * F.col("len")).alias("x2"))


def segments(variant: DataFrame, cut: int) -> DataFrame:
    """node, seg (from 1), len: variant nodes cut into pieces of the spacer's length, the last one shorter."""
    pieces = F.greatest(F.ceil(F.col("len") / cut), F.lit(1)).cast("long")
    rows = variant.withColumn("k", pieces).withColumn("seg", F.explode(F.expr("sequence(1L, k)")))
    return rows.select("node", "seg", F.when(F.col("seg") < F.col("k"), F.lit(cut)).otherwise(F.col("len") - (F.col("k") - 1) * cut).cast("long").alias("len"))


def point_ids(window: DataFrame, variant: DataFrame, cut: int) -> DataFrame:
    """node, s_id, e_id, is_ref, i: drawing ids of both ends; reference nodes by position, then variant nodes by id."""
    ref = window.filter("cls = '0'").select("node", (F.row_number().over(W.orderBy("start_pos")).cast("long") - 1).alias("i"))
    ref = ref.select("node", (2 * F.col("i") + 1).alias("s_id"), (2 * F.col("i") + 2).alias("e_id"), F.lit(True).alias("is_ref"), "i")
    total = window.filter("cls = '0'").count() * 2
    points = F.greatest(F.ceil(F.col("len") / cut), F.lit(1)).cast("long") + 1
    upto = lambda rows: running(rows, [], ["node"], {"upto": ("sum", "points")})
    rows = upto(variant.select("node", points.alias("points")))
    rows = rows.select("node", (F.lit(total) + F.col("upto") - F.col("points") + 1).alias("s_id"), (F.lit(total) + F.col("upto")).alias("e_id"), F.lit(False).alias("is_ref"), F.lit(None).cast("long").alias("i"))
    return ref.unionByName(rows)


def drawn_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, type: 0 bodies, 1 spacers of the reference, 2 to 5 edges by mark (but the reference's own neighbours)."""
    ref, var = ids.filter("is_ref"), ids.filter("not is_ref")
    bodies = ref.select(F.col("s_id").alias("source"), F.col("e_id").alias("target"), F.lit(0).alias("type"))
    pieces = var.withColumn("source", F.explode(F.expr("sequence(s_id, e_id - 1)"))).select("source", (F.col("source") + 1).alias("target"), F.lit(0).alias("type"))
    spacers = ref.filter("i > 0").select((F.col("s_id") - 1).alias("source"), F.col("s_id").alias("target"), F.lit(1).alias("type"))
    a = ids.select(F.col("node").alias("n1"), F.col("s_id").alias("s1"), F.col("e_id").alias("e1"), F.col("i").alias("i1"))
    b = ids.select(F.col("node").alias("n2"), F.col("s_id").alias("s2"), F.col("e_id").alias("e2"), F.col("i").alias("i2"))
    links = edges.join(a, "n1").join(b, "n2").filter("not (mark = 2 and i1 is not null and i2 is not null and i2 = i1 + 1)")
    links = links.select(F.when(F.col("mark").isin(2, 3), F.col("e1")).otherwise(F.col("s1")).alias("source"), F.when(F.col("mark").isin(2, 4), F.col("s2")).otherwise(F.col("e2")).alias("target"), F.col("mark").alias("type"))
    return bodies.unionByName(pieces).unionByName(spacers).unionByName(links)


def highlight_ids(ids: DataFrame, lit: DataFrame) -> DataFrame:
    """link (source_target_type), dir of paths.highlighted() in drawing ids; the reference's own neighbours have type 1."""
    a = ids.select(F.col("node").alias("n1"), F.col("s_id").alias("s1"), F.col("e_id").alias("e1"), F.col("i").alias("i1"))
    b = ids.select(F.col("node").alias("n2"), F.col("s_id").alias("s2"), F.col("e_id").alias("e2"), F.col("i").alias("i2"))
    rows = lit.join(a, "n1").join(b, "n2")
    own = F.coalesce((F.col("mark") == 2) & (F.col("i2") == F.col("i1") + 1), F.lit(False))
    source, target = F.when(F.col("mark").isin(2, 3), F.col("e1")).otherwise(F.col("s1")), F.when(F.col("mark").isin(2, 4), F.col("s2")).otherwise(F.col("e2"))
    return rows.select(F.concat_ws("_", source.cast("string"), target.cast("string"), F.when(own, 1).otherwise(F.col("mark")).cast("string")).alias("link"), "dir")


def feature_pixels(seen: DataFrame, feature: DataFrame, x: DataFrame, s: Scale, width: int = WIDTH, left: int = LEFT) -> DataFrame:
    """fid, x1, x2, margin: a feature's span, cut to the view; margin '2' left-cut on -, '1' right-cut on +, else '0'."""
    a, b = x.select(F.col("node").alias("node1"), F.col("x1").alias("xa")), x.select(F.col("node").alias("node2"), F.col("x1").alias("xb"))
    rows = seen.join(feature.select("fid", "strand"), "fid").join(a, "node1", "left").join(b, "node2", "left")
    margin = F.when(F.col("xb").isNull() & (F.col("strand") == "+"), "1").when(F.col("xa").isNull() & (F.col("strand") == "-"), "2").otherwise("0")
    x1 = F.coalesce(F.col("xa") + F.col("off1") * F.lit(s.scale), F.lit(float(left)))
    x2 = F.coalesce(F.col("xb") + F.col("off2") * F.lit(s.scale), F.lit(float(left + width)))
    return rows.select("fid", x1.alias("x1"), x2.alias("x2"), margin.alias("margin"))


def ticks(x: DataFrame, window: DataFrame, s: Scale, every: int = SPACER, left: int = LEFT) -> DataFrame:
    """x, pos: a tick every so many pixels where it falls on a node of reference_x(), and the position there."""
    rows = x.join(window.select("node", "start_pos"), "node")
    if not s.scale:
        return rows.select(F.col("x1").alias("x"), F.col("start_pos").alias("pos")).limit(0)
    first, last = F.ceil((F.col("x1") - left) / every), F.floor((F.col("x2") - left) / every)
    at = rows.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("at", F.col("k") * every + F.lit(float(left)))
    return at.select(F.round("at", 4).alias("x"), (F.col("start_pos") + F.floor((F.col("at") - F.col("x1")) / F.lit(s.scale))).cast("long").alias("pos"))
