"""Walks of assemblies: positions, strings, alignment pieces, and how they run through a displayed graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import canonical, cigar_ops, mark, tokens
from ..tables import durable, running
from .graph import nearest_reference


def positions(step: DataFrame, path: list[str]) -> DataFrame:
    """path..., idx, node, qpos: where each step starts on its path, from 1."""
    w = W.partitionBy(*path).orderBy("idx")
    return step.select(*path, "idx", "node", (F.sum("len").over(w) - F.col("len") + 1).alias("qpos"))


def strings(step: DataFrame, path: list[str]) -> DataFrame:
    """path..., path: ``>1<2...``."""
    parts = F.array_sort(F.collect_list(F.struct("idx", F.concat("ori", F.col("node").cast("string")).alias("t"))))
    return step.groupBy(*path).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("path"))


def exploded(paths: DataFrame, path: list[str], walk: str = "path") -> DataFrame:
    """path..., idx, ori, node of walk strings."""
    return paths.select(*path, F.posexplode(tokens(walk)).alias("idx", "t")).select(*path, F.col("idx").cast("long").alias("idx"), "t.ori", "t.node")


def first_visits(visit: DataFrame) -> DataFrame:
    """node, asm, path_id, idx of the first visit in the order of assemblies, paths and steps."""
    w = W.partitionBy("node").orderBy("asm", "path_id", "idx")
    return visit.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("node", "asm", "path_id", "idx")


def highlighted(step: DataFrame, path: list[str], shown: DataFrame, edges: DataFrame) -> DataFrame:
    """n1, n2, mark, dir: displayed edges that a path runs along; dir 1 as the edge is stored, 0 against it. Steps that are not shown may be missing."""
    w = W.partitionBy(*path).orderBy("idx")
    pair = step.select(F.lag("node").over(w).alias("a"), F.lag("ori").over(w).alias("oa"), F.col("node").alias("b"), F.col("ori").alias("ob"), (F.col("idx") - F.lag("idx").over(w)).alias("ahead"))
    pair = pair.filter("ahead = 1").join(shown.select(F.col("node").alias("a")), "a", "left_semi").join(shown.select(F.col("node").alias("b")), "b", "left_semi")
    pair = pair.select("a", "b", mark("oa", "ob", ">").alias("m")).distinct().withColumn("key", canonical("a", "b", "m"))
    kept = edges.withColumn("key", canonical("n1", "n2", "mark"))
    same = (F.col("a") == F.col("n1")) & (F.col("b") == F.col("n2")) & (F.col("m") == F.col("mark"))
    return kept.join(pair, "key").select("n1", "n2", "mark", same.cast("int").alias("dir")).distinct()


def runs(step: DataFrame, path: list[str], shown: DataFrame) -> DataFrame:
    """path..., run, q_start, q_last, path: maximal stretches of steps inside the displayed graph; with ``cigar``, that of the stretch, where steps have one (null where none has).

    q_last is where the last node starts.  Steps that are not shown may be missing, and go before
    any order is made: a task holds what a view shows of a walk, not the walk.
    """
    w = W.partitionBy(*path).orderBy("idx")
    inside = step.join(shown.select("node").distinct(), "node", "left_semi")
    numbered = inside.withColumn("_new", F.coalesce(F.lag("idx").over(w) != F.col("idx") - 1, F.lit(True)).cast("long")).withColumn("run", F.sum("_new").over(w))
    aligned = "cigar" in step.columns
    parts = F.array_sort(F.collect_list(F.struct("idx", F.concat("ori", F.col("node").cast("string")).alias("t"), *(["cigar"] if aligned else []))))
    joined = lambda c: F.array_join(F.transform("_p", lambda x: x[c]), "")
    out = numbered.groupBy(*path, "run").agg(F.min("qpos").alias("q_start"), F.max("qpos").alias("q_last"), parts.alias("_p"))
    return out.select(*path, "run", "q_start", "q_last", joined("t").alias("path"), *([F.nullif(joined("cigar"), F.lit("")).alias("cigar")] if aligned else []))


def runs_of(wanted: DataFrame, assemblies: DataFrame, step: DataFrame, shown: DataFrame, piece: DataFrame | None = None) -> DataFrame:
    """name, asm, chr, run, q_start, q_last, path, cigar: the runs of all requested assemblies (column name) in one view.

    step has asm, chr, idx, node, ori, qpos; piece (asm, chr, idx, cigar, as of split_cigars()) has
    the steps' parts of their alignments, if there are any.  An assembly that the graph does not
    have, or that does not meet the view, has one row without a run (without asm too, if unknown);
    a name asked twice is told once.
    """
    asked = known(wanted, assemblies)
    mine = step.join(asked.select("asm").distinct(), "asm", "left_semi").join(shown.select("node").distinct(), "node", "left_semi")
    if piece is None:
        mine = mine.withColumn("cigar", F.lit(None).cast("string"))
    else:
        mine = mine.join(piece.select("asm", "chr", "idx", "cigar"), ["asm", "chr", "idx"], "left")
    return asked.join(runs(mine, ["asm", "chr"], shown), "asm", "left").select("name", "asm", "chr", "run", "q_start", "q_last", "path", "cigar")


def chain(step: DataFrame, path: list[str], kept: DataFrame) -> DataFrame:
    """path..., n1, n2: each kept node with the kept node before it on the path; hidden ones between do not break the chain."""
    w = W.partitionBy(*path).orderBy("idx")
    only = step.join(kept.select("node"), "node", "left_semi")
    return only.select(*path, F.lag("node").over(w).alias("n1"), F.col("node").alias("n2")).filter("n1 is not null").distinct()


def first_highlighter(step: DataFrame, path: list[str], wanted: list[int], shown: DataFrame, edges: DataFrame) -> DataFrame:
    """n1, n2, mark, asm: displayed edges with the lowest of the wanted assemblies that runs along them."""
    own = step.filter(F.col("asm").isin(wanted))
    w = W.partitionBy(*path).orderBy("idx")
    pair = own.select("asm", F.lag("node").over(w).alias("a"), F.lag("ori").over(w).alias("oa"), F.col("node").alias("b"), F.col("ori").alias("ob")).filter("a is not null")
    pair = pair.join(shown.select(F.col("node").alias("a")), "a", "left_semi").join(shown.select(F.col("node").alias("b")), "b", "left_semi")
    first = pair.select(canonical("a", "b", mark("oa", "ob", ">")).alias("key"), "asm").groupBy("key").agg(F.min("asm").alias("asm"))
    return edges.withColumn("key", canonical("n1", "n2", "mark")).join(first, "key").select("n1", "n2", "mark", "asm")


def located(step: DataFrame, path: list[str], node: DataFrame) -> DataFrame:
    """path..., chr, start_pos, end_pos: the reference stretch from a path's first to last reference node, on each chromosome."""
    ref = node.filter("rank = 0").select("node", F.col("chr").alias("ref_chr"), "start_pos", "end_pos")
    return step.select(*path, "node").join(ref, "node").groupBy(*path, "ref_chr").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))


def to_reference(step: DataFrame, path: list[str], node: DataFrame, edge: DataFrame, depth: int = 500) -> DataFrame:
    """path..., ref_chr, start_pos, end_pos, dist: located() with dist 0; a path without reference nodes lies where the reference nodes nearest to its two ends do."""
    own = located(step, path, node)
    rest = step.join(own.select(*path).distinct(), path, "left_anti")
    ends = rest.groupBy(*path).agg(F.array_distinct(F.array(F.min_by("node", "idx"), F.max_by("node", "idx"))).alias("n")).select(*path, F.explode("n").alias("node"))
    near = ends.join(nearest_reference(edge, node, depth), "node").select(*path, F.col("ref_node").alias("node"), "dist")
    ref = node.filter("rank = 0").select("node", F.col("chr").alias("ref_chr"), "start_pos", "end_pos")
    far = near.join(ref, "node").groupBy(*path, "ref_chr").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("dist").alias("dist"))
    return own.withColumn("dist", F.lit(0)).unionByName(far)


#: Operations or nodes of a range of a long path, and positions of a stretch of it, as powers of two.
RANGE, STRETCH = 14, 16


#: Operations that take bases of the reference, and of the query.
REFERENCE, QUERY = "MX=DN", "MX=IS"


def _taken(letters: str) -> Column:
    """Bases that an operation (n, op) takes of what ``letters`` take; 0 where there is none."""
    return F.when(F.col("op").isin(*letters), F.col("n")).otherwise(0)


def _windowed(df: DataFrame, by: list[str], order: str, what: dict[str, str]) -> DataFrame:
    """df with sums up to each row, by one window a group: for groups that a task can hold."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({name: F.sum(col).over(w) for name, col in what.items()})


def _ranged(df: DataFrame, by: list[str], order: str, what: dict[str, str]) -> DataFrame:
    """_windowed() for groups of any size: rows are summed within ranges of their number, moved once and written; only the ranges' totals are put in order over a whole group."""
    part = durable(_windowed(df.withColumn("_in", F.shiftright(F.col(order).cast("long"), RANGE)), [*by, "_in"], order, what), "ranges")
    ends = part.groupBy(*by, "_in").agg(*(F.sum(col).alias(f"_{col}") for col in what.values()))
    upto = running(ends, by, ["_in"], {f"_{name}": ("sum", f"_{col}") for name, col in what.items()})
    before = durable(upto.select(*by, "_in", *((F.col(f"_{name}") - F.col(f"_{col}")).alias(f"_{name}") for name, col in what.items())), "before")
    joined = part.alias("p").join(before.alias("b"), _same([*by, "_in"], "p", "b")).select("p.*", *(f"b._{name}" for name in what))
    return joined.withColumns({name: F.col(name) + F.col(f"_{name}") for name in what}).drop("_in", *(f"_{name}" for name in what))


def _same(cols: list[str], a: str, b: str) -> Column:
    """Rows of a and b that agree in cols, nulls too."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols))


def _in_stretches(starts: DataFrame) -> DataFrame:
    """starts with the stretch ``_in`` of each.  A stretch also gets, from those before it, the node and the operation on the reference that were begun last."""
    starts = starts.withColumns({"_in": F.shiftright("at", STRETCH), "is_op": F.col("op").isNotNull()})
    last = starts.groupBy("path", "_in").agg(F.max(F.when(~F.col("is_op"), F.col("k"))).alias("k0"), F.max(F.when(_taken(REFERENCE) > 0, F.col("k"))).alias("k1"))
    before = durable(running(last, ["path"], ["_in"], {"b0": ("before", "k0"), "b1": ("before", "k1")}), "begun")
    due = before.select("path", F.col("_in").alias("to"), F.explode(F.array(*(F.struct(F.lit(is_op).alias("is_op"), F.col(b).alias("k")) for b, is_op in (("b0", False), ("b1", True))))).alias("b"))
    due = due.select("path", "to", "b.*").filter("k is not null")
    late = starts.alias("s").join(due.alias("d"), _same(["path", "is_op", "k"], "s", "d")).select("s.*", "d.to").withColumn("_in", F.col("to")).drop("to")
    return starts.unionByName(late).drop("is_op")


def split_cigars(aln: DataFrame, step: DataFrame, together: int = 1 << 22) -> DataFrame:
    """path, idx, node, cigar, qpos: an alignment's CIGAR cut at its nodes' ends.

    aln has path, pstart, qstart, cigar; step has path, idx, node, len.  Operations that take no
    reference bases go to the node in which the next base lies (at the end, to the last).
    qpos is the query position at the node's first aligned base.

    Starts of nodes and of operations are put in one order along the path; each start of an
    operation then takes the node begun last, and each start of a node what the operation begun
    last has left over, so the work is in proportion to both together.  Paths whose CIGAR has more
    than ``together`` characters, such as chromosomes, are cut in stretches of positions, each
    taking over what those before it have begun, so that no task orders one; the result is the same.
    """
    least, most = aln.agg(F.min(F.length("cigar")), F.max(F.length("cigar"))).first()
    if (most or 0) <= together:
        return _cut(aln, step, False)
    of = lambda names, how: step.alias("s").join(names.distinct().alias("n"), _same(["path"], "s", "n"), how)
    if least > together:
        return _cut(aln, of(aln.select("path"), "left_semi"), True)
    long = F.length("cigar") > together
    names = aln.filter(long).select("path")
    return _cut(aln.filter(~long), of(names, "left_anti"), False).unionByName(_cut(aln.filter(long), of(names, "left_semi"), True))


def _cut(aln: DataFrame, step: DataFrame, long: bool) -> DataFrame:
    summed = _ranged if long else _windowed
    ops = aln.select("path", "pstart", "qstart", F.posexplode(cigar_ops("cigar")).alias("k", "o")).select("path", "pstart", "qstart", F.col("k").cast("long").alias("k"), "o.n", "o.op")
    ops = summed(ops.withColumns({"rn": _taken(REFERENCE), "qn": _taken(QUERY)}), ["path"], "k", {"_r": "rn", "_q": "qn"})
    ops = ops.select("path", "k", (F.col("pstart") + F.col("_r") - F.col("rn")).alias("at"), "n", "op", (F.col("qstart") + F.col("_q") - F.col("qn")).alias("q0"))
    spans = summed(step.select("path", "idx", "node", "len"), ["path"], "idx", {"s1": "len"})
    spans = spans.select("path", F.col("idx").cast("long").alias("k"), (F.col("s1") - F.col("len")).alias("at"), "node", "s1")
    starts = ops.unionByName(spans, allowMissingColumns=True)
    if long:
        starts = _in_stretches(starts)
    is_op, rn, qn = F.col("op").isNotNull(), _taken(REFERENCE), _taken(QUERY)
    w = W.partitionBy("path", *(["_in"] if long else [])).orderBy("at", is_op, "k").rowsBetween(W.unboundedPreceding, 0)
    op = F.struct("k", "n", "op", F.col("at").alias("r0"), "q0")
    span = F.struct(F.col("k").cast(step.schema["idx"].dataType).alias("idx"), "node", F.col("at").alias("s0"), "s1")
    begun = starts.withColumns({"s": F.last(F.when(~is_op, span), ignorenulls=True).over(w), "o": F.last(F.when(rn > 0, op), ignorenulls=True).over(w)})
    if long:
        begun = begun.filter(F.col("_in") == F.shiftright("at", STRETCH))
    begun = begun.select("path", is_op.alias("is_op"), "s", F.when(is_op, op).otherwise(F.col("o")).alias("o"))
    met = begun.filter("s is not null and o is not null").select("path", "is_op", "s.*", "o.*").filter(F.col("is_op") | (F.col("r0") + rn > F.col("s0")))
    lead = F.greatest(F.col("s0") - F.col("r0"), F.lit(0))
    size = F.when(rn > 0, F.least("s1", F.col("r0") + rn) - F.greatest("s0", F.col("r0"))).otherwise(F.col("n"))
    piece = met.filter(size > 0).select("path", "idx", "node", "k", F.concat(size.cast("string"), "op").alias("t"), (F.col("q0") + F.when(qn > 0, lead).otherwise(0)).alias("q"))
    parts = F.sort_array(F.collect_list(F.struct("k", "t")))
    return piece.groupBy("path", "idx", "node").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("cigar"), F.min("q").alias("qpos"))


def cigar_between(piece: DataFrame, first: int, last: int) -> DataFrame:
    """path, cigar: of split_cigars(), the CIGAR from node number ``first`` up to, not including, number ``last`` of each path."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "cigar")))
    return piece.filter((F.col("idx") >= first) & (F.col("idx") < last)).groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["cigar"]), "").alias("cigar"))


def run_cigars(piece: DataFrame, shown: DataFrame) -> DataFrame:
    """path, run, q_start, cigar: of split_cigars(), the maximal stretches of nodes inside the displayed graph, each with its own CIGAR."""
    w = W.partitionBy("path").orderBy("idx")
    inside = piece.join(shown.select("node").distinct(), "node", "left_semi").withColumn("_prev", F.lag("idx").over(w))
    new = F.coalesce((F.col("idx") != F.col("_prev") + 1), F.lit(True)).cast("long")
    numbered = inside.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("idx", "cigar")))
    return numbered.groupBy("path", "run").agg(F.min("qpos").alias("q_start"), F.array_join(F.transform(parts, lambda x: x["cigar"]), "").alias("cigar"))


def known(wanted: DataFrame, assemblies: DataFrame) -> DataFrame:
    """name, asm, is_known of the requested assemblies (column name): those not in the graph are told, not left out."""
    return wanted.select("name").distinct().join(assemblies.select("name", "asm"), "name", "left").select("name", "asm", F.col("asm").isNotNull().alias("is_known"))


def chunk_fragments(step: DataFrame, path: list[str], chunk_of: DataFrame) -> DataFrame:
    """path..., chr, chunk, idx, node, ori: steps by chunk; a step whose predecessor lies in another chunk also goes to that one."""
    w = W.partitionBy(*path).orderBy("idx")
    at = step.join(chunk_of.select("node", F.col("chr").alias("ref_chr"), "chunk"), "node").withColumns({"p_chr": F.lag("ref_chr").over(w), "p_chunk": F.lag("chunk").over(w)})
    cols = [*path, "ref_chr", "chunk", "idx", "node", "ori"]
    crossing = at.filter("p_chunk is not null and (p_chunk <> chunk or p_chr <> ref_chr)")
    return at.select(*cols).unionByName(crossing.select(*path, F.col("p_chr").alias("ref_chr"), F.col("p_chunk").alias("chunk"), "idx", "node", "ori")).distinct()
