"""Graph text: rGFA and GFA version 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mark, p_tokens, pansn
from ..tables import durable
from .lines import fields

#: Record types (fixed values).
RECORDS = ["S", "L", "J", "W", "P"]

#: Length of a jump whose distance is not given.
JUMP = 100


def _tag(name: str) -> Column:
    return F.get(F.filter("f", lambda x: x.startswith(f"{name}:")), F.lit(0)).substr(F.lit(len(name) + 4), F.lit(1 << 30))


def _id(at: int) -> Column:
    return F.regexp_replace(F.col("f")[at], "^s", "").cast("long")


def rgfa_nodes(lines: DataFrame, sep: str = "#", keep_seq: bool = True) -> DataFrame:
    """node, asm, chr, start_pos, end_pos, len, rank(, seq) of segments with the tags LN, SN, SO, SR, found by name; a name without separator belongs to REF, haplotype 0."""
    s = fields(lines, "S")
    length = F.coalesce(_tag("LN").cast("long"), F.length(F.col("f")[2]).cast("long"))
    name = pansn(F.when(F.instr(_tag("SN"), sep) == 0, F.concat(F.lit(f"REF{sep}0{sep}"), _tag("SN"))).otherwise(_tag("SN")), sep)
    start = _tag("SO").cast("long")
    out = s.select(_id(1).alias("node"), name.alias("n"), (start + 1).alias("start_pos"), (start + length).alias("end_pos"), length.alias("len"), _tag("SR").cast("int").alias("rank"), F.col("f")[2].alias("seq"))
    cols = ["node", F.concat_ws(sep, "n.sample", "n.hap").alias("asm"), F.col("n.chr").alias("chr"), "start_pos", "end_pos", "len", "rank"]
    return out.select(*cols, *(["seq"] if keep_seq else []))


def segments(lines: DataFrame) -> DataFrame:
    """node, len, seq; the length is the sequence's, or LN where it is ``*``."""
    s = fields(lines, "S")
    seq = F.col("f")[2]
    return s.select(_id(1).alias("node"), F.when(seq == "*", F.coalesce(_tag("LN").cast("long"), F.lit(1))).otherwise(F.length(seq)).cast("long").alias("len"), F.when(seq != "*", seq).alias("seq"))


def links(lines: DataFrame) -> DataFrame:
    """n1, n2, mark, sign1, sign2, overlap."""
    f = F.col("f")
    return fields(lines, "L").select(_id(1).alias("n1"), _id(3).alias("n2"), mark(f[2], f[4]).alias("mark"), f[2].alias("sign1"), f[4].alias("sign2"), F.get("f", F.lit(5)).alias("overlap"))


def jumps(lines: DataFrame) -> DataFrame:
    """n1, sign1, n2, sign2, distance; ``*`` is 100."""
    f = F.col("f")
    return fields(lines, "J").select(_id(1).alias("n1"), f[2].alias("sign1"), _id(3).alias("n2"), f[4].alias("sign2"), F.coalesce(F.expr("try_cast(f[5] as bigint)"), F.lit(JUMP)).alias("distance"), *[c for c in ("line_no",) if c in lines.columns])


def walks(lines: DataFrame, sep: str = "#") -> DataFrame:
    """name, sample, hap, chr, walk_start (``*`` is 0), walk_end, walk."""
    f = F.col("f")
    return fields(lines, "W").select(F.concat_ws(sep, f[1], f[2], f[3]).alias("name"), f[1].alias("sample"), f[2].alias("hap"), f[3].alias("chr"), F.coalesce(F.expr("try_cast(f[4] as bigint)"), F.lit(0)).alias("walk_start"), F.expr("try_cast(f[5] as bigint)").alias("walk_end"), f[6].alias("walk"), *[c for c in ("line_no",) if c in lines.columns])


def p_lines(lines: DataFrame, sep: str = "#") -> DataFrame:
    """name, sample, hap, chr, path."""
    f = F.col("f")
    return fields(lines, "P").select(f[1].alias("name"), pansn(f[1], sep).alias("n"), f[2].alias("path")).select("name", "n.*", "path")


def p_steps(rows: DataFrame) -> DataFrame:
    """name, sample, hap, chr, idx, ori, node, jump of p_lines()."""
    out = rows.select("name", "sample", "hap", "chr", F.posexplode(p_tokens("path")).alias("idx", "t"))
    return out.select("name", "sample", "hap", "chr", F.col("idx").cast("long").alias("idx"), "t.ori", "t.node", "t.jump")


def rgfa_text(node: DataFrame) -> DataFrame:
    """Segment lines of nodes (node, chr, len, rank, start_pos, seq); variant nodes have offset 0."""
    return node.select(F.concat_ws("\t", F.lit("S"), F.concat(F.lit("s"), F.col("node").cast("string")), "seq", F.concat(F.lit("LN:i:"), F.col("len").cast("string")), F.concat(F.lit("SN:Z:REF#0#"), "chr"), F.concat(F.lit("SO:i:"), F.coalesce(F.col("start_pos") - 1, F.lit(0)).cast("string")), F.concat(F.lit("SR:i:"), F.col("rank").cast("string"))).alias("value"))


def link_text(edge: DataFrame) -> DataFrame:
    """Link lines of edges."""
    sign = lambda *plus: F.when(F.col("mark").isin(*plus), "+").otherwise("-")
    return edge.select(F.concat_ws("\t", F.lit("L"), F.concat(F.lit("s"), F.col("n1").cast("string")), sign(2, 3), F.concat(F.lit("s"), F.col("n2").cast("string")), sign(2, 4), F.lit("0M")).alias("value"))


def jump_text(edge: DataFrame) -> DataFrame:
    """Jump lines along some of the edges (n1 + n2 a multiple of 7), every third without a distance."""
    sign = lambda *plus: F.when(F.col("mark").isin(*plus), "+").otherwise("-")
    distance = F.when(F.col("n1") % 3 == 0, "*").otherwise((F.col("n2") % 300 + 1).cast("string"))
    rows = edge.filter((F.col("n1") + F.col("n2")) % 7 == 0)
    return rows.select(F.concat_ws("\t", F.lit("J"), F.concat(F.lit("s"), F.col("n1").cast("string")), sign(2, 3), F.concat(F.lit("s"), F.col("n2").cast("string")), sign(2, 4), distance).alias("value"))


def dealt(lines: DataFrame) -> dict[str, DataFrame]:
    """Lines (value and others) by record type, S, L, J, W and P: the text is scanned once and each type written in a folder of its own, which alone its reader reads."""
    kind = F.substring("value", 1, 1)
    table = durable(lines.filter(kind.isin(*RECORDS)).withColumn("_record", kind), "gfa-records", by="_record")
    return {k: table.filter(F.col("_record") == k).drop("_record") for k in RECORDS}
