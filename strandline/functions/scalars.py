"""Column functions of bidirected sequence graphs.

A mark tells how an edge joins its nodes: 2 (+,+), 3 (+,-), 4 (-,+), 5 (-,-).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mark(sign1: Column | str, sign2: Column | str, plus: str = "+") -> Column:
    """Mark of an edge from the signs of its ends; ``plus`` is what stands for forward ('+' in links, '>' in walks)."""
    a, b = _col(sign1) == plus, _col(sign2) == plus
    return F.when(a & b, 2).when(a, 3).when(b, 4).otherwise(5)


def rev_mark(m: Column | str) -> Column:
    """Mark of the same edge read from its other end."""
    m = _col(m)
    return F.when(m == 2, 5).when(m == 5, 2).otherwise(m)


def signs(m: Column | str, flip1: Column | str, flip2: Column | str) -> Column:
    """struct<sign1, sign2> of an edge once the nodes with a true flip are turned round."""
    m, a, b = _col(m), F.coalesce(_col(flip1), F.lit(False)), F.coalesce(_col(flip2), F.lit(False))
    sign = lambda forward, flip: F.when(forward != flip, "+").otherwise("-")
    return F.struct(sign(m.isin(2, 3), a).alias("sign1"), sign(m.isin(2, 4), b).alias("sign2"))


def canonical(n1: Column | str, n2: Column | str, m: Column | str) -> Column:
    """struct<n1, n2, mark>: the smaller of an edge and its reverse, the same for both."""
    n1, n2, m = _col(n1), _col(n2), _col(m).cast("int")
    return F.least(F.struct(n1.alias("n1"), n2.alias("n2"), m.alias("mark")), F.struct(n2.alias("n1"), n1.alias("n2"), rev_mark(m).cast("int").alias("mark")))


def pansn(name: Column | str, sep: str = "#") -> Column:
    """struct<sample, hap, chr>: two separators or more split at the first two, one leaves haplotype 0, none is the reference."""
    name = _col(name)
    first = F.instr(name, sep)
    rest = F.substring(name, first + F.lit(len(sep)), F.length(name))
    second = F.instr(rest, sep)
    sample = F.substring(name, F.lit(1), first - 1)
    return (
        F.when(first == 0, F.struct(F.lit("REF").alias("sample"), F.lit("HAP").alias("hap"), name.alias("chr")))
        .when(second == 0, F.struct(sample.alias("sample"), F.lit("0").alias("hap"), rest.alias("chr")))
        .otherwise(F.struct(sample.alias("sample"), F.substring(rest, F.lit(1), second - 1).alias("hap"), F.substring(rest, second + F.lit(len(sep)), F.length(rest)).alias("chr")))
    )


def overlap_length(alignment: Column | str) -> Column:
    """Summed length of the M, I, S, X and = operations; 0 for ``*``."""
    return F.aggregate(cigar_ops(alignment), F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin("M", "I", "S", "X", "="), x["n"]).otherwise(0))


def tokens(walk: Column | str) -> Column:
    """``>12<7`` as array<struct<ori, node>>. (Split, which is linear in long walks.)"""
    parts = F.filter(F.split(_col(walk), "(?=[><])"), lambda x: x.rlike(r"^[><]s?\d+$"))
    return F.transform(parts, lambda x: F.struct(F.substring(x, 1, 1).alias("ori"), F.regexp_extract(x, r"\d+", 0).cast("long").alias("node")))


def p_tokens(path: Column | str) -> Column:
    """``1+,2-;3+`` as array<struct<ori, node, jump>>; jump where a semicolon stands before the step."""
    parts = F.filter(F.split(_col(path), "(?<=[+-])"), lambda x: x.rlike(r"\d+[+-]$"))
    return F.transform(parts, lambda x: F.struct(F.when(F.endswith(x, F.lit("+")), ">").otherwise("<").alias("ori"), F.regexp_extract(x, r"\d+", 0).cast("long").alias("node"), F.startswith(x, F.lit(";")).alias("jump")))


def reverse_complement(seq: Column | str) -> Column:
    """Other letters than ACGT and acgt stay."""
    return F.translate(F.reverse(_col(seq)), "ACGTacgt", "TGCAtgca")


def cigar_ops(cigar: Column | str) -> Column:
    """array<struct<n, op>>."""
    parts = F.filter(F.split(_col(cigar), "(?<=[MIDNSHPX=])"), lambda x: x.rlike(r"^\d+[MIDNSHPX=]$"))
    return F.transform(parts, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("long").alias("n"), F.substring(x, -1, 1).alias("op")))


def attribute(attributes: Column | str, name: str) -> Column:
    """A GFF3 attribute, null where it is missing."""
    return F.nullif(F.regexp_extract(_col(attributes), rf"(?:^|;)\s*{name}=([^;]*)", 1), F.lit(""))


def saturated(n: Column | str) -> Column:
    """A count that stops at 65535."""
    return F.least(_col(n), F.lit(65535))


def coverage_class(cov: Column | str) -> Column:
    """'one' between 0.99 and 1.01, 'value' above 0, else 'absent'."""
    cov = _col(cov)
    return F.when((cov > 0.99) & (cov < 1.01), "one").when(cov > 0, "value").otherwise("absent")


def feature_class(name: Column | str) -> Column:
    """Of a feature's one-letter type."""
    name = _col(name)
    return F.when(name == "E", "exon").when(name == "C", "CDS").otherwise("gene")
