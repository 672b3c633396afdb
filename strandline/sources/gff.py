"""Gene models (GFF3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import attribute
from ..tables import carried
from .lines import fields, ranges

IS_GENE = "type rlike 'gene$'"


def records(lines: DataFrame) -> DataFrame:
    """chr, type, start_pos, end_pos, strand, id, name (the id where there is none), parent."""
    f = F.col("f")
    keep = [c for c in ("line_no", "file") if c in lines.columns]
    own = attribute(f[8], "ID")
    return fields(lines).select(f[0].alias("chr"), f[2].alias("type"), f[3].cast("long").alias("start_pos"), f[4].cast("long").alias("end_pos"), f[6].alias("strand"), own.alias("id"), F.coalesce(attribute(f[8], "Name"), own).alias("name"), attribute(f[8], "Parent").alias("parent"), *keep)


def gene_models(rows: DataFrame, by: list[str]) -> DataFrame:
    """Exons and CDS with the gene that stands before them in the file and holds them; others are dropped. Needs line_no."""
    gene = F.when(F.expr(IS_GENE), F.struct(F.col("id").alias("gene"), F.col("start_pos").alias("g0"), F.col("end_pos").alias("g1")))
    # the gene is carried over the ranges in which the file was read
    child = carried(ranges(rows.withColumn("_gene", gene)), by, ["line_no"], {"_g": ("last", "_gene")}).filter(F.col("type").isin("exon", "CDS"))
    return child.filter((F.col("start_pos") >= F.col("_g.g0")) & (F.col("end_pos") <= F.col("_g.g1"))).select(*rows.columns, F.col("_g.gene").alias("gene"))


def text(feature: DataFrame) -> DataFrame:
    """Gene and exon lines of the projection's features: even ids are genes."""
    kind = F.when(F.col("fid") % 4 == 0, "gene").when(F.col("fid") % 4 == 2, "pseudogene").otherwise("exon")
    attr = F.concat(F.lit("xID=no;ID=g"), F.col("fid").cast("string"), F.when(F.col("fid") % 3 == 0, F.concat(F.lit(";Name=n"), F.col("fid").cast("string"))).otherwise(""))
    cols = [F.col("chr"), F.lit("src"), kind, F.col("start_pos"), F.col("end_pos"), F.lit("."), F.col("strand"), F.lit("."), attr]
    return feature.select(F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value"))


def model_text(feature: DataFrame) -> DataFrame:
    """line_no, value: the projection's features as gene models; every eighth is a gene, and those after it are its exons and CDS by two transcripts."""
    gene = F.col("fid") % 8 == 0
    kind = F.when(gene, "gene").when(F.col("fid") % 2 == 0, "exon").otherwise("CDS")
    attr = F.when(gene, F.concat(F.lit("ID=g"), F.col("fid").cast("string"))).otherwise(F.concat(F.lit("ID=p"), F.col("fid").cast("string"), F.lit(";Parent=t"), (F.floor(F.col("fid") / 8) * 2 + F.floor(F.col("fid") / 2) % 2).cast("string")))
    cols = [F.lit("all"), F.lit("src"), kind, F.when(gene, F.lit(1)).otherwise(F.col("start_pos")), F.when(gene, F.lit(900)).otherwise(F.col("end_pos")), F.lit("."), F.col("strand"), F.lit("."), attr]
    return feature.select(F.col("fid").alias("line_no"), F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value"))
