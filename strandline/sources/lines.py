"""Lines of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import carried


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """value, file, line_no (order within the file): plain or gzipped text.

    Spark deals the splits of a file in its order (all are of one size but the last, and longer
    ones go first), so line_no grows along each file, not from file to file.
    """
    return spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"))


def ranges(lines: DataFrame) -> DataFrame:
    """lines with ``_range``, 65,536 lines at most of the part of the file they were read in: line_no grows from range to range, and no range with the file."""
    return lines.withColumn("_range", F.shiftright("line_no", 16))


def fields(lines: DataFrame, record: str | None = None) -> DataFrame:
    """lines with f, the tab-separated fields; of one record type if named; comments and blank lines go."""
    kept = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    out = kept.withColumn("f", F.split("value", "\t"))
    return out if record is None else out.filter(F.col("f")[0] == record)


def dimension(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """A list file: whitespace-separated columns with an ordinal from 0 (the place among the lines that are neither comments nor blank)."""
    rows = read(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    rows = carried(ranges(rows), [], ["line_no"], {"ordinal": ("count", "")})
    return rows.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)], (F.col("ordinal") - 1).alias("ordinal"))


def translated(names: DataFrame, table: DataFrame, col: str = "chr") -> DataFrame:
    """names with col replaced where the table (source, target) has it."""
    t = table.select(F.col("source").alias(col), F.col("target").alias("_t"))
    return names.join(t, col, "left").withColumn(col, F.coalesce("_t", col)).drop("_t").select(names.columns)
