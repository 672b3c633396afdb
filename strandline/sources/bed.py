"""Feature tracks (BED with track lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import carried
from .lines import ranges


def tracks(lines: DataFrame) -> DataFrame:
    """lines with is_track, track_id (1 for the first track line of a file), in the order of line_no within file."""
    is_track = F.col("value").rlike(r"^track\b")
    kept = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("is_track", is_track).withColumn("_n", is_track.cast("int"))
    return carried(ranges(kept), [c for c in ("file",) if c in lines.columns], ["line_no"], {"track_id": ("sum", "_n")}).drop("_range", "_n")


def track_names(lines: DataFrame) -> DataFrame:
    """track_id, name, description."""
    t = tracks(lines).filter("is_track")
    return t.select("track_id", F.regexp_extract("value", r'name="([^"]*)"', 1).alias("name"), F.regexp_extract("value", r'description="([^"]*)"', 1).alias("description"))


def features(lines: DataFrame) -> DataFrame:
    """track_id, ncol, chr, start_pos (1-based), end_pos, name, score, strand of records after a track line.

    Records whose end is not beyond their start raise an error, as do strands other than + and -.
    """
    r = tracks(lines).filter("not is_track").withColumn("f", F.split("value", r"\t"))
    at = lambda i: F.get("f", F.lit(i))
    start, end = at(1).cast("long"), at(2).cast("long")
    bad = (F.col("track_id") == 0) | (end <= start) | ~F.coalesce(at(5).isin("+", "-"), F.lit(True))
    chrom = F.when(bad, F.raise_error(F.concat(F.lit("not a valid record: "), "value"))).otherwise(at(0))
    return r.select("track_id", F.size("f").alias("ncol"), chrom.cast("string").alias("chr"), (start + 1).alias("start_pos"), end.alias("end_pos"), at(3).alias("name"), F.expr("try_cast(get(f, 4) as double)").alias("score"), at(5).alias("strand"))


def text(feature: DataFrame) -> DataFrame:
    """line_no, value: the projection's features as one file, a track line before the records of each track."""
    cols = [F.col("chr"), F.col("start_pos") - 1, F.greatest("end_pos", "start_pos"), F.concat(F.lit("f"), F.col("fid").cast("string")), F.col("fid") % 1000, F.col("strand")]
    first = feature.groupBy("track").agg(F.lit(None).alias("x")).select("track", (F.row_number().over(W.orderBy("track")) * (1 << 33)).alias("line_no"))  # one row a track
    heads = first.select("line_no", F.concat(F.lit('track name="'), "track", F.lit('" description="events"')).alias("value"))
    rows = feature.join(first, "track").select((F.col("line_no") + 1 + F.col("fid")).alias("line_no"), F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value"))
    return heads.unionByName(rows)
