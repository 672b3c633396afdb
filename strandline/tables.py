"""Tables written to the shared folder, to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders of a partitioned table that are written at most, or nearly so: each costs a file and a listing, whatever it holds.
FOLDERS = 2048

#: Rows that one task sorts, or nearly so, in tables dealt by spread().
ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is unset, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), "strandline-shared")
    return where.rstrip("/")


def durable(df: DataFrame, label: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df there as Parquet (in folders by column ``by``) and read it back; the files outlive executors. discard() removes them."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    write = df.write.option("compression", codec)
    (write.partitionBy(by) if by else write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def laid_out(df: DataFrame, by: str, label: str, group: int = 1 << 20) -> DataFrame:
    """durable(), sorted by one column over all files, in row groups of about ``group`` bytes with statistics and bloom filters of that column."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    write = df.repartitionByRange(by).sortWithinPartitions(by).write.option("compression", "zstd").option("parquet.block.size", group)
    write.option(f"parquet.bloom.filter.enabled#{by}", "true").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def bucketed(df: DataFrame, by: str, label: str) -> DataFrame:
    """durable(), in buckets by one column and sorted by it within each: joins on that column leave this side where it is. discard() removes it.

    There are as many buckets as shuffle partitions, so that the other side of a join is shuffled
    to them; rows come in by one shuffle, which distinct rows of the table need no other beside.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"strandline_{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, by).sortBy(by).saveAsTable(name)
    out = spark.table(name)
    out._strandline_path, out._strandline_table = path, name
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by durable() or bucketed() that no later result reads."""
    spark = df.sparkSession
    if "_strandline_table" in vars(df):
        spark.sql(f"DROP TABLE IF EXISTS {df._strandline_table}")
    target = spark._jvm.org.apache.hadoop.fs.Path(df._strandline_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df, of about ``rows`` rows, dealt by some columns so that a task sorts about ROWS of them, whatever their number; tables of fewer are left to Spark.

    Spark's own partitions follow the bytes of compressed shuffle files, of which a sort in memory takes many times as much.
    """
    if rows <= ROWS:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *by)


def running(df: DataFrame, by: list[str], order: list[str], what: dict[str, tuple[str, str]]) -> DataFrame:
    """df with running values over its rows in order, within groups ``by`` of any size.

    ``what`` names each new column and gives it (kind, column): "sum" up to the row, "max" of the
    rows before it, "last" value that is not null up to the row, the same "before" the row, or
    "count" of rows up to it.
    Rows are sorted in ranges and written; what a range carries over to the next is a row for each
    range and group, and only these go through one window.  No task gets a whole group.
    """
    return carried(ranged(df, [*by, *order]), by, ["_at"], what).drop("_at", "_range")


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted in ranges and written, with each row's place ``_at`` and its range ``_range``, both ascending with the order."""
    part = durable(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    return part.withColumn("_range", F.shiftright("_at", 33).cast("int"))


def carried(part: DataFrame, by: list[str], order: list[str], what: dict[str, tuple[str, str]]) -> DataFrame:
    """running() for rows that are already in ranges: ``_range`` ascends with the order."""
    whole, own = W.partitionBy(*by).orderBy("_range"), W.partitionBy(*by, "_range").orderBy(*order)
    upto, before = (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True)
    ends, carry, rows = [], [], {}
    for name, (kind, col) in what.items():
        c = F.lit(1) if kind == "count" else F.col(col)
        if kind in ("last", "before"):
            ends.append(F.max_by(c, F.when(c.isNotNull(), F.col(order[0]))).alias(name))
            carry.append(last(name).over(whole.rowsBetween(*before)).alias(f"_{name}"))
            rows[name] = F.coalesce(last(c).over(own.rowsBetween(*(upto if kind == "last" else before))), F.col(f"_{name}"))
        elif kind == "max":
            ends.append(F.max(c).alias(name))
            carry.append(F.max(name).over(whole.rowsBetween(*before)).alias(f"_{name}"))
            rows[name] = F.greatest(F.max(c).over(own.rowsBetween(*before)), F.col(f"_{name}"))
        else:
            ends.append(F.sum(c).alias(name))
            carry.append(F.sum(name).over(whole.rowsBetween(*before)).alias(f"_{name}"))
            rows[name] = (F.sum(c).over(own.rowsBetween(*upto)) + F.coalesce(F.col(f"_{name}"), F.lit(0))).cast("long")
    over = part.groupBy(*by, "_range").agg(*ends).select(*by, "_range", *carry)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*by, "_range")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = part.alias("p").join(over.alias("o"), on).select("p.*", *(f"o._{name}" for name in what))
    return joined.withColumns(rows).drop(*(f"_{name}" for name in what))
