"""Sharding by extendible hashing.

A directory is indexed by hash-prefix bits.  A bucket that holds more bytes than the limit splits
on its next bit, and only such buckets do, until every shard fits.  Bytes are summed once at a
fine prefix; the sums of all coarser prefixes follow from those few cells, and only cells that
are still too large are looked at again with further bits.

The hash is 60 bits of md5 over id and text, followed by the 60 bits of the row's number in the
written table, the fastest changing ones first.  Numbers are unique, so even a crowd of identical
rows splits evenly, and no two rows are alike to the last bit.

The only table that reaches every task is the split cells' list, a row for each cell in use (some
100 bytes for each 1/8 of a shard's bytes: 25 MB for 30 GB in shards of 1 MB, 100 GB in shards of
1 GB); no hint forces it, Spark's own size check decides between broadcast and shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, hash60, keyed, rowed

BITS = 60


def _settle(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """Cells (root, cell, bytes, docs) of ``bits`` bits -> root, cell, depth (below root), shard_bytes, shard_docs; depth is null where the cell itself must be split.

    A bucket is settled when it fits or holds a single document.
    """
    at = cells.withColumn("depth", F.explode(F.expr(f"sequence(0, {bits})")))
    sums = at.groupBy("root", "depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix")).agg(F.sum("bytes").alias("b"), F.sum("docs").alias("n"))
    fits = sums.filter((F.col("b") <= limit) | (F.col("n") == 1))
    own = at.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)")).join(fits, ["root", "depth", "prefix"])
    first = own.groupBy("root", "cell").agg(F.min(F.struct("depth", "b", "n")).alias("x"))
    return cells.join(first, ["root", "cell"], "left").select("root", "cell", "x.depth", F.col("x.b").alias("shard_bytes"), F.col("x.n").alias("shard_docs"))


def shard(docs: DataFrame, limit_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Row key, doc_id, bytes, shard, depth, shard_bytes, shard_docs, oversized for every row.

    ``shard`` is the bit prefix that names the shard ('' when all fits in one).  A single document
    above the limit is a shard of its own and marked ``oversized``.  Null and empty texts have 0
    bytes and are placed by their hash like any other; equal rows are told apart by their place in
    the written table; an empty table gives no rows.  With ``carry``, a column ``row`` holds all
    columns of the row, whatever their names.
    """
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    kept = ["row"] if carry else []
    if carry:
        rows = rowed(docs, id_col, text_col).select("*", F.col(f"row.`{id_col}`").alias(id_col), F.col(f"row.`{text_col}`").alias(text_col))
    rows = rows.select(*KEY, *kept, F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), hash60(id_col, text_col).alias("h"))
    rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    rows = rows.withColumn("_h2", F.conv(F.substring(F.reverse(F.lpad(F.bin("_row"), 64, "0")), 1, BITS), 2, 10).cast("long"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    step = min(20, max(4, math.ceil(math.log2(max(1, total / limit_bytes))) + 3))
    open_rows, done, used = rows.withColumn("root", F.lit("")), [], 0
    as_bits = lambda value, n: F.lpad(F.bin(value), n, "0")
    while True:
        bits = min(step, BITS - used % BITS)
        source = "h" if used < BITS else "_h2"
        low = BITS - used % BITS - bits
        open_rows = open_rows.withColumn("cell", F.shiftright(source, low).bitwiseAND((1 << bits) - 1))
        cells = durable(open_rows.groupBy("root", "cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "shard-cells")
        settled = durable(_settle(cells, bits, limit_bytes), "shard-settled")
        placed = open_rows.join(settled, ["root", "cell"])
        name = F.when(F.col("depth") == 0, F.col("root")).otherwise(F.concat("root", F.expr(f"substring(lpad(bin(cell), {bits}, '0'), 1, depth)")))
        done.append(placed.filter("depth is not null").withColumns({"shard": name, "oversized": F.col("shard_bytes") > limit_bytes}))
        used += bits
        rest = settled.filter("depth is null")
        if rest.isEmpty():
            break
        if used >= 2 * BITS:
            raise ValueError("the table has more rows than the hash can tell apart")
        open_rows = durable(open_rows.join(rest.select("root", "cell"), ["root", "cell"]).withColumn("root", F.concat("root", as_bits("cell", bits))).drop("cell"), "shard-open")
    out = None
    for part in done:
        part = part.select(*KEY, *kept, "doc_id", "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs", "oversized")
        out = part if out is None else out.unionByName(part)
    return out


def directory(assigned: DataFrame) -> DataFrame:
    """The directory of shard(): shard, depth, shard_bytes, shard_docs, oversized, one row a shard."""
    return assigned.select("shard", "depth", "shard_bytes", "shard_docs", "oversized").distinct()


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write docs as Parquet under path/shard=<prefix>, one folder a shard.

    Every row goes where shard() puts it, equal rows too.  Where docs has a column ``shard``, the
    folders' column is called ``_shard`` (or has more underscores), and docs' own stays as it is.
    """
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    out = shard(docs, **how, carry=True).select("row.*", F.col("shard").alias(name))
    out.repartition(name).write.partitionBy(name).parquet(path)
