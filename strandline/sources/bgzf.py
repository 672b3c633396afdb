"""Block gzip: compressed text that is read and written in parallel.

A block-gzip file is a series of gzip members of at most 64 KB, each of which names its own
compressed size; any gzip tool can read it.  Its members begin with the same bytes, so Spark's
text source finds them: that header is the separator of its records, and a file is split between
records.  What a split decompresses begins and ends within lines; only these ends are put
together across splits.

Spark decompresses names that end in ``.gz`` itself, with one task a file; files are read in
splits under any other name, such as ``.bgz``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import durable

#: Beginning of every member (fixed value): gzip, deflate, an extra field of 6 bytes "BC" that holds the size; no time, unknown system.
HEADER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"

#: The empty member at the end of a file (fixed value).
LAST = HEADER + b"\x1b\x00\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"

#: Bytes of text a member holds at most, and decompressed bytes a batch of rows is made of.
MEMBER, BATCH = 65280, 1 << 24

#: Every member ends with the length of its text, of which the upper two bytes are 0: the separator in writing.
TAIL = "\0\0"


def inflated(body: bytes) -> bytes:
    """The text of a member without its header; an error where the member is damaged."""
    if len(body) < 10 or struct.unpack_from("<H", body)[0] + 1 != len(HEADER) + len(body):
        raise ValueError("damaged block gzip: size of a block")
    text = zlib.decompress(body[2:-8], -15)
    if struct.unpack_from("<II", body, len(body) - 8) != (zlib.crc32(text), len(text)):
        raise ValueError("damaged block gzip: checksum of a block")
    return text


def deflated(text: bytes) -> bytes:
    """A member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(text) + pack.flush()
    return HEADER + struct.pack("<H", len(HEADER) + len(body) + 9) + body + struct.pack("<II", zlib.crc32(text), len(text))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members in file order to lines: file, value, head (it goes on from the split before) and open (it goes on in the next split).

    Every split ends with an open piece, be it empty, and every split but a file's first begins with
    a head; a split without a line end is one piece that is both.
    """
    def rows(file, values, head, open_):
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(values, pa.binary()), pa.array([head] + [False] * (n - 1) if n else [], pa.bool_()), pa.array([open_] * n, pa.bool_())], names=["file", "value", "head", "open"])

    def ended(file, kept, head):
        *lines, rest = b"".join(kept).split(b"\n")
        if lines:
            yield rows(file, lines, head, False)
        yield rows(file, [rest], head and not lines, True)

    at, head, kept, size = None, False, [], 0
    for batch in batches:
        for file, start, body in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != at:
                if at is not None:
                    yield from ended(at[0], kept, head)
                at, head, kept, size = (file, start), start > 0, [], 0
            if not body:
                continue
            text = inflated(body)
            kept.append(text)
            size += len(text)
            if size >= BATCH and b"\n" in text:
                *lines, rest = b"".join(kept).split(b"\n")
                yield rows(file, lines, head, False)
                head, kept, size = False, [rest], len(rest)
    if at is not None:
        yield from ended(at[0], kept, head)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """value, file, line_no (order within the file) of block-gzip text, as lines.read() gives them.

    Lines end with a line feed, before which a carriage return is left out.  Lines of any length
    may run over any number of splits; an empty file has no lines; damaged blocks raise an error
    (a file cut between two blocks does not).
    The decompressed text is written to the shared folder once.
    """
    blocks = spark.read.option("lineSep", HEADER.decode("latin-1")).option("encoding", "ISO-8859-1").text(list(paths))
    blocks = blocks.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("body"))
    cut = blocks.mapInArrow(_cut, "file string, value binary, head boolean, open boolean").withColumn("line_no", F.monotonically_increasing_id())
    cut = durable(cut, "bgzf-lines")
    line = F.col("value").cast("string")
    text = F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value")
    whole = cut.filter("not head and not open")
    # a piece or two for each split: the lines that cross from split to split
    piece = cut.filter("head or open").withColumn("line", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(W.partitionBy("file").orderBy("line_no")))
    joined = piece.groupBy("file", "line").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("p"), F.bool_and("open").alias("open"))
    joined = joined.withColumn("value", F.array_join(F.transform("p.value", lambda v: v.cast("string")), ""))
    # what is still open where the file ends is a line only if there is something in it
    joined = joined.filter("not open or value <> ''")
    return whole.select(text, "file", "line_no").unionByName(joined.select(text, "file", "line_no"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to members without their last two bytes; the file's empty member comes last."""
    kept = bytearray()
    for batch in batches:
        out = []
        for line in batch.column(0).to_pylist():
            kept += line
            kept += b"\n"
            if len(kept) >= MEMBER:
                full = len(kept) - len(kept) % MEMBER
                out += [deflated(bytes(kept[i : i + MEMBER]))[:-2] for i in range(0, full, MEMBER)]
                del kept[:full]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    rest = [deflated(bytes(kept))] if kept else []
    yield pa.RecordBatch.from_arrays([pa.array([m[:-2] for m in (*rest, LAST)], pa.binary())], names=["value"])


def write(df: DataFrame, path: str) -> None:
    """Text of the column value (null: an empty line) as a folder of block-gzip files, one for each partition of df."""
    lines = df.select(F.coalesce(F.col("value"), F.lit("")).cast("binary").alias("value"))
    lines.mapInArrow(_packed, "value binary").select(F.col("value").cast("string")).write.option("lineSep", TAIL).text(path)
