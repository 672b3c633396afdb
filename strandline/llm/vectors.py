"""Vectors of whole numbers in blocks, for the searches over embeddings.

A component x becomes floor(256 * x).  Scores are inner products of whole numbers and exact: 64-bit
floats where every sum stays below 2^53, else 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches

#: Components beyond this are held at it, so that no score of up to 2048 components leaves 64 bits.
LARGEST = 1 << 26
#: Rows of a block of vectors, and rows that are looked at for pivots.
BLOCK, SAMPLE = 2048, 2048
LOWEST = np.iinfo(np.int64).min


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """row, vec_id, label, vec (whole numbers) and norm2, as a written table: a row for each vector that takes part.

    Vectors that are null or hold a null, NaN or infinite component take no part, nor do rows
    without a label where there is a label column.  ``row`` tells repeated rows apart.
    """
    vec, label = F.col(vector_col), F.col(label_col).cast("int") if label_col else F.lit(0)
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vec, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(-1e15)), F.lit(1e15))), F.lit(-LARGEST).cast("long")), F.lit(LARGEST).cast("long")).cast("int"))
    rows = vectors.filter(vec.isNotNull() & ~odd & label.isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), whole.alias("vec"))
    norm2 = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    return durable(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vec", norm2.alias("norm2")), "vectors")


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """A list array as rows of ``dim`` whole numbers; shorter vectors end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def leading(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, column) of the k best of each line of scores, LOWEST left out: higher scores first, then smaller ids, null ids (NaN) last, then rows."""
    if scores.shape[1] > k:
        bound = np.partition(scores, -k, axis=1)[:, -k]
        line, col = np.nonzero((scores >= bound[:, None]) & (scores > LOWEST))
    else:
        line, col = np.nonzero(scores > LOWEST)
    order = np.lexsort((rows[col], ids[col], np.isnan(ids[col]), -scores[line, col], line))
    line, col = line[order], col[order]
    first = np.searchsorted(line, line)
    keep = np.arange(len(line)) - first < k
    return line[keep], col[keep]


class Ids:
    """Vector ids of a block, null ones told apart; floats only order them below 2^53, so the order is by rank."""

    def __init__(self, ids: pa.Array):
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.values, self.null = ids, ids.is_null().to_numpy(zero_copy_only=False)
        rank = np.unique(known, return_inverse=True)[1].astype(np.float64)
        self.order = np.where(self.null, np.nan, rank)


def extent(rows: DataFrame) -> tuple[int, int, int]:
    """How many vectors there are, their most components, the largest squared length."""
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("vec")), F.max("norm2")).first()
    return n, dim or 0, top or 0


def chosen(rows: DataFrame, dim: int, count: int) -> np.ndarray:
    """``count`` pivots of at most SAMPLE rows (those first by a hash): each the farthest from those before it."""
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vec").toArrow()["vec"]
    if not len(sample) or not count:
        return np.zeros((0, dim))
    x = matrix(sample, dim).astype(np.float64)
    at, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(at) < min(count, len(x)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def blocks(rows: DataFrame, dim: int, shards: int) -> DataFrame:
    """shard, rows, ids, labels, vecs: the vectors of a written table in blocks of at most BLOCK, as they are read, each dealt to a shard by its first row."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            whole = [t.column(k).combine_chunks() for k in range(4)]
            cells = [whole[0].slice(0, 1), *(one(c) for c in whole[:3]), one(pa.array(matrix(whole[3], dim).ravel()))]
            return pa.RecordBatch.from_arrays(cells, names=["first", "rows", "ids", "labels", "vecs"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, BLOCK - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == BLOCK:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    packed = rows.select("row", "vec_id", "label", "vec").mapInArrow(pack, "first long, rows array<long>, ids array<long>, labels array<int>, vecs array<int>")
    return durable(packed.select(F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int").alias("shard"), "rows", "ids", "labels", "vecs"), "blocks")


def written(df: DataFrame, label: str, rows: int = 16) -> DataFrame:
    """durable() with few rows a batch, for rows that hold blocks."""
    with small_batches(df.sparkSession, rows):
        return durable(df, label)
