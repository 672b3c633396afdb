"""Exact top-k search by inner product, through an index of pivots and distances.

Vectors get one more component that gives all of them the same length; a query's is 0.  Then the
nearest vectors are those of the highest scores.  Every vector is keyed by its nearest pivot and
its distance to it.  Sorted by that key, the vectors of a pivot form annuli (``ring``).  By the
triangle inequality nothing in an annulus of distances r to s around a pivot is nearer to a query
than r - d or d - s, where d is the query's distance to that pivot.  Each query takes annuli in the
order of these bounds, more in each round, and stops once its k-th best is nearer than all bounds
left.  Pivots are fitted on a bounded sample; every vector is indexed, and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, durable, ranked
from .vectors import BLOCK, LOWEST, Ids, chosen, extent, leading, matrix, prepared, products, written

#: Pivots at most, annuli at most besides one a pivot, queries looked at together, annuli a query takes in the first round and growth by round.
PIVOTS, RINGS, TOGETHER, FIRST, GROWTH = 256, 4096, 512, 2, 8


def lifted(x: np.ndarray, top: int) -> np.ndarray:
    """Data vectors with the component that makes every squared length ``top``."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def keyed_by_pivot(rows: DataFrame, pivots: np.ndarray, dim: int, top: int) -> DataFrame:
    """row, vec_id, vec with pivot (the nearest) and dist."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(lifted(matrix(batch.column(2), dim), top), shared.value)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["row", "vec_id", "vec", "pivot", "dist"])

    return rows.select("row", "vec_id", "vec").mapInArrow(each, "row long, vec_id long, vec array<int>, pivot int, dist double")


def indexed(rows: DataFrame, pivots: np.ndarray, n: int, dim: int, top: int) -> DataFrame:
    """pivot, ring, low, high, rows, ids, vecs: the vectors by pivot and distance, in annuli of equal count, each in blocks of at most BLOCK."""
    place = ranked(keyed_by_pivot(rows, pivots, dim, top), F.col("pivot"), F.col("dist"), F.col("row"), name="place")
    first = place.groupBy("pivot").agg(F.min("place").alias("_first"))  # a row a pivot
    wide = max(BLOCK, -(-n // RINGS))
    at = place.join(F.broadcast(first), "pivot").withColumn("_at", F.col("place") - F.col("_first"))
    key = ["pivot", F.floor(F.col("_at") / wide).cast("int").alias("ring"), F.floor(F.col("_at") % wide / BLOCK).cast("int").alias("_block")]
    block = at.groupBy(*key).agg(F.collect_list(F.struct("row", "vec_id", "vec", "dist")).alias("v"))  # at most BLOCK
    index = durable(block.select("pivot", "ring", F.array_min("v.dist").alias("low"), F.array_max("v.dist").alias("high"), F.col("v.row").alias("rows"), F.col("v.vec_id").alias("ids"), F.flatten(
        F.transform("v.vec", lambda x: F.concat(x, F.array_repeat(F.lit(0), F.lit(dim) - F.size(x))))).alias("vecs")), "annuli")
    discard(place)
    return index


def queries_of(rows: DataFrame, every: int, pivots: np.ndarray, dim: int, top: int) -> DataFrame:
    """group, rows, vecs: the queries, near ones together, at most TOGETHER a group."""
    own = keyed_by_pivot(rows.filter(F.col("vec_id") % every == 0), pivots, dim, top)
    place = ranked(own, F.col("pivot"), F.col("dist"), F.col("row"), name="place")
    group = place.groupBy(F.floor(F.col("place") / TOGETHER).alias("group")).agg(F.collect_list(F.struct("row", "vec")).alias("q"))
    return durable(group.select("group", F.col("q.row").alias("rows"), F.flatten(F.transform("q.vec", lambda x: F.concat(x, F.array_repeat(F.lit(0), F.lit(dim) - F.size(x))))).alias("vecs")), "search-queries")


def needed(groups: DataFrame, best: DataFrame | None, rings: np.ndarray, pivots: np.ndarray, dim: int, top: int, k: int, since: int, upto: int) -> DataFrame:
    """pivot, ring, group, rows, vecs: of each query's annuli in the order of their bounds, those from place ``since`` to ``upto`` that may hold one of its k best."""
    if best is None:
        state = groups.withColumn("bounds", F.array().cast("array<struct<row:long,least:long>>"))
    else:
        held = best.groupBy("group", "query").agg(F.count("*").alias("_n"), F.min("score").alias("least")).filter(F.col("_n") == k)
        state = groups.join(held.groupBy("group").agg(F.collect_list(F.struct(F.col("query").alias("row"), "least")).alias("bounds")), "group", "left")
    shared = groups.sparkSession.sparkContext.broadcast((pivots, rings))  # at most RINGS + PIVOTS lines
    out = ["pivot", "ring", "group", "rows", "vecs"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rings = shared.value
        which = rings[:, 0].astype(int)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(1)[i].values.to_numpy()
                vecs = batch.column(2)[i].values.to_numpy().reshape(len(rows), dim).astype(np.float64)
                d = distances(np.hstack([vecs, np.zeros((len(rows), 1))]), pivots)[:, which]
                bound = np.maximum(np.maximum(rings[:, 2] - d, d - rings[:, 3]), 0)
                order = np.lexsort((np.abs(rings[:, 2] + rings[:, 3] - 2 * d), bound))  # of equal bounds, where the query lies most inside
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(rings))[None, :], 1)
                reach = np.full(len(rows), np.inf)
                least = batch.column(3)[i].as_py() or []
                if least:
                    at = {int(r): j for j, r in enumerate(rows)}
                    j = np.array([at[x["row"]] for x in least])
                    reach[j] = np.sqrt(np.maximum((vecs[j] ** 2).sum(1) + top - 2.0 * np.array([x["least"] for x in least]), 0))
                slack = 1e-6 * (np.sqrt(top) + np.sqrt((vecs**2).sum(1))) + 1e-6  # rounding never leaves an annulus out
                take = (place >= since) & (place < upto) & (bound <= (reach + slack)[:, None])
                full = batch.column(2)[i].values.to_numpy().reshape(len(rows), dim)
                for ring in np.flatnonzero(take.any(0)):
                    q = take[:, ring]
                    cells = [pa.array([which[ring]], pa.int32()), pa.array([int(rings[ring, 1])], pa.int32()), batch.column(0).slice(i, 1), pa.array([rows[q]], pa.list_(pa.int64())), pa.array([full[q].ravel()], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cells, names=out)

    return state.select("group", "rows", "vecs", "bounds").mapInArrow(each, "pivot int, ring int, group long, rows array<long>, vecs array<int>")


def scored(pairs: DataFrame, index: DataFrame, tasks: int, dim: int, k: int) -> DataFrame:
    """group, query, row, vec_id, score: the k best of each query in each block that it takes; a row is no candidate of its own.

    Few bytes mean much work here, so the annuli go to ``tasks`` tasks, however small they are.
    """
    met = pairs.repartition(tasks, "pivot", "ring").join(index.repartition(tasks, "pivot", "ring").select("pivot", "ring", F.col("rows").alias("_rows"), F.col("ids").alias("_ids"), F.col("vecs").alias("_vecs")), ["pivot", "ring"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group, q, mine = batch.column(0)[i].as_py(), batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
                rows, ids, theirs = batch.column(3)[i].values.to_numpy(), Ids(batch.column(4)[i].values), batch.column(5)[i].values.to_numpy()
                s = products(mine.reshape(len(q), dim), theirs.reshape(len(rows), dim))
                s[q[:, None] == rows[None, :]] = LOWEST
                line, col = leading(s, ids.order, rows, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(line), group)), pa.array(q[line]), pa.array(rows[col]), ids.values.take(pa.array(col)), pa.array(s[line, col])], names=["group", "query", "row", "vec_id", "score"])

    return met.select("group", "rows", "vecs", "_rows", "_ids", "_vecs").mapInArrow(each, "group long, query long, row long, vec_id long, score long")


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k highest scores among all other rows.

    Vectors that are null or hold null or non-finite components take no part; shorter vectors end
    in zeros; components are held within LARGEST.  Ties go to the smaller vec_id, a null id last.  A
    row without an id is a candidate and no query.  Repeated rows are queries and candidates each of
    its own.  Fewer candidates than k are all returned; an empty table gives no rows; other columns
    are left behind.
    """
    rows = prepared(vectors, id_col, vector_col)
    n, dim, top = extent(rows)
    pivots = lifted(chosen(rows, dim, min(PIVOTS, -(-n // (2 * BLOCK)))), top)
    best = None
    if n:
        index = indexed(rows, pivots, n, dim, top)
        listed = index.groupBy("pivot", "ring").agg(F.min("low"), F.max("high")).orderBy("pivot", "ring").collect()  # at most RINGS + PIVOTS rows
        rings = np.array([tuple(r) for r in listed])
        groups = queries_of(rows, every, pivots, dim, top)
        since, upto = 0, FIRST
        while since < len(rings):
            pairs = written(needed(groups, best, rings, pivots, dim, top, k, since, upto), "search-pairs")
            if pairs.isEmpty():
                discard(pairs)
                break
            found = scored(pairs, index, len(rings), dim, k)
            found = found if best is None else found.unionByName(best)
            w = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
            before, best = best, written(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank"), "search-best")
            for old in [pairs, *([before] if before is not None else [])]:
                discard(old)
            since, upto = upto, upto * GROWTH
    if best is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    w = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ids = rows.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.withColumn("rank", F.row_number().over(w)).join(ids, "query").select("query_id", "rank", "vec_id", "score")
