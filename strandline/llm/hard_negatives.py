"""Hard negatives by bounds along trees of anchors.

Anchors of a label that lie near each other form a group, whose minimum spanning tree is found.
Every group meets every block of vectors.  The root's scores are exact.  A child's score of a
candidate x lies within (edge length) * |x| of its parent's, so each anchor has bounds of all its
scores before it looks at a vector, and scores exactly only those whose bounds meet what it
looks for: first its positives (above the best lower bounds of its label), then the windows that
the positives' scores open for other labels.  Exact scores narrow the bounds of the anchors below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ranked
from .vectors import BLOCK, LOWEST, Ids, blocks, chosen, extent, leading, matrix, prepared, products, written

#: Anchors of a group at most, shards that the blocks of vectors are dealt to at most, pivots that order the anchors.
TOGETHER, SHARDS, PIVOTS = 256, 4096, 64


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length) of a minimum spanning tree over the rows of x, by Prim's rule: the root comes first (parent -1) and parents before children."""
    n = len(x)
    x = x.astype(np.float64)
    near, via, order = np.full(n, np.inf), np.full(n, -1), []
    at = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    near[at] = 0
    left = np.ones(n, bool)
    length = np.zeros(n)
    for _ in range(n):
        at = int(np.where(left, near, np.inf).argmin())
        order.append(at)
        left[at] = False
        length[at] = np.sqrt(near[at])
        far = ((x - x[at]) ** 2).sum(1)
        closer = left & (far < near)
        near[closer], via[closer] = far[closer], at
    return np.array(order), via, length


class Bounds:
    """Lower and upper bounds of the scores of a group's anchors against a block, narrowed along the tree."""

    def __init__(self, anchors: np.ndarray, parent: np.ndarray, length: np.ndarray, theirs: np.ndarray):
        self.anchors, self.theirs, self.parent, self.length = anchors, theirs, parent, length
        self.norm = np.sqrt((theirs.astype(np.float64) ** 2).sum(1))
        self.low, self.high = np.empty((2, len(anchors), len(theirs)))
        self.scored = 0

    def open(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of anchor a, from its parent's; the root's are exact."""
        if self.parent[a] < 0:
            self.exact(a, np.ones(len(self.theirs), bool))
        else:
            reach = self.length[a] * self.norm
            reach = reach + 1e-9 * reach + 1e-3  # rounding never leaves a score out
            self.low[a], self.high[a] = self.low[self.parent[a]] - reach, self.high[self.parent[a]] + reach
        return self.low[a], self.high[a]

    def exact(self, a: int, which: np.ndarray) -> np.ndarray:
        """Scores of anchor a where ``which`` holds, LOWEST elsewhere."""
        out = np.full(len(self.theirs), LOWEST)
        if which.sum() * 2 > len(which):
            out[which] = products(self.anchors[a : a + 1], self.theirs)[0][which]
        elif which.any():
            out[which] = products(self.anchors[a : a + 1], self.theirs[which])[0]
        self.low[a][which] = self.high[a][which] = out[which]
        self.scored += int(which.sum())
        return out


def groups_of(rows: DataFrame, every: int, dim: int) -> DataFrame:
    """group, rows, labels, vecs, sequence, parent, length: the anchors by label and place, with the tree of each group (``sequence`` has parents first)."""
    own = rows.filter(F.col("vec_id") % every == 0)
    pivots = chosen(own, dim, PIVOTS)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), dim).astype(np.float64)
            far = (x**2).sum(1)[:, None] + (shared.value**2).sum(1)[None, :] - 2 * (x @ shared.value.T)
            at = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far[np.arange(len(at)), at])], names=["row", "label", "vec", "pivot", "dist"])

    placed = own.select("row", "label", "vec").mapInArrow(near, "row long, label int, vec array<int>, pivot int, dist double")
    placed = ranked(placed, F.col("label"), F.col("pivot"), F.col("dist"), F.col("row"), name="place")
    gathered = placed.groupBy(F.floor(F.col("place") / TOGETHER).alias("group")).agg(F.collect_list(F.struct("row", "label", "vec")).alias("a"))  # at most TOGETHER
    gathered = gathered.select("group", F.col("a.row").alias("rows"), F.col("a.label").alias("labels"), F.col("a.vec").alias("vecs"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = matrix(batch.column(3)[i].values, dim)
                order, parent, length = spanning_tree(x)
                cells = [pa.array([x.ravel()], pa.list_(pa.int32())), pa.array([order], pa.list_(pa.int64())), pa.array([parent], pa.list_(pa.int64())), pa.array([length], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), *cells], names=["group", "rows", "labels", "vecs", "sequence", "parent", "length"])

    return written(gathered.mapInArrow(grow, "group long, rows array<long>, labels array<int>, vecs array<int>, sequence array<long>, parent array<long>, length array<double>"), "anchor-trees")


def _cell(batch: pa.RecordBatch, k: int, i: int) -> np.ndarray:
    return batch.column(k)[i].values.to_numpy(zero_copy_only=False)


GROUP = ["rows", "labels", "vecs", "sequence", "parent", "length"]
BLOCKS = ["_rows", "_ids", "_labels", "_vecs"]


def met(groups: DataFrame, block: DataFrame, shards: int, *more: str) -> DataFrame:
    """Every group with every block: a group goes once to each shard. Few bytes mean much work here, so a shard is a task, however small."""
    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(shards, "shard")
    return everywhere.join(block.toDF("shard", *BLOCKS).repartition(shards, "shard"), "shard").select(*GROUP, *BLOCKS, *more)


def _opened(batch: pa.RecordBatch, i: int, dim: int) -> tuple:
    rows, labels, vecs, order, parent, length = (_cell(batch, k, i) for k in range(6))
    theirs, ids, kinds = _cell(batch, 6, i), Ids(batch.column(7)[i].values), _cell(batch, 8, i)
    bounds = Bounds(vecs.reshape(len(rows), dim), parent, length, _cell(batch, 9, i).reshape(len(theirs), dim))
    return rows, labels, order, theirs, ids, kinds, bounds


def positives(groups: DataFrame, block: DataFrame, shards: int, dim: int, k: int) -> DataFrame:
    """anchor, row, vec_id, score: the k best other rows of each anchor's label (anchor and row are row numbers)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, labels, order, theirs, ids, kinds, bounds = _opened(batch, i, dim)
                s = np.full((len(rows), len(theirs)), LOWEST)
                for a in order:
                    low, high = bounds.open(a)
                    own = (kinds == labels[a]) & (theirs != rows[a])
                    if own.sum() > k:
                        own &= high >= np.partition(low[own], -k)[-k]
                    s[a] = bounds.exact(a, own)
                line, col = leading(s, ids.order, theirs, k)
                yield pa.RecordBatch.from_arrays([pa.array(rows[line]), pa.array(theirs[col]), ids.values.take(pa.array(col)), pa.array(s[line, col])], names=["anchor", "row", "vec_id", "score"])

    found = met(groups, block, shards).mapInArrow(each, "anchor long, row long, vec_id long, score long")
    w = W.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return written(found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k), "positives")


def negatives(groups: DataFrame, positive: DataFrame, block: DataFrame, shards: int, dim: int, k: int, share: tuple[int, int]) -> DataFrame:
    """anchor, place, row, vec_id, score, rank: the k best rows of other labels in the window of each positive (by its place)."""
    num, den = share
    given = F.collect_list(F.struct(F.col("anchor").alias("row"), "place", "score"))
    windows = positive.join(groups.select("group", F.explode("rows").alias("anchor")), "anchor").groupBy("group").agg(given.alias("p"))  # at most k * TOGETHER
    windows = windows.select("group", F.col("p.row").alias("_prow"), F.col("p.place").alias("_place"), F.col("p.score").alias("_score"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, labels, order, theirs, ids, kinds, bounds = _opened(batch, i, dim)
                prow, place, score = (_cell(batch, k_, i) for k_ in (10, 11, 12))
                anchor, at, where, scores = [], [], [], []
                for a in order:
                    low, high = bounds.open(a)
                    own = (prow == rows[a]) & (score >= 0)  # the window of a negative score is empty
                    if not own.any():
                        continue
                    least, most = -(-score[own] * num // den), score[own]
                    near = np.zeros(len(theirs), bool)
                    for lo, hi in zip(least, most, strict=True):
                        near |= (high >= lo) & (low <= hi)
                    s = bounds.exact(a, near & (kinds != labels[a]))
                    within = np.stack([np.where((s >= lo) & (s <= hi), s, LOWEST) for lo, hi in zip(least, most, strict=True)])
                    line, col = leading(within, ids.order, theirs, k)
                    anchor.append(np.full(len(line), rows[a]))
                    at.append(place[own][line])
                    where.append(col)
                    scores.append(s[col])
                if anchor:
                    col = np.concatenate(where)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchor)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(theirs[col]), ids.values.take(pa.array(col)), pa.array(np.concatenate(scores))], names=["anchor", "place", "row", "vec_id", "score"])

    found = met(groups.join(windows, "group"), block, shards, "_prow", "_place", "_score").mapInArrow(each, "anchor long, place int, row long, vec_id long, score long")
    w = W.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return written(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "negatives")


def mine(vectors: DataFrame, k: int = 5, every: int = 100, share: tuple[int, int] = (80, 100), relabel: int | None = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``, an anchor's positives its k best other rows
    of its label, a positive's negatives the k best rows of other labels that score from
    share[0] / share[1] of the positive's score up to it.  Where the id is divisible by ``relabel``
    the label is first (label + 1) % 10.

    Rows with a null label or vector, or with null or non-finite components, take no part; shorter
    vectors end in zeros; components are held within vectors.LARGEST.  Ties go to the smaller id, a
    null id last; a row without an id is a candidate and no anchor.  Repeated rows are anchors and
    candidates each of its own.  A positive of negative score has no negatives; an empty table gives
    no rows; other columns are left behind.
    """
    label = F.col(label_col).cast("int")
    if relabel:
        label = F.when(F.col(id_col) % relabel == 0, (label + 1) % 10).otherwise(label)
    rows = prepared(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), label.alias("label")), label_col="label")
    n, dim, _ = extent(rows)
    shards = max(1, min(SHARDS, n // BLOCK))
    groups, block = groups_of(rows, every, dim), blocks(rows, dim, shards)
    positive = positives(groups, block, shards, dim, k)
    negative = negatives(groups, positive, block, shards, dim, k, share)
    named = rows.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = positive.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(named, "anchor")
    out = negative.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
