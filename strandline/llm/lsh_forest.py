"""N-gram Jaccard join by a MinHash LSH forest.

Every distinct set of word shingles has a signature of 6 minhashes for each of 16 trees, and each
tree is a prefix trie of its signatures: a node holds the texts that share a prefix.  A text
looks for partners at its full prefixes first and shortens them one at a time, always where this
brings the fewest new members for what it adds to the recall, until a partner at the threshold
would be found with the target probability.  So the depth at which a text searches differs from
text to text and from tree to tree: crowded nodes are left early and empty ones entered deeply.
What meets at a searched node is compared exactly.

The tries are kept as the table of their nodes (tree, prefix of 3 to 6, members), counted by hash
aggregation in place of a sort, which has the same nodes and no hot range.

Copies (equal sets) count as one text with a weight.  A node's members are compared in blocks, so
that a node of any size spreads over many tasks; a pair that meets in several trees is counted in
the first alone, and no pair leaves its task: out come link counts and a spanning star of each
block.  Classes are the connected components of these stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, discard, durable, keyed, small_batches, word_list
from .windows import mixed

#: Trees, full and least length of a prefix, members and shingles of a block.
TREES, DEEPEST, LEAST, MEMBERS, SHINGLES = 16, 6, 3, 512, 1 << 20
LEVELS = range(LEAST, DEEPEST + 1)
U = np.uint64
_FACTORS, _MASKS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, size=(2, TREES * DEEPEST), dtype=np.uint64) * U(2) + U(1)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; a shorter text is one shingle, one without words has none."""
    words = word_list(text)
    if not words:
        return np.zeros(0, U)
    x = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    width = min(n, len(x))
    out = np.zeros(len(x) - width + 1, U)
    for i in range(width):
        out = out * U(0x9E3779B97F4A7C15) + x[i : len(out) + i]
    return np.unique(mixed(out + U(width)))


def signature(x: np.ndarray) -> np.ndarray:
    """The full signature: TREES x DEEPEST minhashes of 32 bits."""
    least = np.full(len(_FACTORS), np.iinfo(U).max, U)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, ((x[at : at + 4096, None] ^ _MASKS[None, :]) * _FACTORS[None, :]).min(0))
    return (least >> U(32)).astype(">u4").reshape(TREES, DEEPEST)


def texts(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Row key, doc_id, t (name of the shingle set, null without words), size and sig (the signature as binary) of every row."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, sigs = [], [], []
            for text in batch.column(3):
                x = shingles(text.as_py(), n)
                names.append(xxhash.xxh3_128_hexdigest(x.tobytes()) if len(x) else None)
                sizes.append(len(x))
                sigs.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["_k1", "_k2", "doc_id", "t", "size", "sig"])

    rows = keyed(docs, id_col=id_col, text_col=text_col).select(*KEY, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        return durable(rows.mapInArrow(each, "_k1 long, _k2 long, doc_id long, t string, size long, sig binary"), "forest-texts")


def shorten(members: np.ndarray, threshold: float, missed: float) -> np.ndarray:
    """For each text the prefix length in each tree.

    ``members`` (texts x TREES x LEVELS) counts who shares each prefix.  All prefixes are full at
    first.  As long as a partner at the threshold would be missed with a probability above
    ``missed``, the text shortens one prefix by one: the one with the fewest new members for each
    factor that the probability falls by.
    """
    found = threshold ** np.array(LEVELS, float)
    miss = np.log1p(-found)  # of one tree, by length
    gain = np.concatenate([[np.nan], miss[1:] - miss[:-1]])  # of shortening from each length
    at = np.full(members.shape[:2], DEEPEST - LEAST)
    texts_, trees = np.arange(len(at)), np.arange(TREES)
    for _ in range(TREES * (DEEPEST - LEAST)):
        going = miss[at].sum(1) > np.log(missed)
        if not going.any():
            break
        now = members[texts_[:, None], trees[None, :], at]
        more = members[texts_[:, None], trees[None, :], np.maximum(at - 1, 0)] - now
        price = np.where(at > 0, (more + 0.01) / gain[np.maximum(at, 1)], np.inf)
        best = price.argmin(1)
        at[texts_[going], best[going]] -= 1
    return at + LEAST


def forest(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Places of texts in the tries: sid, tree, node, prober (whether the text searches this node), depths (its prefix length in each tree, as binary).

    ``sets`` has sid, sig.  A text stands at every prefix up to the one that it searches, so it is
    found by those that search a shorter one; only nodes with two texts or more are listed.
    """
    tries = F.explode(F.array(*(
        F.struct(F.lit(tree).alias("tree"), F.lit(d).alias("depth"), F.xxhash64(F.lit(tree), F.lit(d), F.substring("sig", tree * 4 * DEEPEST + 1, 4 * d)).alias("node"))
        for tree in range(TREES) for d in LEVELS)))
    at = sets.select("sid", tries.alias("x")).select("sid", "x.*")
    sizes = at.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    shared = at.join(sizes, "node").groupBy("sid").agg(F.collect_list(F.struct("tree", "depth", "node", "n")).alias("nodes"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, flat = batch.column(1), batch.column(1).flatten()
            row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            tree, depth, node, n = (flat.field(i).to_numpy() for i in range(4))
            members = np.ones((len(listed), TREES, len(LEVELS)), np.int64)
            members[row, tree, depth - LEAST] = n
            chosen = shorten(members, threshold, 1 - recall)
            use = depth <= chosen[row, tree]
            packed = [x.tobytes() for x in chosen.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row[use]]), pa.array(tree[use]), pa.array(node[use]), pa.array(depth[use] == chosen[row[use], tree[use]]), pa.array([packed[i] for i in row[use]], pa.binary())], names=["sid", "tree", "node", "prober", "depths"])

    return durable(shared.select("sid", "nodes").mapInArrow(each, "sid long, tree int, node long, prober boolean, depths binary"), "forest-places")


def nodes(places: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes in which pairs are compared: tree, node, sid, prober, depths, block, front, blocks.

    At least one text searches such a node and at least one other stands there.  Nodes of several
    trees with the same members and searchers are kept in the first tree only.  Searchers are in
    the ``front`` first blocks; blocks behind these need not be compared with each other.
    """
    at = places.join(sets.select("sid", "size"), "sid")
    mark = F.xxhash64("sid", "prober")
    filled = at.groupBy("tree", "node").agg(F.count("*").alias("n"), F.count_if("prober").alias("p"), F.sum(F.when(F.col("prober"), F.col("size")).otherwise(0)).alias("ps"), F.sum("size").alias("total"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(F.xxhash64("sid", "prober", F.lit(1)), 20)).alias("y"))
    kept = filled.filter("n > 1 and p > 0").groupBy("n", "p", "ps", "total", "x", "y").agg(F.min(F.struct("tree", "node")).alias("first"))
    cut = lambda n, size: F.greatest(F.ceil(n / MEMBERS), F.least(F.ceil(size / SHINGLES), n)).cast("int")
    kept = kept.select("first.tree", "first.node", cut(F.col("p"), F.col("ps")).alias("front"), cut(F.col("n") - F.col("p"), F.col("total") - F.col("ps")).alias("back"))
    spread = lambda n: F.pmod(F.xxhash64("sid", F.lit(2)), F.greatest(n, F.lit(1))).cast("int")
    block = F.when(F.col("prober"), spread(F.col("front"))).otherwise(F.col("front") + spread(F.col("back")))
    return at.join(kept, ["tree", "node"]).select("tree", "node", "sid", "prober", "depths", block.alias("block"), "front", (F.col("front") + F.col("back")).alias("blocks"))


def met(sigs: np.ndarray, depths: np.ndarray, tree: int) -> np.ndarray:
    """Which pairs meet in the tree: their common prefix is as long as the shorter of their two prefixes there."""
    least = np.minimum(depths[:, None, tree], depths[None, :, tree])
    common, same = np.zeros(least.shape, np.uint8), np.ones(least.shape, bool)
    for level in range(DEEPEST):
        same &= sigs[:, None, tree, level] == sigs[None, :, tree, level]
        if not same.any():
            break
        common += same
    return common >= least


def compare(names: list[int], weights: np.ndarray, sigs: np.ndarray, depths: np.ndarray, sets: list[np.ndarray], block: np.ndarray, prober: np.ndarray, tree: int, pair: tuple[int, int], threshold: float) -> Iterator[tuple]:
    """For one pair of blocks: (sid, root, texts, docs) of every member with links.

    Exact Jaccard of all pairs of which one searches this node and that meet in no earlier tree, by products of 0/1 matrices over the shingles that occur twice.
    """
    n = len(names)
    wanted = ~np.eye(n, dtype=bool) if pair[0] == pair[1] else (block[:, None] != block[None, :])
    wanted &= prober[:, None] | prober[None, :]
    size = np.array([len(x) for x in sets], np.float64)
    for earlier in range(tree):
        if not wanted.any():
            return
        wanted &= ~met(sigs, depths, earlier)
    wanted &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
    busy = np.flatnonzero(wanted.any(1))
    if not len(busy):
        return
    wanted, size = wanted[np.ix_(busy, busy)], size[busy]
    rows = np.repeat(np.arange(len(busy)), size.astype(np.int64))
    values = np.concatenate([sets[i] for i in busy])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    counts = np.bincount(column)
    use = counts[column] > 1
    column, rows = (np.cumsum(counts > 1) - 1)[column[use]], rows[use]
    shared = np.zeros((len(busy), len(busy)), np.float32)
    cut = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 2048, 2048))
    for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        part = np.zeros((len(busy), 2048), np.float32)
        part[rows[a:z], column[a:z] - 2048 * k] = 1
        shared += part @ part.T
    linked = wanted & (shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-6)
    root = np.arange(len(busy))
    while True:
        best = np.minimum(root, np.where(linked, root[None, :], len(busy)).min(1))
        best = best[best]
        if (best == root).all():
            break
        root = best
    texts_linked, docs_linked = linked.sum(1), (linked * weights[busy][None, :]).sum(1)
    for i in np.flatnonzero(texts_linked):
        yield names[busy[i]], names[busy[root[i]]], int(texts_linked[i]), int(docs_linked[i])


def links(docs: DataFrame, sets: DataFrame, members: DataFrame, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """sid, root, texts, docs for the members of every block pair that have links.

    ``sets`` has sid, weight and the row key (_k1, _k2) of one document that holds the text.
    """
    other = F.explode(F.expr("sequence(0, if(block < front, blocks, front) - 1)"))
    pairs = members.withColumn("other", other)
    pairs = pairs.select("sid", "depths", F.struct("tree", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "prober").alias("place"))
    wanted = sets.select("sid", "weight", *KEY).join(pairs.groupBy("sid").agg(F.first("depths").alias("depths"), F.collect_list("place").alias("places")), "sid")
    held = keyed(docs, id_col=id_col, text_col=text_col).select(*KEY, F.col(text_col).alias("text")).join(wanted, KEY).select("sid", "weight", "depths", "places", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_, sigs = [], []
            for text in batch.column(4):
                x = shingles(text.as_py(), n)
                sets_.append(x.tobytes())
                sigs.append(signature(x).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sigs, pa.binary()), pa.array(sets_, pa.binary())], names=["sid", "weight", "depths", "places", "sig", "shingles"])

    place = "struct<tree:int,node:bigint,i:int,j:int,block:int,prober:boolean>"
    spread = held.mapInArrow(cut, f"sid long, weight long, depths binary, places array<{place}>, sig binary, shingles binary").withColumn("place", F.explode("places"))
    spread = spread.select("place.*", "sid", "weight", "depths", "sig", "shingles")
    order = ["tree", "node", "i", "j"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                names = sorted(rows)
                weights, depths, sigs, sets_, block, prober = (list(x) for x in zip(*(rows[x] for x in names), strict=True))
                found = list(compare(names, np.array(weights, np.float64), np.array(sigs), np.array(depths), sets_, np.array(block), np.array(prober), at[0], at[2:], threshold))
                if found:
                    t, r, a, b = map(list, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (t, r, a, b)], names=["sid", "root", "texts", "docs"])

        for batch in batches:
            for tree, node, i, j, block, prober, sid, weight, depths, sig, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (tree, node, i, j):
                    yield from flush()
                    at, rows = (tree, node, i, j), {}
                rows[sid] = (weight, np.frombuffer(depths, np.uint8), np.frombuffer(sig, ">u4").reshape(TREES, DEEPEST), np.frombuffer(x, U), block, prober)
        yield from flush()

    with small_batches(docs.sparkSession):
        sorted_ = spread.repartition(*order).sortWithinPartitions(*order)
        return durable(sorted_.mapInArrow(each, "sid long, root long, texts long, docs long"), "forest-links")


def components(edges: DataFrame) -> DataFrame:
    """t, root (the least of its component) for every t on an edge (t, root); large and small stars in turn, each written."""
    pairs = edges.filter("t <> root").select(F.greatest("t", "root").alias("u"), F.least("t", "root").alias("v")).distinct()
    pairs, seen = durable(pairs, "components"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, pairs = pairs, durable(small.filter("u <> v").distinct(), "components")
        discard(before)
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return pairs.select(F.col("u").alias("t"), F.col("v").alias("root"))
        seen = now


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, doc_id, class_id, n_links, n_texts, keeper, t for every row.

    ``class_id`` is the least id among documents joined by links (Jaccard of n-word shingles of
    ``threshold`` or more); ``n_links`` counts the other documents that a row is linked to, copies
    included, ``n_texts`` the other distinct texts; ``keeper`` marks rows whose key is the least of
    the class.  A pair at the threshold is found with probability ``recall``, a closer one with a
    greater.  Words are lower-cased ASCII letters and digits and all else outside ASCII; a text
    of fewer than n words is one shingle; null and wordless texts have no links and are a class of
    their own (t null); a text of any length is read whole; equal rows are copies of each other; a
    class without any id has class_id null; other columns are not looked at; an empty table gives
    no rows.
    """
    rows = texts(docs, n, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("nothing"), F.col("_k1"), F.col("_k2"))
    sets = rows.filter("t is not null").groupBy("t").agg(F.count("*").alias("weight"), F.min(order).alias("first"), F.max("size").alias("size"), F.max("sig").alias("sig"))
    sets = durable(sets.select(F.monotonically_increasing_id().alias("sid"), "t", "weight", "first._k1", "first._k2", F.col("first.nothing").alias("nothing"), "size", "sig"), "forest-sets")
    places = forest(sets, threshold, recall)
    members = durable(nodes(places, sets), "forest-nodes")
    found = links(docs, sets, members, n, threshold, id_col, text_col)
    counts = found.groupBy("sid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(found.select(F.col("sid").alias("t"), "root"))
    classes = sets.join(roots.withColumnRenamed("t", "sid"), "sid", "left").join(counts, "sid", "left").select("t", F.coalesce("root", "sid").alias("root"), "weight", "nothing", *KEY, F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"))
    heads = classes.groupBy("root").agg(F.min(F.struct("nothing", *KEY)).alias("head"))
    classes = durable(classes.join(heads, "root").select("t", "weight", "texts", "docs", "head"), "forest-classes")
    for used in (places, members, found, sets):
        discard(used)
    out = rows.select(*KEY, "doc_id", "t").join(classes, "t", "left")
    same = (F.col("head._k1") == F.col("_k1")) & (F.col("head._k2") == F.col("_k2"))
    return out.select(*KEY, "doc_id", F.when(F.col("t").isNull(), F.col("doc_id")).when(~F.col("head.nothing"), F.col("head._k1")).alias("class_id"),
                      F.coalesce(F.col("docs") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
                      F.coalesce(same, F.lit(True)).alias("keeper"), "t")
