"""Suffix-array dedup over a logarithmic family of indexes.

A batch of documents gets a sparse suffix array: of all suffixes, those that start at the anchors
of its 50-byte windows (see windows.py), in the order of their bytes.  An entry holds the first 16
bytes of the suffix, a hash of the whole run of windows that share the anchor, short hashes of the
bytes on both sides of the 16, and where its text is kept; while its batch is new, also the
smallest document that holds the run.

Batches arrive one after another.  A new batch's array is merge-scanned against every level of
the family: a run that a level holds is a long match; a suffix whose 16 bytes a level holds in
other surroundings is a possible one, if the hash of either side agrees too (equal windows agree
in the 34 bytes beside the 16, so in 17 before or in 17 behind them).  Both texts are fetched,
their windows ordered by hash, and neighbours of equal bytes are matches.  What is new becomes a
level, and a last level less than twice as large merges with it, so n batches leave some log n
levels and an entry is merged log n times.  Levels are tables in the shared folder;
``Family.add`` takes further batches at any time.

Arrays are dealt to buckets by their first 16 bytes.  Bytes that are far more common than others
(HOT) are known from a histogram made while texts are packed; their entries are dealt by run
instead, and their windows by window, so no bucket holds all surroundings of a common passage.

Runs are taken as equal where their first 16 bytes at the anchor and a 64-bit hash of the run are:
among n runs with the same 16 bytes, some n * n / 2**65 pairs are taken as equal wrongly (1e-7 for
a million).  All other matches compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as win
from .common import discard, durable

GRAM = 16
#: Batches are so many times larger than pack() makes them (each sends an array to nearly every bucket), compressed at this level of zstd.
TIMES, LEVEL = 4, 5
#: Batches that deduplicate() makes of a table, by ascending id.
ARRIVALS = 3
#: Cells of the histogram of 16-byte beginnings; a cell is hot with so many runs and four times the mean.
CELLS, HOT = 1 << 16, 1 << 16
NONE, DROP, LOOK, SPLIT = 0, 1, 2, 3
U = np.uint64


def noted(texts: win.Texts, size: int) -> bytes:
    """A batch's runs: how many each document has, the windows of each, and how far its anchor lies behind its first window."""
    gram = min(GRAM, size)
    runs = win.Runs(np.frombuffer(texts.data, np.uint8), texts.sizes, size, gram)
    per = np.bincount(np.searchsorted(np.cumsum(texts.sizes), runs.start, side="right"), minlength=len(texts.sizes)).astype(np.int64)
    both = np.concatenate([runs.last - runs.start + 1, runs.anchor - runs.start]).astype(np.uint16)
    # low bytes first, then the high ones, which are 0 for all but very wide windows
    return win.zipper(3).compress(per.tobytes() + both.view(np.uint8).reshape(-1, 2).T.tobytes())


class Suffixes:
    """A batch's sparse suffix array: each distinct run once, in the order of bucket, bytes and run; in that of run alone if not ``in_order``.

    With ``asked`` (ascending runs of this batch) it has the entries of these alone.
    """

    def __init__(self, texts: win.Texts, note: bytes, size: int, buckets: int, hot: np.ndarray, in_order: bool = True, asked: np.ndarray | None = None):
        self.texts, self.size, self.buckets, self.data = texts, size, buckets, np.frombuffer(texts.data, np.uint8)
        self.doc, self.start, self.windows, self.anchor = located(texts, note)
        body = win.hashes_at(self.data, self.start, self.windows + size - 1)
        if asked is not None:
            mine = np.flatnonzero(asked[np.minimum(np.searchsorted(asked, body), len(asked) - 1)] == body)
            body, self.doc, self.start, self.windows, self.anchor = (x[mine] for x in (body, self.doc, self.start, self.windows, self.anchor))
        self.body, self.first, self.of_run = distinct(body)
        self.hi, self.lo = first_bytes(texts.data, self.anchor[self.first], min(GRAM, size))
        name = gram_hash(self.hi, self.lo)
        self.hot = np.isin(cell(name), hot)
        self.bucket = np.where(self.hot, self.body % U(buckets), (name >> U(32)) % U(buckets)).astype(np.int64)
        if in_order:
            order = byte_order(self.hi, self.lo, self.body)
            dealt = self.bucket[order]
            order = order[np.argsort(dealt.astype(np.uint16) if buckets <= 1 << 16 else dealt, kind="stable")]  # 16 bits are sorted by radix
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            self.of_run = back[self.of_run]
            self.hi, self.lo, self.body, self.bucket, self.hot, self.first = (x[order] for x in (self.hi, self.lo, self.body, self.bucket, self.hot, self.first))
        self.least = np.full(len(self.body), win.NULL_ORDER, np.int64)
        np.minimum.at(self.least, self.of_run, texts.order[self.doc])

    def sides(self) -> np.ndarray:
        """For each entry 16 bits of a hash of the bytes before its anchor's gram, and 16 of those behind it; 0 where the run has no window that reaches so far.

        A side is half of what a window has beside the gram, so each window has one of both sides whole.
        """
        gram = min(GRAM, self.size)
        half = -(-(self.size - gram) // 2)
        behind, ends, n = self.anchor + gram, self.start + self.windows - 1 + self.size, len(self.data)
        out = np.zeros(len(self.start), np.uint32)
        for at, there in ((self.anchor - half, self.anchor - self.start >= half), (behind, ends - behind >= half)):
            short = stretch_hash(self.texts.data, np.clip(at, 0, max(n - half, 0)), half) >> U(48)
            out = (out << np.uint32(16)) | np.where(there, np.maximum(short, U(1)), U(0)).astype(np.uint32)
        return out[self.first]

    def shown(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """What is compared by bytes, as (bucket, entry, start, windows): whole runs of code LOOK, single windows of code SPLIT, each in the order of buckets."""
        look, split = np.flatnonzero(codes == LOOK), np.flatnonzero(codes == SPLIT)
        look = look[np.argsort(self.bucket[look], kind="stable")]
        runs = (self.bucket[look], look, self.start[self.first[look]], self.windows[self.first[look]])
        n = self.windows[self.first[split]]
        entry, at = np.repeat(split, n), np.repeat(self.start[self.first[split]], n) + win.steps(n)
        order = np.argsort(at, kind="stable")
        entry, at = entry[order], at[order]
        bucket = self.buckets + (win.hashes_at(self.data, at, self.size) % U(self.buckets)).astype(np.int64)
        order = np.lexsort((at, entry, bucket))
        return [runs, (bucket[order], entry[order], at[order], np.ones(len(at), np.int64))]

    def removed(self, codes: np.ndarray, verdicts: np.ndarray) -> np.ndarray:
        """For each byte, whether a removed window covers it."""
        code, order = codes[self.of_run], self.texts.order[self.doc]
        whole = (code == DROP) | (order > self.least[self.of_run])
        edge = np.zeros(len(self.data) + 1, np.int32)  # up where what goes begins, down where it ends
        np.add.at(edge, self.start[whole], 1)
        np.add.at(edge, self.start[whole] + self.windows[whole] - 1 + self.size, -1)
        # verdicts of the windows of each entry, in the places of its first run
        mark, at = np.zeros(len(self.data), bool), 0
        for _, _, start, n in self.shown(codes):
            places = np.repeat(start, n) + win.steps(n)
            mark[places[verdicts[at : at + len(places)] == DROP]] = True
            at += len(places)
        own = np.flatnonzero(((code == LOOK) | (code == SPLIT)) & ~whole)
        n = self.windows[own]
        step = win.steps(n)
        hit = mark[np.repeat(self.start[self.first[self.of_run[own]]], n) + step]
        gone = (np.repeat(self.start[own], n) + step)[hit]
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.size, -1)
        return np.cumsum(edge[:-1], dtype=np.int32) > 0


def dense(x: np.ndarray) -> np.ndarray:
    """Ranks of the values, equal ones alike."""
    order = np.argsort(x)
    y, out = x[order], np.empty(len(x), U)
    out[order] = np.cumsum(np.concatenate([np.zeros(1, bool), y[1:] != y[:-1]]))
    return out


def byte_order(hi: np.ndarray, lo: np.ndarray, body: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by hi, lo, body and ``then``.

    Ranks of hi and lo and the first bits of body are sorted as one number, which is several times
    faster than key by key; only what is equal in these is sorted by the other keys.
    """
    if not len(hi):
        return np.zeros(0, np.int64)
    a, b = dense(hi), dense(lo)
    low = max(int(b.max()).bit_length(), 1)
    spare = 64 - low - max(int(a.max()).bit_length(), 1)
    key = (a << U(low + spare)) | (b << U(spare)) | (body >> U(64 - spare))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    t = order[tied]
    order[tied] = t[np.lexsort((*(x[t] for x in reversed(then)), body[t], key[tied]))]
    return order


def stretch_hash(data: bytes, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place."""
    out = np.zeros(len(at), U)
    wide = 8 if n >= 8 else 1
    if len(at) and n:
        words = from_each(data, wide)
        for k in dict.fromkeys([*range(0, n - wide + 1, wide), n - wide]):
            out = out * U(win.BASES[0]) + words[at + k]
    return win.mixed(out)


def located(texts: win.Texts, note: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """noted()'s runs: document, first window, number of windows, anchor."""
    raw = win.unzipper().decompress(note)
    per = np.frombuffer(raw, np.int64, len(texts.sizes))
    low, high = np.frombuffer(raw, np.uint8, offset=8 * len(per)).reshape(2, -1).astype(np.int64)
    windows, ahead = (low + 256 * high).reshape(2, -1)
    doc = np.repeat(np.arange(len(per)), per)
    before = np.cumsum(windows) - windows
    # where a document's windows would begin if those of all documents followed each other
    moved = np.cumsum(texts.sizes) - texts.sizes - np.concatenate([before, [0]])[np.minimum(np.cumsum(per) - per, len(before))]
    start = before + moved[doc]
    return doc, start, windows, start + ahead


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, ascending, the first place of each, and which of them each place holds."""
    order = np.argsort(x)
    y, which = x[order], np.empty(len(x), np.int64)
    heads = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), y[1:] != y[:-1]]))
    if len(x):
        which[order] = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(x)))
    return y[heads], np.minimum.reduceat(order, heads) if len(x) else order, which


def first_bytes(data: bytes, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n (at most 16) bytes from each place as two numbers that sort like them."""
    if n == 16 and len(at):
        words = from_each(data, 8)
        return words[at].byteswap(), words[at + 8].byteswap()
    out = np.zeros((len(at), 16), np.uint8)
    if len(at):
        out[:, :n] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), n)[at]
    both = out.view(">u8").astype(U)
    return both[:, 0], both[:, 1]


def from_each(data: bytes, width: int) -> np.ndarray:
    """The little-endian number of so many bytes from each place."""
    return np.ndarray((len(data) - width + 1,), f"<u{width}", data, 0, (1,))


def gram_hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return win.mixed(hi ^ win.mixed(lo + U(win.BASES[0])))


def cell(name: np.ndarray) -> np.ndarray:
    return (name & U(CELLS - 1)).astype(np.int64)


def hot_cells(packed: DataFrame) -> np.ndarray:
    """Cells with far more runs than others, a quarter of all at most: from the tasks' histograms (note of the rows without texts)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for note in batch.column(0):
                n = np.frombuffer(zstandard.ZstdDecompressor().decompress(note.as_py()), np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    counts = packed.filter("batch is null").select("note").mapInArrow(each, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / CELLS
    return np.array([r[0] for r in counts.filter(F.col("n") > HOT + 4 * mean).select("cell").collect()], np.int64)


def histogram(size: int):
    """For pack(): sums each task's runs by cell."""
    def total():
        seen = np.zeros(CELLS, np.int64)

        def see(texts: win.Texts, note: bytes) -> None:
            _, start, windows, anchor = located(texts, note)
            _, first, _ = distinct(win.hashes_at(np.frombuffer(texts.data, np.uint8), start, windows + size - 1))
            np.add(seen, np.bincount(cell(gram_hash(*first_bytes(texts.data, anchor[first], min(GRAM, size)))), minlength=CELLS), out=seen)

        return see, lambda: zstandard.ZstdCompressor(3).compress(seen.tobytes())

    return total


ARRAYS = ("hi", "lo", "body", "sides", "least", "holder")
KINDS = (np.uint64, np.uint64, np.uint64, np.uint32, np.int64, np.int64)
#: Hashes, which no compression shortens, travel as they are.
HASHES = ("body", "sides")
SCANNED = "kind int, bucket long, batch long, codes binary, bodies binary, " + ", ".join(f"{x} binary" for x in ARRAYS)


def sent(name: str, x: np.ndarray, parts: list[slice]) -> list[bytes]:
    """Each part of an array as it travels."""
    return [x[p].tobytes() for p in parts] if name in HASHES else win.planes_of(x, parts)


def received(name: str, raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(raw, kind) if name in HASHES else win.from_planes(raw, kind)


def neighbours(gram: np.ndarray, sides: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run, whether another one of its gram shares a side with it, and whether a fresh run does (or is it)."""
    near, met = np.zeros(len(gram), bool), np.zeros(len(gram), bool)
    many = np.bincount(gram)[gram] > 1
    for side in (sides >> np.uint32(16), sides & np.uint32(0xFFFF)):
        m = np.flatnonzero(many & (side > 0))
        if not len(m):
            continue
        key = (gram[m].astype(U) << U(16)) | side[m].astype(U)
        order = np.argsort(key)
        key, m = key[order], m[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(heads, append=len(m))
        near[m] |= np.repeat(n > 1, n)
        met[m] |= np.repeat(np.add.reduceat(fresh[m].astype(np.int64), heads) > 0, n)
    return near, met


def merge_scan(hot: np.ndarray, merge: list[int], keep: bool):
    """A bucket's new arrays and those of all levels -> codes for each batch, runs to be fetched by the batches that hold them, and, to keep, the new level (with those of ``merge`` in it)."""

    def group(got: pa.Table) -> pa.Table:
        got = got.sort_by([("level", "descending"), ("batch", "ascending")])  # levels first (nulls last)
        level, batch, bucket = got.column("level").to_pylist(), got.column("batch").to_pylist(), got.column("bucket")[0].as_py()
        cols = [[received(c, x.as_py(), k) if x.is_valid else None for x in got.column(c)] for c, k in zip(ARRAYS, KINDS, strict=True)]
        sizes = [len(x) for x in cols[0]]
        cols[5] = [np.full(n, b, np.int64) if h is None else h for h, n, b in zip(cols[5], sizes, batch, strict=True)]
        hi, lo, body, sides, least, holder = (np.concatenate(x) for x in cols)
        old = np.repeat([x is not None for x in level], sizes)
        stays = np.repeat([x is None or x in merge for x in level], sizes)
        order = byte_order(hi, lo, body, ~old, least)  # of equal runs the one in a level comes first, else that of the smallest document
        h, l, b = hi[order], lo[order], body[order]  # noqa: E741
        new_gram = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])])
        new_run = new_gram | np.concatenate([[True], b[1:] != b[:-1]])
        heads = np.flatnonzero(new_run)
        run = np.cumsum(new_run) - 1
        gram = (np.cumsum(new_gram) - 1)[heads]
        first = order[heads]
        fresh_run = ~old[first]
        near, met = neighbours(gram, sides[first], fresh_run)
        is_hot = np.isin(cell(gram_hash(hi[first], lo[first])), hot)
        wish = np.where(is_hot, SPLIT, np.where(near, LOOK, NONE))
        code = np.empty(len(order), np.uint8)
        code[order] = np.where(old[first][run] | (least[order] > least[first][run]), DROP, wish[run])
        out: dict[str, list] = {x.split()[0]: [] for x in SCANNED.split(", ")}

        def add(**row):
            for name in out:
                out[name].append(row.get(name))

        for x, at, z in zip(batch, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            if not old[at]:
                add(kind=0, bucket=bucket, batch=x, codes=win.planes(code[at:z]))
        wanted = ~fresh_run & (is_hot | met) if fresh_run.any() else np.zeros(len(heads), bool)
        where = first[wanted]
        where = where[np.argsort(holder[where], kind="stable")]
        for x, s in win.pieces(holder[where]):
            add(kind=1, bucket=bucket, batch=x, bodies=body[where[s]].tobytes())
        kept = first[stays[first]]
        if keep and len(kept):  # whatever is in a level is older than all that is to come, so its documents need not be kept
            add(kind=2, bucket=bucket, **{c: sent(c, x[kept], [slice(None)])[0] for c, x in zip(ARRAYS, (hi, lo, body, sides, np.zeros_like(least), holder), strict=True)})
        return pa.table({name: pa.array(v, pa.int32() if name == "kind" else pa.int64() if name in ("bucket", "batch") else pa.binary()) for name, v in out.items()})

    return group


def alike(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows at the (ascending) places that has equal ones beside each other, and where each kind begins in it."""
    view = np.lib.stride_tricks.sliding_window_view(data, size)
    key = win.hashes_at(data, at, size)
    order = np.argsort(key)
    key = key[order]
    heads, where = np.concatenate([[True], key[1:] != key[:-1]]), at[order]
    again = np.flatnonzero(~heads)
    if any((view[where[x - 1]] != view[where[x]]).any() for x in np.array_split(again, 1 + (len(again) >> 16))):
        order = np.argsort(np.ascontiguousarray(view[at]).view(f"S{size}").ravel(), kind="stable")
        where = at[order]
        heads = np.concatenate([[True], (view[where[1:]] != view[where[:-1]]).any(axis=1)])
    return order, np.flatnonzero(heads)


def match_windows(contents: DataFrame, size: int) -> DataFrame:
    """batch, bucket, codes (for each window of the new texts in contents): DROP where an older text or a smaller document holds the window.

    A bucket's windows are ordered by a hash, or, should two of equal hash differ, by their bytes; neighbours of equal bytes are matches.
    """

    def group(got: pa.Table) -> pa.Table:
        got = got.sort_by("batch")
        lengths = [win.from_planes(x.as_py(), np.uint32).astype(np.int64) for x in got.column("lengths")]
        least = [np.repeat(win.from_planes(x.as_py(), np.int64), n - size + 1) for x, n in zip(got.column("least"), lengths, strict=True)]
        counts = [len(x) for x in least]
        n = np.concatenate(lengths)
        data = np.frombuffer(b"".join(win.unzipper().decompress(x.as_py()) for x in got.column("data")), np.uint8)
        at = np.repeat(np.cumsum(n) - n, n - size + 1) + win.steps(n - size + 1)
        order, heads = alike(data, at, size)
        spread = lambda x: np.repeat(x, np.diff(heads, append=len(order)))
        low, old = np.concatenate(least), np.repeat(np.array(got.column("old").to_pylist(), bool), counts)
        codes = np.empty(len(order), np.uint8)
        codes[order] = np.where(spread(np.maximum.reduceat(old[order], heads)) | (spread(np.minimum.reduceat(low[order], heads)) < low[order]), DROP, NONE)
        parts = np.split(codes, np.cumsum(counts)[:-1])
        kept = [i for i, x in enumerate(got.column("old").to_pylist()) if not x]
        return pa.table({"batch": got.column("batch").take(kept), "bucket": got.column("bucket").take(kept), "codes": pa.array([win.planes(parts[i]) for i in kept], pa.binary())})

    return contents.groupBy("bucket").applyInArrow(group, "batch long, bucket long, codes binary")


class Family:
    """Levels of suffix arrays whose sizes shrink geometrically, and the texts they point to; both are tables in the shared folder."""

    def __init__(self, size: int, buckets: int, hot: np.ndarray):
        self.size, self.buckets, self.hot = size, buckets, hot
        self.levels: list[tuple[int, DataFrame]] = []  # text bytes, scanned arrays
        self.texts: DataFrame | None = None
        self.series = 1

    def extend(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """add() for a table of further documents."""
        size = self.size
        packed = win.pack(docs, id_col, text_col, note=lambda texts: noted(texts, size), series=self.series, times=TIMES, level=LEVEL)
        self.series += 1
        return self.add(packed)

    def add(self, packed: DataFrame, keep: bool = True) -> DataFrame:
        """One more batch (pack()'s rows): the row of deduplicate() for each document, matched with everything added before and, within the batch, with smaller ids.

        Without ``keep`` it is the last one: no level is made of it, and the family's are removed.
        """
        size, buckets, hot, spark = self.size, self.buckets, self.hot, packed.sparkSession
        raw = packed.agg(F.sum("raw")).first()[0] or 0

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, blob, note in zip(*(batch.column(i) for i in range(3)), strict=True):
                    s = Suffixes(win.Texts.load(blob.as_py()), note.as_py(), size, buckets, hot)
                    dealt = win.pieces(s.bucket)
                    if dealt:
                        b, parts = map(list, zip(*dealt, strict=True))
                        arrays = [sent(c, x, parts) for c, x in zip(ARRAYS[:-1], (s.hi, s.lo, s.body, s.sides(), s.least), strict=True)]
                        yield win.table({"bucket": (b, pa.int64()), "level": ([None] * len(b), pa.int32()), "batch": ([number.as_py()] * len(b), pa.int64())} | {c: (x, pa.binary()) for c, x in zip(ARRAYS, [*arrays, [None] * len(b)], strict=True)})

        arrays = packed.select("batch", "texts", "note").mapInArrow(entries, "bucket long, level int, batch long, " + ", ".join(f"{x} binary" for x in ARRAYS))
        for i, (_, level) in enumerate(self.levels):
            arrays = arrays.unionByName(level.filter("kind = 2").select("bucket", F.lit(i).alias("level"), F.lit(None).cast("long").alias("batch"), *ARRAYS))
        merge, weight = [], raw
        while keep and len(merge) < len(self.levels) and self.levels[-1 - len(merge)][0] < 2 * weight:
            weight += self.levels[-1 - len(merge)][0]
            merge.append(len(self.levels) - 1 - len(merge))
        scanned = durable(arrays.groupBy("bucket").applyInArrow(merge_scan(hot, merge, keep), SCANNED), "suffix-scan", codec="none")
        codes = durable(win.by_batch(scanned.filter("kind = 0").select("batch", "bucket", "codes")), "suffix-codes")

        def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, blob, note, parts, bodies in zip(*(batch.column(i) for i in range(5)), strict=True):
                    # of an older batch only the runs asked for matter
                    asked = None if parts.is_valid else np.sort(np.concatenate([np.frombuffer(x, U) for x in bodies.as_py()]))
                    s = Suffixes(win.Texts.load(blob.as_py()), note.as_py(), size, buckets, hot, in_order=asked is None, asked=asked)
                    code = win.codes_of(parts.as_py(), len(s.body)) if asked is None else np.where(s.hot, SPLIT, LOOK)
                    rows = []
                    for bucket, entry, start, n in s.shown(code):
                        for b, p in win.pieces(bucket):
                            text = b"".join(s.texts.data[i : i + k + size - 1] for i, k in zip(start[p].tolist(), n[p].tolist(), strict=True))
                            rows.append((b, number.as_py(), not parts.is_valid, win.planes((n[p] + size - 1).astype(np.uint32)), win.planes(s.least[entry[p]]), win.zipper(3).compress(text)))
                    if rows:
                        cols = list(map(list, zip(*rows, strict=True)))
                        yield win.table({c: (x, t) for c, x, t in zip(("bucket", "batch", "old", "lengths", "least", "data"), cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

        none = lambda kind: F.lit(None).cast(kind)
        held = packed.select("batch", "texts", "note").join(codes, "batch").select("batch", "texts", "note", "codes", none("array<binary>").alias("bodies"))
        if self.texts is not None:
            wanted = scanned.filter("kind = 1").groupBy("batch").agg(F.collect_list("bodies").alias("bodies"))
            held = held.unionByName(self.texts.select("batch", "texts", "note").join(wanted, "batch").select("batch", "texts", "note", none("array<binary>").alias("codes"), "bodies"))
        told = held.mapInArrow(contents, "bucket long, batch long, old boolean, lengths binary, least binary, data binary")
        verdicts = durable(win.by_batch(match_windows(told, size), "gone"), "suffix-verdicts")

        if keep:
            for i in sorted(merge, reverse=True):
                discard(self.levels.pop(i)[1])
            self.levels.append((weight, scanned))
        else:
            for used in (scanned, *(level for _, level in self.levels)):
                discard(used)
            self.levels = []
        self.texts = packed if self.texts is None else self.texts.unionByName(packed)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob, note, parts, gone in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                    s = Suffixes(win.Texts.load(blob.as_py()), note.as_py(), size, buckets, hot)
                    texts, off_ = s.texts, s.removed(win.codes_of(parts.as_py(), len(s.body)), win.codes_of(gone.as_py(), 0))
                    data, ends, rows = s.data, np.cumsum(texts.sizes), []
                    for a, z in zip(ends - texts.sizes, ends, strict=True):
                        off = off_[a:z]
                        kept = data[a:z][~off].tobytes() if off.any() else data[a:z].tobytes()
                        rows.append((int(z - a), int(off.sum()), int(off[:1].sum() + (off[1:] & ~off[:-1]).sum()), kept, hashlib.sha256(kept).hexdigest()))
                    n, r, spans, k, h = map(list, zip(*rows, strict=True))
                    ids = [None if o == win.NULL_ORDER else int(o) for o in texts.order]
                    yield win.table({"_k1": (list(texts.k1), pa.int64()), "_k2": (list(texts.k2), pa.int64()), "doc_id": (ids, pa.int64()), "n_bytes": (n, pa.int64()), "n_removed": (r, pa.int64()), "n_spans": (spans, pa.int64()), "kept": (k, pa.binary()), "kept_sha256": (h, pa.string())})

        rows = packed.select("batch", "texts", "note").join(codes, "batch", "left").join(verdicts, "batch", "left").select("batch", "texts", "note", "codes", "gone")
        return rows.mapInArrow(each, "_k1 long, _k2 long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def build(docs: DataFrame, size: int = 50, arrivals: int = ARRIVALS, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> tuple[Family, DataFrame]:
    """deduplicate(), and the family of indexes for later batches (Family.extend), unless these are not to be kept."""
    cuts = docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / arrivals for i in range(1, arrivals)], 0.01) if arrivals > 1 else []
    bounds = tuple(sorted({int(x) for x in cuts}))
    packed = win.pack(docs, id_col, text_col, bounds=bounds, note=lambda texts: noted(texts, size), total=histogram(size), times=TIMES, level=LEVEL)
    raw = packed.agg(F.sum("raw")).first()[0] or 0
    family = Family(size, max(1, -(-raw // win.BUCKET)), hot_cells(packed))
    out = None
    for part in range(len(bounds) + 1):
        rows = family.add(packed.filter(F.col("part") == part), keep or part < len(bounds))
        out = rows if out is None else out.unionByName(rows)
    return family, out


def deduplicate(docs: DataFrame, size: int = 50, arrivals: int = ARRIVALS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, doc_id, n_bytes, n_removed, n_spans, kept (binary: what stays), kept_sha256 for every row.

    Each byte goes that is covered by a string of ``size`` bytes which also starts in a document
    of smaller id.  The table is added to a family in ``arrivals`` batches of ascending ids, so
    that older batches hold the smaller ids.  Null and empty texts have no bytes; texts shorter
    than ``size`` stay whole; texts of any length are read whole; a null id counts as larger than
    all others, and rows of equal id (or both null) do not remove each other's bytes; other
    columns are not looked at; an empty table gives no rows.
    """
    return build(docs, size, arrivals, id_col, text_col, keep=False)[1]
