"""Repeated windows of a fixed number of symbols (bytes or words), found exactly without moving every window.

A window's anchor of k symbols is its leftmost k-gram of smallest hash.  Equal windows have equal
anchors at equal offsets, so only windows that share an anchor's k-gram can be equal.
Consecutive windows with one anchor form a run, and a run's anchor, not each window, is what
travels.  With k as long as the window, the anchor is the window itself.

``pack`` deals documents into batches of about 1 MB, compressed, each with a stable number.  A
batch sends each distinct anchor or run once, however common it is there, so no bucket gets more
of it than there are batches.  Numpy does the arithmetic of a batch; Spark deals batches, entries
and answers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, keyed, small_batches

#: Text bytes of a batch, of the text a bucket stands for, and symbols that are looked at together.
BATCH, BUCKET, CHUNK = 1 << 20, 16 << 20, 1 << 16
#: Of zstd, for texts.
LEVEL = 8
NULL_ORDER = (1 << 63) - 1
U = np.uint64
PLACE = U((1 << 20) - 1)
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for base in BASES:
        inverse = pow(base, -1, 1 << 64)
        out.append(tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, b, U)])) for b in (base, inverse)))
    return out


_POWERS: list = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, up to n at least."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        _POWERS[:] = _powers(max(n, CHUNK + (1 << 12)))
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """The finish of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Texts:
    """The documents of one batch: keys, order (the id; null last) and texts as UTF-8."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, order: np.ndarray, sizes: np.ndarray, data: bytes):
        self.k1, self.k2, self.order, self.sizes, self.data = k1, k2, order, sizes, data

    def dump(self, level: int = LEVEL) -> bytes:
        head = np.array([len(self.k1)], np.int64)
        return zstandard.ZstdCompressor(level).compress(b"".join([head.tobytes(), self.k1.tobytes(), self.k2.tobytes(), self.order.tobytes(), self.sizes.tobytes(), self.data]))

    @classmethod
    def load(cls, blob: bytes) -> Texts:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        parts = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(4, n)
        return cls(*parts, raw[8 + 32 * n :])

    def each(self) -> Iterator[bytes]:
        at = 0
        for n in self.sizes:
            yield self.data[at : at + n]
            at += n


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH, bounds: tuple[int, ...] = (), note: Callable[[Texts], bytes] | None = None, total: Callable[[], tuple[Callable[[Texts, bytes], None], Callable[[], bytes]]] | None = None, series: int = 0, *, times: int = 1, level: int = LEVEL) -> DataFrame:
    """batch, part, raw (text bytes), texts (a dumped Texts), note: every row of docs, in batches of about batch_bytes.

    ``bounds`` are ids: a document's part is the number of bounds up to its id (null is above all).
    ``note`` adds something to a batch.  ``total`` makes, for each task, a function that sees every
    batch with its note and one that sums up; the sum is the note of a last row without texts
    (batch null).  Batches of different ``series`` have different numbers.  Batches are ``times``
    as large, and compressed at zstd's ``level``.
    """
    rows = keyed(docs, id_col=id_col, text_col=text_col).select(*KEY, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ORDER)).alias("o"), F.coalesce(text_col, F.lit("")).alias("t"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (series << 52) + (TaskContext.get().partitionId() << 28)
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        see, sum_up = total() if total else (None, None)

        def flush(part: int) -> pa.RecordBatch:
            nonlocal number
            k1, k2, o, texts = zip(*held.pop(part), strict=True)
            made = Texts(*(np.array(x, np.int64) for x in (k1, k2, o)), np.array([len(x) for x in texts], np.int64), b"".join(texts))
            number += 1
            noted = note(made) if note else None
            if see:
                see(made, noted)
            return packed_row(number - 1, part, sizes.pop(part), made.dump(level), noted)

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(3)), batch.column(3), strict=True):
                text = row[3].as_py().encode()
                k1, k2, o = (x.as_py() for x in row[:3])
                part = bisect_right(bounds, o)
                held.setdefault(part, []).append((k1, k2, o, text))
                sizes[part] = sizes.get(part, 0) + len(text)
                if sizes[part] >= times * batch_bytes:
                    yield flush(part)
        for part in list(held):
            yield flush(part)
        if sum_up:
            yield packed_row(None, -1, 0, None, sum_up())

    with small_batches(docs.sparkSession):
        return durable(rows.mapInArrow(each, "batch long, part int, raw long, texts binary, note binary"), "packed", codec="none", by="part")


def packed_row(batch: int | None, part: int, raw: int, texts: bytes | None, note: bytes | None) -> pa.RecordBatch:
    return table({"batch": ([batch], pa.int64()), "part": ([part], pa.int32()), "raw": ([raw], pa.int64()), "texts": ([texts], pa.binary()), "note": ([note], pa.binary())})


def word_symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (ASCII whitespace separates), and how many each document has."""
    counts, hashes = np.zeros(len(texts.sizes), np.int64), []
    for i, text in enumerate(texts.each()):
        words = text.split()
        counts[i] = len(words)
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words)))
    return np.concatenate(hashes) if hashes else np.zeros(0, U), counts


def _prefix(x: np.ndarray, which: int) -> np.ndarray:
    """Running polynomial hash of the symbols (bytes, or hashes of words)."""
    codes = BYTE_CODES[which][x] if x.dtype == np.uint8 else x if which == 0 else mixed(x)
    out = np.zeros(len(x) + 1, U)
    np.cumsum(codes * powers(len(x))[which][0][: len(x)], out=out[1:])
    return out


class Runs:
    """Runs of windows of ``size`` symbols: start and last window, anchor (where its k-gram starts) and hash of the k-gram, for k = gram.

    Symbols are looked at CHUNK windows at a time; a run that crosses chunks is two.
    """

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, size: int, gram: int):
        self.symbols, self.size, self.gram = symbols, size, gram
        ends = np.cumsum(counts)
        self.found: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(0, len(symbols), CHUNK):
            x = symbols[at : at + CHUNK + size - 1]
            if len(x) < size:
                break
            for out, new in zip(self.found, self._chunk(x, at, ends), strict=True):
                out.append(new)
        self.start, self.last, self.anchor, self.key = (np.concatenate(xs) if xs else np.zeros(0, kind) for xs, kind in zip(self.found, (np.int64, np.int64, np.int64, U), strict=True))
        del self.found

    def _chunk(self, x: np.ndarray, at: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        size, gram = self.size, self.gram
        prefix, inverse = _prefix(x, 0), powers(len(x))[0][1]
        grams = mixed((prefix[gram:] - prefix[:-gram]) * inverse[: len(x) - gram + 1])
        low = (grams & ~PLACE) | np.arange(len(grams), dtype=U)
        width, span = size - gram + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        n = min(len(low), CHUNK)
        low = low[:n]
        # a window is whole when its document ends no sooner
        inside = np.zeros(n, bool)
        first, last = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, at + n, side="left")
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        for a, z in zip(begins[first : last + 1], ends[first : last + 1], strict=True):
            inside[max(a - at, 0) : max(z - at - size + 1, 0)] = True
        s = np.flatnonzero(inside)
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
        anchor = (low[s] & PLACE).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (np.diff(anchor) != 0)]))
        return s[heads] + at, s[np.concatenate([heads[1:] - 1, [len(s) - 1]])] + at, anchor[heads] + at, grams[anchor[heads]]


def hashes_at(symbols: np.ndarray, at: np.ndarray, lengths: np.ndarray | int, which: int = 0) -> np.ndarray:
    """A hash of ``lengths`` symbols (fewer than 4096) from each of the places ``at`` (ascending)."""
    lengths = np.broadcast_to(np.asarray(lengths), at.shape)
    out, most = np.zeros(len(at), U), int(lengths.max(initial=0))
    for c in range(0, len(symbols), CHUNK):
        i, j = np.searchsorted(at, [c, c + CHUNK])
        if i == j:
            continue
        x, p, n = symbols[c : c + CHUNK + most], at[i:j] - c, lengths[i:j]
        prefix, inverse = _prefix(x, which), powers(len(x))[which][1]
        out[i:j] = mixed((prefix[p + n] - prefix[p]) * inverse[p] + n.astype(U) * U(BASES[1 - which]))
    return out


def steps(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each count c, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """For each of n symbols, whether a window of ``size`` that starts at one of the places covers it."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return np.cumsum(cover[:-1]) > 0


@cache
def zipper(level: int) -> zstandard.ZstdCompressor:
    """A worker's compressor: making one costs more than a small array does."""
    return zstandard.ZstdCompressor(level)


@cache
def unzipper() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def planes(x: np.ndarray) -> bytes:
    """x by bytes of equal weight, compressed: high bytes that hardly vary take no room."""
    return planes_of(x, [slice(None)])[0]


def planes_of(x: np.ndarray, parts: list[slice]) -> list[bytes]:
    """planes() of each part of x."""
    turned = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return [zipper(1).compress(turned[:, p].tobytes()) for p in parts]


def from_planes(raw: bytes, kind: np.dtype | str) -> np.ndarray:
    kind = np.dtype(kind)
    plain = unzipper().decompress(raw)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pieces(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """Each bucket of a sorted array with its slice."""
    if not len(bucket):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return [(int(bucket[a]), slice(a, z)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def table(cols: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols.values()], names=list(cols))


def by_batch(codes: DataFrame, name: str = "codes") -> DataFrame:
    """batch -> its codes in the order in which its entries were sent (by bucket)."""
    listed = codes.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "codes"))).alias("x"))
    return listed.select("batch", F.transform("x", lambda c: c["codes"]).alias(name))


def codes_of(parts: list[bytes] | None, n: int) -> np.ndarray:
    """by_batch()'s codes as one array of n."""
    return np.concatenate([from_planes(x, np.uint8) for x in parts]) if parts else np.zeros(n, np.uint8)
