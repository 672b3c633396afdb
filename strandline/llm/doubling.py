"""Substring dedup by level-wise doubling.

A window of 35 words can only be repeated if a part of it is.  The first level looks at grams of
8 words, of which each window sends its anchor alone (see windows.py).  Windows whose 8-gram
stands at one place only are out; the others go on to grams of 16 words, what is repeated there
to 32, and the rest to all 35, which decides.  The levels stop as soon as no window survives.

A batch keeps a bit for each of its windows between levels, and sends to a level only the
distinct grams of windows that are still in: hash and whether it stands there more than once.
A gram that stands everywhere sends one entry of some 12 bytes for each batch of texts.
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

GRAM = 8


def levels(size: int, first: int = GRAM) -> tuple[int, ...]:
    """Lengths of grams: doubled each time, the window's own at the end."""
    out = [min(first, size)]
    while out[-1] < size:
        out.append(min(2 * out[-1], size))
    return tuple(out)


class Level:
    """A batch at one level: its words' hashes, which windows are still in, and the distinct grams of these in the order in which they are sent."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], size: int, gram: int, buckets: int, alive: np.ndarray | None):
        symbols, counts = words
        runs = win.Runs(symbols, counts, size, gram)
        self.n, self.runs = len(symbols), runs
        if alive is None:
            alive = np.zeros(self.n, bool)
            lengths = runs.last - runs.start + 1
            alive[np.repeat(runs.start, lengths) + win.steps(lengths)] = True
        self.alive = alive
        ins = np.concatenate([[0], np.cumsum(alive)])
        self.used = np.flatnonzero(ins[runs.last + 1] > ins[runs.start])
        key = runs.key[self.used]
        # the last level decides, so there a second hash stands beside the first
        check = (win.hashes_at(symbols, runs.start[self.used], size, 1) >> win.U(32)).astype(np.uint32) if gram == size else np.zeros(len(key), np.uint32)
        order = np.lexsort((check, key, key % win.U(buckets)))
        key, check = key[order], check[order]
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])) if len(key) else order
        self.of_run = np.empty(len(order), np.int64)
        self.of_run[order] = np.repeat(np.arange(len(heads)), np.diff([*heads, len(order)]))
        self.key, self.check, self.again = key[heads], check[heads], np.diff([*heads, len(order)]) > 1
        self.bucket = (self.key % win.U(buckets)).astype(np.int64)

    def surviving(self, codes: np.ndarray) -> np.ndarray:
        """Which windows are in after the level's answer (1 for each repeated gram)."""
        good = np.zeros(len(self.runs.start), bool)
        good[self.used] = codes[self.of_run] == 1
        lengths = self.runs.last - self.runs.start + 1
        out = np.zeros(self.n, bool)
        out[np.repeat(self.runs.start, lengths) + win.steps(lengths)] = np.repeat(good, lengths)
        return out & self.alive


def bits(alive: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.packbits(alive).tobytes())


def from_bits(raw: bytes | None, n: int) -> np.ndarray | None:
    return None if raw is None else np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), count=n).astype(bool)


def _judged(entries: DataFrame) -> DataFrame:
    """batch -> codes: 1 for each gram that stands at two places or more; batches without any are left out."""

    def group(got: pa.Table) -> pa.Table:
        got = got.sort_by("batch")
        pull = lambda name, kind: [win.from_planes(x.as_py(), kind) for x in got.column(name)]
        keys = pull("keys", np.uint64)
        key, check, again = np.concatenate(keys), np.concatenate(pull("checks", np.uint32)), np.concatenate(pull("again", np.uint8))
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        heads = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
        total = np.add.reduceat(again[order].astype(np.int64) + 1, heads)
        code = np.empty(len(order), np.uint8)
        code[order] = np.repeat(total > 1, np.diff([*heads, len(order)]))
        parts = np.split(code, np.cumsum([len(x) for x in keys])[:-1])
        return pa.table({"batch": got.column("batch"), "bucket": got.column("bucket"), "codes": pa.array([win.planes(x) for x in parts], pa.binary()), "hits": pa.array([int(x.sum()) for x in parts], pa.int64())})

    codes = entries.groupBy("bucket").applyInArrow(group, "batch long, bucket long, codes binary, hits long")
    listed = codes.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "codes"))).alias("x"), F.sum("hits").alias("hits"))
    return listed.filter("hits > 0").select("batch", F.transform("x", lambda c: c["codes"]).alias("codes"))


def deduplicate(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, doc_id, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256 for every row.

    Each word goes that is covered by a window of ``size`` words which starts anywhere else too,
    in the same document or another.  Null and blank texts have no words; shorter texts stay
    whole; texts of any length are read whole; equal rows repeat each other; other columns are not
    looked at; an empty table gives no rows.
    """
    packed = win.pack(docs, id_col, text_col)
    buckets = max(1, -(-(packed.agg(F.sum("raw")).first()[0] or 0) // (2 * win.BUCKET)))
    grams = levels(size)
    schema = "batch long, alive binary, bucket long, keys binary, checks binary, again binary"

    def entries(gram: int, before: int | None):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, blob, state, parts in zip(*(batch.column(i) for i in range(4)), strict=True):
                    words, alive = win.word_symbols(win.Texts.load(blob.as_py())), None
                    if before is not None:
                        last = Level(words, size, before, buckets, from_bits(state.as_py(), len(words[0])))
                        alive = last.surviving(win.codes_of(parts.as_py(), len(last.key)))
                        if not alive.any():
                            continue
                    now = Level(words, size, gram, buckets, alive)
                    rows = [(b, win.planes(now.key[s]), win.planes(now.check[s]), win.planes(now.again[s].astype(np.uint8))) for b, s in win.pieces(now.bucket)]
                    if not rows:
                        continue
                    b, k, c, a = map(list, zip(*rows, strict=True))
                    own = [number.as_py()] * (len(b) + 1)  # the first row is the batch's own: which windows are in
                    yield win.table({"batch": (own, pa.int64()), "alive": ([bits(now.alive), *[None] * len(b)], pa.binary()), "bucket": ([None, *b], pa.int64()), "keys": ([None, *k], pa.binary()), "checks": ([None, *c], pa.binary()), "again": ([None, *a], pa.binary())})

        return each

    state, gone, before = None, [], None
    for gram in grams:
        texts = packed.select("batch", "texts")
        if state is None:
            texts = texts.select("batch", "texts", F.lit(None).cast("binary").alias("alive"), F.lit(None).cast("array<binary>").alias("codes"))
        else:
            texts = texts.join(state, "batch").select("batch", "texts", "alive", "codes")
        sent = durable(texts.mapInArrow(entries(gram, before), schema), f"doubling-{gram}", codec="none")
        gone.append(sent)
        codes = _judged(sent.filter("bucket is not null").select("batch", "bucket", "keys", "checks", "again"))
        state = durable(sent.filter("alive is not null").select("batch", "alive").join(codes, "batch"), f"doubling-{gram}-state")
        before = gram
        if state.isEmpty():
            break
    for used in gone:
        discard(used)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, bits_, parts in zip(*(batch.column(i) for i in range(1, 4)), strict=True):
                texts = win.Texts.load(blob.as_py())
                lists = [x.split() for x in texts.each()]
                n = sum(map(len, lists))
                out = np.zeros(n, bool)
                if bits_.is_valid and before == size:  # else no window came to the last level
                    level = Level(win.word_symbols(texts), size, size, buckets, from_bits(bits_.as_py(), n))
                    out = win.covered(n, np.flatnonzero(level.surviving(win.codes_of(parts.as_py(), len(level.key)))), size)
                rows, at = [], 0
                for words in lists:
                    off = out[at : at + len(words)]
                    at += len(words)
                    lost = int(off.sum())
                    kept = b" ".join(words if not lost else [words[i] for i in np.flatnonzero(~off)])
                    rows.append((len(words), lost, kept.decode(), hashlib.sha256(kept).hexdigest()))
                w, r, k, h = map(list, zip(*rows, strict=True))
                ids = [None if o == win.NULL_ORDER else int(o) for o in texts.order]
                yield win.table({"_k1": (list(texts.k1), pa.int64()), "_k2": (list(texts.k2), pa.int64()), "doc_id": (ids, pa.int64()), "n_words": (w, pa.int64()), "n_removed": (r, pa.int64()), "kept": (k, pa.string()), "kept_sha256": (h, pa.string())})

    rows = packed.select("batch", "texts").join(state, "batch", "left").select("batch", "texts", "alive", "codes")
    return rows.mapInArrow(each, "_k1 long, _k2 long, doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
