"""Fill-in-the-middle by piece tables: a document becomes descriptors over immutable buffers, and no text is moved.

A descriptor (buffer, start, length) names bytes of a buffer: TEXT is the document in UTF-8, the
others are the sentinels.  Cutting splits descriptors, an arrangement permutes the parts and puts
sentinels between them, the inverse permutation restores the document, and hashes stream over the
descriptors' bytes.

``arrange`` gives each row its descriptors, ``outputs`` spells them as text, ``restored`` rebuilds
the texts of given outputs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import durable
from .common import small_batches

TEXT = 0
#: Buffers by number; TEXT differs from row to row.
SENTINELS = [b"", b"<P>", b"<S>", b"<M>"]
PREFIX, SUFFIX, MIDDLE = 1, 2, 3
#: The parts of a document in the order in which a form writes them, each after its sentinel.
FORMS = {"psm": [PREFIX, SUFFIX, MIDDLE], "spm": [SUFFIX, PREFIX, MIDDLE]}
#: The order of the parts in the document itself.
PLACES = [PREFIX, MIDDLE, SUFFIX]
LONG = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


def whole(text: bytes) -> list[Piece]:
    return [Piece(TEXT, 0, len(text))] if text else []


def cut(table: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The table before and after a byte place; a descriptor across it is split."""
    left, right = [], []
    for p in table:
        keep = min(max(at, 0), p.length)
        if keep:
            left.append(p._replace(length=keep))
        if keep < p.length:
            right.append(p._replace(start=p.start + keep, length=p.length - keep))
        at -= p.length
    return left, right


def joined(table: list[Piece]) -> list[Piece]:
    """Neighbouring descriptors of one buffer as one."""
    out: list[Piece] = []
    for p in table:
        if out and out[-1].buffer == p.buffer == TEXT and out[-1].start + out[-1].length == p.start:
            out[-1] = out[-1]._replace(length=out[-1].length + p.length)
        else:
            out.append(p)
    return out


def stream(table: list[Piece], text: bytes) -> Iterator[memoryview]:
    """The bytes that the descriptors name, piece by piece."""
    view = memoryview(text)
    for p in table:
        yield (view if p.buffer == TEXT else memoryview(SENTINELS[p.buffer]))[p.start : p.start + p.length]


def digest(table: list[Piece], text: bytes) -> str:
    h = hashlib.sha256()
    for part in stream(table, text):
        h.update(part)
    return h.hexdigest()


def permuted(parts: dict[int, list[Piece]], form: str) -> list[Piece]:
    """The parts in a form's order, each after its sentinel."""
    return [p for k in FORMS[form] for p in (Piece(k, 0, len(SENTINELS[k])), *parts[k])]


def parsed(output: bytes, form: str) -> dict[int, list[Piece]]:
    """The parts of an output as descriptors over it: it is cut at its sentinels, which come in the form's order."""
    order, rest, parts, at = FORMS[form], whole(output), {}, 0
    for k, after in zip(order, [*order[1:], None], strict=True):
        if not output.startswith(SENTINELS[k], at):
            raise ValueError(f"the output is not of form {form}")
        end = len(output) if after is None else output.find(SENTINELS[after], at)
        if end < 0:
            raise ValueError(f"the output is not of form {form}")
        _, rest = cut(rest, len(SENTINELS[k]))
        parts[k], rest = cut(rest, end - at - len(SENTINELS[k]))
        at = end
    return parts


def inverse(parts: dict[int, list[Piece]]) -> list[Piece]:
    """The parts in the document's order."""
    return joined([p for k in PLACES for p in parts[k]])


def rebuilt(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output that spell the document."""
    return whole(output) if form == "plain" else inverse(parsed(output, form))


def after_lines(text: bytes, k: int) -> int:
    """The byte after k lines."""
    at = 0
    for _ in range(k):
        end = text.find(b"\n", at)
        if end < 0:
            return len(text)
        at = end + 1
    return at


def characters(table: list[Piece], text: bytes) -> int:
    """Code points that the descriptors name."""
    return sum(len(bytes(part).decode()) for part in stream(table, text))


def split(text: bytes, h1: int, h2: int) -> tuple[int, dict[int, list[Piece]]]:
    """n lines, and prefix, middle and suffix cut after h1 % (n + 1) and h2 % (n + 1) lines, the smaller first."""
    n = text.count(b"\n") + (bool(text) and not text.endswith(b"\n"))
    first, second = (after_lines(text, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    head, suffix = cut(whole(text), second)
    prefix, middle = cut(head, first)
    return n, {PREFIX: prefix, MIDDLE: middle, SUFFIX: suffix}


SCHEMA = "n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, output_sha256 string, restored_sha256 string"


def arrange(docs: DataFrame, seed: int = 7, share: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, pieces, output_sha256, restored_sha256 of every row.

    Whole texts are cut into n lines (a line has its line feed).  Four numbers of the sha256 of
    "seed:doc_id" decide both cuts, whether a document is arranged (``share`` of 100 are) and its
    form (``spm`` of 100 are spm).  ``pieces`` are the output's descriptors; restored_sha256 is of
    the text that is rebuilt from the output's own bytes and the form.

    A null text is empty; empty texts, and those that hold a sentinel, are plain: their output is
    the text and both counts are null.  A null id is spelled as nothing, so all rows without one are
    cut by the same numbers; equal rows give equal results; an empty table gives no rows; other
    columns are left behind.  A row at a time is held: its text, and its output while it is checked.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, given in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (given.as_py() or "").encode()
                raw = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
                h1, h2, h3, h4 = (int.from_bytes(raw[i : i + 4]) for i in (0, 4, 8, 12))
                n, parts = split(text, h1, h2)
                plain = not text or h3 % 100 >= share or any(s in text for s in SENTINELS[1:])
                form = "plain" if plain else "spm" if h4 % 100 < spm else "psm"
                table = whole(text) if plain else permuted(parts, form)
                output = b"".join(stream(table, text))
                chars = (None, None) if plain else (characters(parts[PREFIX], text), characters(parts[MIDDLE], text))
                rows.append((n, form, *chars, [p._asdict() for p in table], digest(table, text), digest(rebuilt(output, form), output)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), LONG, pa.string(), pa.string()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["doc_id", "text", *(x.split()[0] for x in SCHEMA.split(", "))])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, f"doc_id long, text string, {SCHEMA}")


def outputs(arranged: DataFrame) -> DataFrame:
    """doc_id, form and output: arrange()'s descriptors spelled over the text, by column functions alone."""
    bytes_of = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    part = lambda p: F.when(p["buffer"] == TEXT, F.substring(bytes_of, (p["start"] + 1).cast("int"), p["length"].cast("int"))).otherwise(
        F.element_at(F.array(*(F.lit(s) for s in SENTINELS)), p["buffer"] + 1))
    output: Column = F.decode(F.aggregate(F.transform("pieces", part), F.lit(b""), lambda a, x: F.concat(a, x)), "UTF-8")
    return arranged.select("doc_id", "form", output.alias("output"))


def restored(made: DataFrame) -> DataFrame:
    """doc_id and text, from rows of outputs(): each output is cut at its sentinels and its parts put back in order."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for form, output in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = output.as_py().encode()
                texts.append(b"".join(stream(rebuilt(raw, form), raw)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return made.select("doc_id", "form", "output").mapInArrow(each, "doc_id long, text string")


def digests(docs: DataFrame) -> DataFrame:
    """arrange() without the texts, written in small batches of rows."""
    with small_batches(docs.sparkSession):
        return durable(arrange(docs).drop("text", "pieces"), "fill-in-middle")
