"""Searches over vectors and fill-in-the-middle, against brute force and exact round trips."""

import hashlib
import math
import random

import numpy as np
import pytest

from strandline.llm import hard_negatives, piece_table, pivot_index
from strandline.llm import vectors as vec

from .cases import documents, made_texts

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score long, pivot int, dist double, rank int, place long, group long, anchor long"
EXTRA = (-1, -1, -1, -1.0, -1, -1, -1, -1)


def made(n=180, dim=6, seed=3):
    """Vectors in clusters, many equal, some repeated with their id; and null, empty, short and non-finite ones, null ids and labels."""
    rng = random.Random(seed)
    centre = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [round(c + rng.gauss(0, 0.1), 2) for c in centre[rng.randrange(5)]], rng.randrange(4)) for i in range(n)]
    rows += [(n + 50 * k, rows[7][1], k % 3) for k in range(60)] + [rows[100], rows[100], rows[0]]
    rows += [(5000, None, 1), (5050, [], 1), (5100, [0.5, math.nan, 0.1, 0.0, 0.0, 0.0], 1), (5150, [math.inf] * dim, 1), (5200, [0.1, None, 0.0, 0.0, 0.0, 0.0], 2), (5300, [0.5, -0.5], 2), (None, rows[3][1], 2), (None, rows[3][1], 2), (5400, rows[3][1], None), (-100, rows[5][1], 3)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def taking_part(rows, dim=6, labelled=False):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and not (labelled and label is None):
            whole = [math.floor(256 * float(np.float32(x))) for x in v]
            out.append((i, whole + [0] * (dim - len(whole)), (label + 1) % 10 if labelled and i is not None and i % 7 == 0 else label))
    return out


def order(x):
    """Higher scores, then smaller ids, null ids last."""
    return -x[1], x[0] is None, x[0] or 0


def score(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute_top(rows, k=5, every=50):
    out = []
    for j, (i, v, _) in enumerate(rows):
        if i is not None and i % every == 0:
            best = sorted(((c, score(v, w)) for m, (c, w, _) in enumerate(rows) if m != j), key=order)[:k]
            out += [(i, r + 1, c, s) for r, (c, s) in enumerate(best)]
    return sorted(out, key=str)


def brute_negatives(rows, k=5, every=100):
    out = []
    for j, (i, v, label) in enumerate(rows):
        if i is not None and i % every == 0:
            all_ = [(c, score(v, w), y) for m, (c, w, y) in enumerate(rows) if m != j]
            for p, ps, _ in sorted((x for x in all_ if x[2] == label), key=order)[:k]:
                near = sorted((x for x in all_ if x[2] != label and 80 * ps <= 100 * x[1] <= 100 * ps), key=order)[:k]
                out += [(i, p, r + 1, c, ps, s) for r, (c, s, _) in enumerate(near)]
    return sorted(out, key=str)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:  # many pivots, annuli and rounds
        for module, name, value in ((vec, "BLOCK", 16), (pivot_index, "BLOCK", 16), (pivot_index, "TOGETHER", 5), (pivot_index, "FIRST", 1)):
            monkeypatch.setattr(module, name, value)
    rows = made()
    got = pivot_index.search(table(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert bag(got) == brute_top(taking_part(rows))
    assert pivot_index.search(table(spark, rows[:1])).count() == 0 == pivot_index.search(table(spark, rows).limit(0)).count()


def test_far_annuli_are_not_read(spark, monkeypatch):
    """Two distant clusters: the triangle inequality keeps a query away from the annuli of the other one."""
    for module, name, value in ((vec, "BLOCK", 8), (pivot_index, "BLOCK", 8), (pivot_index, "FIRST", 1)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(1)
    rows = [(i, [(1.0 if i % 2 else -1.0) + rng.gauss(0, 0.01), rng.gauss(0, 0.01)], 0) for i in range(200)]
    taken = []
    keep = pivot_index.written

    def seen(df, label, *more):
        out = keep(df, label, *more)
        if label == "search-pairs":
            taken.extend(len(r["rows"]) for r in out.collect())
        return out

    monkeypatch.setattr(pivot_index, "written", seen)
    got = pivot_index.search(table(spark, rows))
    assert bag(got) == brute_top(taking_part(rows, 2))
    assert sum(taken) <= 4 * (200 // 8) // 2 + 4 * 4  # of each query the annuli of one side at most, and one round more


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        for module, name, value in ((vec, "BLOCK", 32), (hard_negatives, "BLOCK", 32), (hard_negatives, "TOGETHER", 3)):
            monkeypatch.setattr(module, name, value)
    rows = made()
    got = hard_negatives.mine(table(spark, rows), every=10).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = brute_negatives(taking_part(rows, labelled=True), every=10)
    assert len(want) > 100 and bag(got) == want
    assert hard_negatives.mine(table(spark, rows).limit(0)).count() == 0 == hard_negatives.mine(table(spark, rows[1:2])).count()


def test_tree_bounds():
    """The tree spans, parents come first, bounds hold and leave most vectors of a tight group unscored."""
    rng = np.random.default_rng(5)
    anchors = (rng.normal(0, 1, 16) * 200 + rng.normal(0, 1, (20, 16))).astype(np.int32)
    theirs = rng.normal(0, 60, (500, 16)).astype(np.int32)
    seq, parent, length = hard_negatives.spanning_tree(anchors)
    assert sorted(seq) == list(range(20)) and (parent < 0).sum() == 1
    assert all(parent[a] < 0 or list(seq).index(parent[a]) < list(seq).index(a) for a in seq)
    b = hard_negatives.Bounds(anchors, parent, length, theirs)
    true = vec.products(anchors, theirs)
    for a in seq:
        low, high = b.open(a)
        assert (low <= true[a]).all() and (true[a] <= high).all()
        want = np.sort(true[a])[-5]
        got = b.exact(a, high >= want)
        assert (got[true[a] >= want] == true[a][true[a] >= want]).all()
    assert b.scored < 0.3 * true.size


def test_large_components_stay_exact():
    a = np.array([[vec.LARGEST, -vec.LARGEST + 1, 3]] * 2, np.int32)
    assert vec.products(a, a).tolist() == [[vec.LARGEST**2 + (vec.LARGEST - 1) ** 2 + 9] * 2] * 2


def sentinel_free(text):
    return not any(s in text for s in ("<P>", "<S>", "<M>"))


def brute_middle(doc_id, text, seed=7):
    import re

    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or not sentinel_free(text):
        return len(lines), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return len(lines), form, len(pre), len(mid), sha(out), sha(text)


def test_fill_in_middle(spark):
    odd = ["", "\n", "\n\n", "no line feed", "é\r\nü x\n\n<", "a <P> b\nc", "<S>", "x<M>", "<\nP>\n<S\n>", "\x00\n\x01", "line\n" * 5000]
    docs = documents(spark, made_texts(40) + odd)
    out = piece_table.arrange(docs)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == brute_middle(r["doc_id"], r["text"] or "")
    assert {r["form"] for r in rows} == {"plain", "spm", "psm"}
    made_out = piece_table.outputs(out)
    want = sorted(((r["doc_id"], r["text"] or "") for r in rows), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in piece_table.restored(made_out).collect()), key=str) == want
    digest = {(r["doc_id"], r["output_sha256"]) for r in rows}
    assert {(r["doc_id"], hashlib.sha256(r["output"].encode()).hexdigest()) for r in made_out.collect()} == digest
    assert {r["form"] for r in piece_table.arrange(docs, share=0).collect()} == {"plain"}
    assert piece_table.digests(docs.limit(0)).count() == 0 and piece_table.digests(docs).count() == len(rows)


def test_pieces():
    """Cutting splits descriptors, neighbours join again, and a wrong form is refused."""
    text = "ab\ncd\nef".encode()
    left, right = piece_table.cut(piece_table.whole(text), 4)
    assert left == [(0, 0, 4)] and right == [(0, 4, 4)] and piece_table.joined(left + right) == piece_table.whole(text)
    a, b = piece_table.cut(left + right, 6)
    assert a == [(0, 0, 4), (0, 4, 2)] and b == [(0, 6, 2)]
    with pytest.raises(ValueError):
        piece_table.parsed(b"<P>x<M>y<S>", "psm")
