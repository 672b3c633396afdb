"""Small documents for the corpus operators, with the odd cases that every operator must bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, shard string, batch long, keeper boolean, t string"


def made_texts(n: int = 60, seed: int = 7) -> list[str]:
    """Texts of a small vocabulary with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéü") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(30, 200))]
        if i % 6 == 1:
            words = out[-1].replace("\n", " ").split() if i else words
        elif i % 6 == 2:
            words = out[-1].replace("\n", " ").split()
            words[rng.randrange(len(words))] = "changed"
        elif i % 6 == 3:
            words[10:10] = passage.split()
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        out.append("\n".join(lines))
    return out


def documents(spark, texts: list[str] | None = None):
    """The texts, and: null and empty texts, a null id, a repeated row, one long text, clashing extra columns."""
    texts = made_texts() if texts is None else texts
    rows = [(i, x, "en" if i % 3 else "fr", f"s{i % 4}" if i % 7 else None) for i, x in enumerate(texts)]
    rows += [(900, None, "en", "s1"), (901, "", None, "s1"), (902, "  \n\t ", "en", None), (903, "one two", "en", "s2"), (None, texts[0], "en", "s0"), (None, None, None, None)]
    rows += [(904, texts[3], "en", "s1")] * 2
    rows += [(905, " ".join(texts) + " " + "x" * 5000, "en", "s3"), (906, "a" * 200, "en", "s3"), (907, "same " * 300, "en", "s3")]
    rows = [(*r, len(r[1] or ""), -1, -1, "z", -1, None, "t") for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(docs) -> list[tuple]:
    """(doc_id, text, source) of every row."""
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]
