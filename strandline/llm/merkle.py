"""Document fingerprints: Merkle trees over sections, paragraphs and blocks of a paragraph.

Sections end at blank lines, paragraphs at line ends, and a paragraph's leaves are its blocks of
128 characters (code points), the last of them shorter.  A leaf's digest is its md5; a node's is
the sha256 of its children's digests, so the root is equal for equal texts and for no others, and
where roots differ only the branches that differ need be opened to find the edit.

A fingerprint is the root and, for likeness, the tree's lowest levels cut finer: grains of 128,
64, ... characters down to a sixteenth of the text, so that short texts have as many as long ones.
Two fingerprints are compared at the finest grain that both have.  Built of DataFrame operations
alone; a text of any length is cut in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, keyed, ranked

BLOCK, GRAINS = 128, 16
#: Sizes of grains, from coarse to fine.
SIZES = (128, 64, 32, 16, 8, 4, 2, 1)
#: What parts blocks while a text is cut, and what both marks become where a text has them itself.
MARK, ESCAPE = "\ue000", "\ue001"


def escaped(text: Column) -> Column:
    """The text without MARK; different texts stay different."""
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(MARK), F.lit(ESCAPE + "\ue002"))
    return F.when(F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(ESCAPE)), safe).otherwise(text)


def blocks(piece: Column, size: int) -> Column:
    """An escaped() text in blocks of ``size`` code points; the empty one is one empty block."""
    cut = F.split(F.regexp_replace(piece, rf"(?s).{{{size}}}", f"$0{MARK}"), MARK, -1)
    return F.filter(cut, lambda x, i: (x != "") | (i == 0))


def tree(text: Column, block: int = BLOCK) -> Column:
    """array<struct<digest, paragraphs array<struct<digest, leaves array<string>>>>>, one element a section."""
    leaves = lambda p: F.transform(blocks(p, block), lambda x: F.md5(x))
    digest = lambda parts: F.sha2(F.concat_ws(",", parts), 256)
    paragraph = lambda x: F.struct(digest(x).alias("digest"), x.alias("leaves"))
    section = lambda ps: F.struct(digest(F.transform(ps, lambda p: p["digest"])).alias("digest"), ps.alias("paragraphs"))
    cut = F.transform(F.split(escaped(text), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))
    return F.transform(F.transform(cut, lambda s: F.transform(s, paragraph)), section)


def root(sections: Column) -> Column:
    """The root's digest."""
    return F.sha2(F.concat_ws(",", F.transform(sections, lambda s: s["digest"])), 256)


def grains(text: Column) -> Column:
    """array<array<string>>: for each size from 128 down to the largest that is at most a sixteenth of the text, its distinct grains in order.

    A grain is a block of a paragraph with its place there (a few characters in one place tell
    more than anywhere), as 8 hexadecimal digits of its md5.
    """
    lines, n = F.split(escaped(text), "\n\n|\n", -1), F.length(text)
    digest = lambda x, i: F.substring(F.md5(F.concat(i.cast("string"), F.lit(":"), x)), 1, 8)
    level = lambda size: F.array_sort(F.array_distinct(F.flatten(F.transform(lines, lambda p: F.transform(blocks(p, size), digest)))))
    none = F.array().cast("array<string>")
    # a size is left out when twice as much is still at most a sixteenth
    levels = F.array(*(level(s) if s == BLOCK else F.when(n < 2 * s * GRAINS, level(s)).otherwise(none) for s in SIZES))
    return F.filter(levels, lambda x: F.size(x) > 0)


def likeness(a: Column, b: Column) -> Column:
    """Shared grains of all grains, at the finest size that both have."""
    at = F.least(F.size(a), F.size(b))
    x, y = F.element_at(a, at), F.element_at(b, at)
    both = F.size(F.array_intersect(x, y))
    return both.cast("double") / F.greatest(F.size(x) + F.size(y) - both, F.lit(1))


def fingerprint(sections: Column, grained: Column) -> Column:
    """root;grains,...;grains,...; as one string, from the coarsest grains to the finest."""
    return F.concat_ws(";", root(sections), F.array_join(F.transform(grained, lambda x: F.array_join(x, ",")), ";"))


def _differs(a: Column, b: Column) -> Column:
    """For each digest of array b: whether array a has another one in its place, counted from the front and counted from the end."""
    shift = F.size(a) - F.size(b)
    # get() of a negative place would be an error under ANSI, so it is asked for only where it exists
    back = lambda i: F.when(i + shift >= 0, F.get(a, F.greatest(i + shift, F.lit(0))))
    return F.transform(b, lambda x, i: ~(F.coalesce(F.get(a, i) == x, F.lit(False)) | F.coalesce(back(i) == x, F.lit(False))))


def edits(a: Column, b: Column) -> Column:
    """Where tree b differs from tree a: sections and paragraphs (numbers from 0, array<struct<section, paragraph>>) of the differing branches.

    Only sections whose digests differ are opened.  Branches are compared place by place, from the
    front and from the end, so what one insertion or deletion moves is not taken for an edit.
    """
    digests = lambda xs: F.transform(xs, lambda x: x["digest"])
    changed = _differs(digests(a), digests(b))
    no_paragraph = F.array().cast("array<string>")
    empty = F.array().cast("array<struct<section:int,paragraph:int>>")

    def opened(s: Column, i: Column) -> Column:
        own = digests(s["paragraphs"])
        before = F.coalesce(digests(F.get(a, i)["paragraphs"]), no_paragraph)
        found = F.transform(_differs(before, own), lambda x, j: F.when(x, F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph"))))
        return F.when(F.get(changed, i), F.filter(found, lambda x: x.isNotNull())).otherwise(empty)

    return F.flatten(F.transform(b, opened))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, doc_id, n_chars and the tree of every row; null counts as the empty text, whose tree is one empty paragraph."""
    text = F.coalesce(text_col, F.lit(""))
    return keyed(docs, id_col=id_col, text_col=text_col).select(*KEY, F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), tree(text).alias("sections"))


def next_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each distinct row: its key, the key of the next (_n1, _n2) by id (null last, then by key), the first after the last, n_chars, and whether its id is null.

    Only keys and lengths are sorted, in ranges; a range's neighbours are told by the first rows of the ranges.
    """
    rows = keyed(docs, id_col=id_col, text_col=text_col).select(*KEY, F.col(id_col).isNull().alias("_null"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars")).distinct()
    placed = ranked(rows, F.col("_null"), F.col("_k1"), F.col("_k2"))
    total = placed.count()
    follow = placed.select(((F.col("_rank") + max(total, 1) - 1) % max(total, 1)).alias("_rank"), F.col("_k1").alias("_n1"), F.col("_k2").alias("_n2"))
    return durable(placed.join(follow, "_rank").select(*KEY, "_n1", "_n2", "n_chars", "_null"), "next")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits for every row.

    A text's last floor(n/2) characters give way to the first as many (or all) of the next
    document's.  Both near_ columns are likenesses of fingerprints, and can be had from these
    strings alone; ``edits`` lists the differing branches of the edited text (section:paragraph,
    comma-joined).  Texts travel once by their own key; the next document sends only the
    characters that are wanted and its grains.  Null is the empty text; rows of equal id and text
    count as one document in the order and get equal results; a single document is its own next;
    other columns are not looked at; an empty table gives no rows.
    """
    follow = next_documents(docs, id_col, text_col)
    text = F.coalesce(text_col, F.lit(""))
    # both sides read the same columns, so that one exchange of the texts serves both
    rows = keyed(docs, id_col=id_col, text_col=text_col).select(*KEY, text.alias("t"))
    wanted = follow.select(F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"), F.col("_n1").alias("_k1"), F.col("_n2").alias("_k2"), F.col("n_chars").alias("_pn"), "_null")
    given = rows.join(wanted, KEY)
    given = given.select(F.col("_p1").alias("_k1"), F.col("_p2").alias("_k2"), F.expr("substring(t, 1, cast(_pn div 2 as int))").alias("head"), grains(F.col("t")).alias("next_grains"), "_null")
    # equal rows all send the same, and one of them is enough; the rest is merged before it travels
    given = given.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in ("head", "next_grains", "_null")))
    both = rows.join(given, KEY).withColumns({"n_chars": F.length("t").cast("long"), "doc_id": F.when(~F.col("_null"), F.col("_k1"))})
    both = both.withColumn("e", F.concat(F.expr("substring(t, 1, cast(n_chars - n_chars div 2 as int))"), "head"))
    grown = both.select(*KEY, "doc_id", "n_chars", F.sha2("e", 256).alias("edited_sha256"), tree(F.col("t")).alias("ta"), tree(F.col("e")).alias("tb"), grains(F.col("t")).alias("ga"), grains(F.col("e")).alias("gb"), "next_grains")
    where = F.array_join(F.transform(edits(F.col("ta"), F.col("tb")), lambda x: F.concat_ws(":", x["section"].cast("string"), x["paragraph"].cast("string"))), ",")
    return grown.select(*KEY, "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("ta"), F.col("ga")).alias("fingerprint"), fingerprint(F.col("tb"), F.col("gb")).alias("edited_fingerprint"),
                        likeness(F.col("ga"), F.col("gb")).alias("near_edited"), likeness(F.col("ga"), F.col("next_grains")).alias("near_next"), where.alias("edits"))
