"""Benchmark decontamination on a distributed positional inverted index.

Every token of the training texts is stored as a posting: term, document, position.  Test items
are cut into windows of 13 words, whose terms are put in the order of their corpus frequency.  The
rarest term's postings, moved back by its offset in the window, are the possible starts; the list
of the next term, moved back by its own offset, is intersected with them, and so on to the most
common.  What survives all intersections is a match: exact where every term stands in its place,
near where every term stands within ``slack`` words of it.  Texts are read and tokenised once;
all matching is joins of postings, and only lists of terms and documents that are still in
question are moved.

Terms are stored as 64-bit hashes: a match of other words needs equal hashes in its place.
Built of DataFrame operations alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, discard, durable, keyed, words

#: Offsets of a window are kept as bits of a long.
LONGEST = 62


def windows_of(items: DataFrame, length: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (string), wid, ww: the windows of ``length`` words of every item; a shorter item is one window, one without words has none."""
    got = items.select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("ws")).filter("size(ws) > 0")
    starts = F.expr(f"sequence(1, greatest(size(ws) - {length - 1}, 1))")
    out = got.withColumn("at", F.explode(starts)).select("item", F.expr(f"slice(ws, at, {length})").alias("ww"))
    return out.select("item", F.md5(F.concat_ws(" ", "ww")).alias("wid"), "ww").distinct()


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: doc_id, row key, pos and term of every token, and for each row of docs a last posting without term, whose pos is the number of words."""
    tokens = keyed(docs, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("doc_id"), *KEY, F.posexplode(F.concat(words(text_col), F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    return durable(tokens.select("doc_id", *KEY, "pos", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term")), "postings")


def ordered_windows(members: DataFrame, index: DataFrame) -> DataFrame:
    """wid, size, terms: each window's array of struct n, word, off, term, the rarest first (ties by word, then offset); windows with a word that no document has are left out."""
    at = members.select("wid", "ww").distinct().select("wid", F.size("ww").alias("size"), F.posexplode("ww").alias("off", "word")).withColumn("term", F.xxhash64("word"))
    counts = index.filter("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    found = at.join(counts, "term").groupBy("wid", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word", "off", "term"))).alias("terms"))
    return durable(found.filter("size(terms) = size"), "window-terms")


def _narrowed(found: DataFrame, windows: DataFrame, index: DataFrame, first: int, last: int | None, slack: int) -> DataFrame:
    """Of possible starts (row key, wid, start, exact), those that the lists of terms number first .. last - 1 agree with."""
    part = windows.select("wid", F.slice("terms", F.lit(first + 1), F.lit(last - first) if last else F.greatest(F.col("size") - first, F.lit(0))).alias("terms"))
    bit = lambda off: F.call_function("shiftleft", F.lit(1).cast("long"), off)
    at = [*KEY, "wid", "start"]
    asked = found.join(part, "wid")
    shifts = F.sequence(F.lit(-slack), F.lit(slack)) if slack else F.array(F.lit(0))
    need = asked.select(*at, F.explode("terms").alias("t")).select(*at, F.col("t.term").alias("term"), F.col("t.off").alias("off"), F.explode(shifts).alias("shift"))
    need = need.withColumn("pos", F.col("start") + F.col("off") + F.col("shift"))
    # a list of rare terms is short everywhere; those of all other terms are read in the documents still in question alone (written, so that their size is known to Spark's own check)
    if last:
        lists = index.join(durable(part.select(F.explode("terms.term").alias("term")).distinct(), "asked-terms"), "term", "left_semi")
    else:
        lists = index.join(durable(found.select(*KEY).distinct(), "asked-documents"), KEY, "left_semi")
    met = need.join(lists.select(*KEY, "term", "pos"), [*KEY, "term", "pos"], "left_semi")
    none = F.lit(0).cast("long")
    wanted = F.aggregate("terms", none, lambda acc, t: acc.bitwiseOR(bit(t["off"])))
    rows = met.select(*at, none.alias("wanted"), F.lit(True).alias("exact"), bit(F.col("off")).alias("any"), F.when(F.col("shift") == 0, bit(F.col("off"))).otherwise(none).alias("here"))
    rows = rows.unionByName(asked.select(*at, wanted.alias("wanted"), "exact", none.alias("any"), none.alias("here")))
    kept = rows.groupBy(*at).agg(F.bit_or("wanted").alias("wanted"), F.bool_and("exact").alias("exact"), F.bit_or("any").alias("any"), F.bit_or("here").alias("here"))
    kept = kept.filter("any = wanted").select(*at, (F.col("exact") & (F.col("here") == F.col("wanted"))).alias("exact"))
    return durable(kept if slack else kept.filter("exact"), "starts")


def phrase_matches(index: DataFrame, members: DataFrame, slack: int = 0) -> DataFrame:
    """Row key, wid, start, size, exact for every match of a window (windows_of()) in the index (postings()).

    A match starts where the window's rarest term (by the corpus, ties by word and offset) puts
    it.  With ``slack`` 0 only exact matches are returned; above (proximity), also those in which
    every other term stands within so many words of its place.
    """
    windows = ordered_windows(members, index)
    # written, so that Spark's own check knows their size: the terms alone pick the lists, and only these meet the windows
    lead = durable(windows.select("wid", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["off"].alias("off")), "leading-terms")
    lists = index.join(durable(lead.select("term").distinct(), "asked-terms"), "term", "left_semi")
    found = lists.join(lead, "term").select(*KEY, "wid", (F.col("pos") - F.col("off")).alias("start"), F.lit(True).alias("exact")).filter("start >= 0").distinct()
    found = durable(found, "starts")
    for first, last in ((1, 2), (2, 3), (3, None)):
        before, found = found, _narrowed(found, windows, index, first, last, slack)
        discard(before)
    return found.join(windows.select("wid", "size"), "wid")


def covered(spans: Column) -> Column:
    """Number of words inside any of the spans (start, size)."""
    ends = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("a"), (s["start"] + s["size"]).cast("long").alias("z"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["z"] - F.greatest(s["a"], acc["upto"]), F.lit(0).cast("long"))).alias("n"), F.greatest(s["z"], acc["upto"]).alias("upto"))
    return F.aggregate(ends, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, length: int = 13, percent: int = 5, slack: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near for every row.

    A word inside any exact occurrence of a window is hit; a document is contaminated when at
    least ``percent`` of its words are.  ``n_near`` counts the items with an exact or a proximity
    match (phrase_matches()).  Null and wordless texts have no words and are clean; items without
    words match nothing; null item ids are left out of the digest; texts of any length are read
    whole; equal rows get equal results; other columns are not looked at; either table may be
    empty.
    """
    if not 0 < length <= LONGEST:
        raise ValueError(f"windows have 1 to {LONGEST} words")
    index = postings(docs, id_col, text_col)
    members = durable(windows_of(items, length, text_col=text_col), "windows")
    matches = phrase_matches(index, members, slack)
    hits = matches.filter("exact").groupBy(*KEY).agg(covered(F.collect_list(F.struct("start", "size"))).alias("n_hit"))
    held = matches.groupBy(*KEY, "wid").agg(F.bool_or("exact").alias("exact")).join(members.select("wid", "item"), "wid")
    held = held.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("ids"), F.size(F.collect_set("item")).cast("long").alias("n_near"))
    found = held.join(hits, KEY, "left").select(*KEY, "n_hit", F.size("ids").cast("long").alias("n_items"), F.concat_ws(",", "ids").alias("ids"), "n_near")
    found = durable(found, "contamination")
    rows = durable(index.filter("term is null").select("doc_id", *KEY, F.col("pos").cast("long").alias("n_words")), "lengths")
    discard(index)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = rows.join(found, KEY, "left").withColumn("n_hit", none("n_hit"))
    return out.select(*KEY, "doc_id", "n_words", "n_hit", none("n_items").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"), none("n_near").alias("n_near"))
