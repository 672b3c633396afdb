"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed 60-bit hash.  A source takes the documents whose hash lies below a
threshold, and the threshold is found without sorting documents: words are summed by source and
hash bucket (12 bits), the bucket in which the budget runs out is found among at most 4096 sums,
and only that bucket's documents are summed again by their next 12 bits.  Thresholds are nested:
a larger budget takes a superset.  The document at the threshold is taken in part, so that a
source meets its budget to the word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEY, durable, hash60, keyed, ranked, rowed

BITS, STEP = 60, 12


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """One row for each source: source, source_size, target.

    Sources by code point, null last, have the weights in turn and share ``share`` (a fraction)
    of all sizes; a target stops at ``most`` times the source's size and the excess is shared
    again by weight until no target is above.  Whole numbers decide, so reruns agree.
    """
    sources = ranked(sized.groupBy("source").agg(F.sum("size").alias("s")), F.col("source").asc_nulls_last())
    sources = durable(sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")), "sources")
    up, down = share
    big = lambda x: F.lit(x).cast("decimal(38,0)")
    s, w = F.col("s").cast("decimal(19,0)"), F.col("w").cast("decimal(9,0)")
    total, weight = sources.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    left, active, capped, full = up * total, weight, -1, F.lit(False)
    while active and left:
        # a source is full when weight * left / (down * active) reaches most * size
        full = s * big(most * down * active) <= w * big(left)
        n, full_s, full_w = sources.filter(full).agg(F.count("*"), F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if n == capped:
            break
        capped, left, active = n, up * total - down * most * full_s, weight - full_w
    share_of = (F.col("w") * F.lit(left)).cast("double") / F.lit(float(max(down * active, 1)))
    return sources.select("source", F.col("s").alias("source_size"), F.when(full, (F.lit(most) * F.col("s")).cast("double")).otherwise(share_of).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source of ``budgets`` (source, rest): cut (the hash at the threshold), rest (words left for it) and tied (words at that hash).

    Sources with nothing to take have no row.
    """
    state = budgets.filter("rest > 0").select("source", F.lit(0).cast("long").alias("cut"), "rest")
    for level in range(BITS // STEP):
        low = BITS - STEP * (level + 1)
        inside = sized.filter("size > 0").alias("d").join(state.alias("b"), F.expr("d.source <=> b.source") & (F.shiftright("d.h", low + STEP) == F.col("b.cut")))
        buckets = inside.groupBy("b.source", "b.rest", F.shiftright("d.h", low).alias("cut")).agg(F.sum("d.size").alias("n"), F.min("d.h").alias("least"), F.max("d.h").alias("most"))
        before = F.sum("n").over(W.partitionBy("source").orderBy("cut")) - F.col("n")
        found = buckets.withColumn("before", before).filter("before <= rest and before + n > rest")
        found = durable(found.select("source", "cut", (F.col("rest") - F.col("before")).alias("rest"), F.col("n").alias("tied"), "least", "most"), "threshold")
        if low == 0 or not found.filter("least <> most").limit(1).count():
            break
        state = found.select("source", "cut", "rest")
    return found.select("source", F.col("least").alias("cut"), "rest", "tied")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Row key, id, source, size, source_size, target, copies, taken for every row.

    ``copies`` counts whole passes over the document, ``taken`` the words of the mix with repeats.
    Null and blank texts have size 0 and take nothing; null is a source of its own; rows of equal
    id and text share a hash and, at the threshold, share what is left in proportion; an empty
    table gives no rows.  Columns beside id, text and source are not looked at.
    """
    rows = keyed(docs, source_col, id_col=id_col, text_col=text_col)
    sized = durable(rows.select(*KEY, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), hash60(id_col, text_col).alias("h")), "sized")
    goal = source_targets(sized, weights, share, most)
    words, safe = F.floor("target").cast("long"), F.greatest("source_size", F.lit(1))
    goal = durable(goal.withColumns({"base": F.expr("floor(target) div greatest(source_size, 1)").cast("long"), "rest": (words % safe).cast("long")}), "goal")
    cut = thresholds(sized, goal.select("source", "rest"))
    plan = durable(goal.drop("rest").alias("g").join(cut.alias("c"), F.expr("g.source <=> c.source"), "left").select("g.*", "c.cut", "c.rest", "c.tied"), "plan")
    part = F.when(F.col("h") < F.col("cut"), F.col("size")).when(F.col("h") == F.col("cut"), F.expr("size * rest div tied")).otherwise(0)
    out = sized.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select("d.*", "p.source_size", "p.target", "p.base", "p.cut", "p.rest", "p.tied")
    out = out.withColumn("part", F.coalesce(part, F.lit(0)).cast("long"))
    return out.select(*KEY, "doc_id", "source", "size", "source_size", "target",
                      (F.col("base") + (F.col("part") * 2 > F.col("size")).cast("long")).alias("copies"),
                      (F.col("base") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in the columns of docs, whatever their names: a row for each whole copy (the one at a threshold is rounded).

    Null, empty and blank texts have no words and go; rows of equal id and text are each repeated
    alike; an empty table gives no rows.
    """
    plan = mix(docs, **how).filter("copies > 0").groupBy(*KEY).agg(F.max("copies").alias("copies"))
    out = rowed(docs).join(plan, KEY).select("row", F.explode(F.expr("sequence(1, cast(copies as int))")).alias("copy"))
    return out.select("row.*")
