"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Patterns find assignments, access keys and long hexadecimal runs.  Beyond them, every run of 20 or
more token characters that holds a letter and a digit is put to the test; its encoding is inferred.

The null hypothesis is an ordinary token of that encoding and length: its characters are as uneven
as those of words and numbers (ORDINARY, the chance that two are equal), and letters, capitals,
digits and signs stand in runs (CHANGE, the chance that the kind changes).  Two p-values follow:
of a chi-squared statistic against the uniform alphabet as small as the token's (non-central, by
its normal approximation), and of as many runs of kinds.  Fisher's method combines them.  A
discovery, that is a reported span, needs a p-value that passes Benjamini-Hochberg at level q
among the tokens of its class of length: at most a share q of reported spans is ordinary, as far
as the null holds.  Tokens too short to tell do not pass.  Runs about the alphabet's middle and
serial correlation are further hurdles: a token whose order would be a rare chance (ORDER) in a
random string is not reported, which only takes discoveries away.

p-values are counted in bins of a fixed number and rounded up to a bin's edge, so the procedure
needs no global sort and stays valid.  Built of DataFrame operations alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEY, durable, keyed

#: Kinds in the order in which spans of one start are listed, and their patterns.
PATTERNS = {
    "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "random": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9])(?=[0-9+/=_-]*+[A-Za-z])[A-Za-z0-9+/=_-]{20,}+",
}
KINDS = list(PATTERNS)
#: Characters that part matches from their surroundings; the first is looked for in no pattern.
BAR, OTHER = "\ue0ff", "\ue0fe"

#: Encodings in the order in which they are tried: pattern and alphabet.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("^[0-9A-Za-z+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
]
#: Lower ends of the classes of length.
CLASSES = (20, 32, 48, 96)
#: Bins of a decade of p, and decades.
PER_DECADE, DECADES = 50, 40
#: Chance that two characters of an ordinary token are equal (letters of words in both cases and numbers; of hexadecimal letters alone, digits of numbers),
#: by how much more the statistic scatters than for independent characters (words repeat), and chance that a character is of another kind than the last.
ORDINARY, ORDINARY_HEX, SCATTER, CHANGE = 0.05, 0.1, 2.0, 0.3
#: Chance of an order as regular as this, below which a token is not taken as random.
ORDER = 0.001


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-x * x / 2) * 0.3989422804014327
    return F.when(z >= 0, tail).otherwise(1 - tail)


def random_bins(tokens: DataFrame) -> DataFrame:
    """tokens (a column m) with cls (class of length) and bin (of the p-value as an ordinary token; higher is more random, 0 where the order is regular)."""
    bare = F.regexp_replace("m", "=+", "")
    alphabet = F.lit(None).cast("string")
    for pattern, letters in reversed(ENCODINGS):
        alphabet = F.when(F.col("s").rlike(pattern), F.lit(letters)).otherwise(alphabet)
    rows = tokens.withColumn("s", bare).withColumn("alphabet", F.coalesce(alphabet, F.lit(ENCODINGS[-1][1])))
    rows = rows.withColumns({"n": F.length("s").cast("double"), "k": F.length("alphabet").cast("double"), "v": F.transform(F.array_remove(F.split("s", ""), ""), lambda c: F.position(c, F.col("alphabet")).cast("double") - 1)})
    counts = F.transform(F.array_distinct("v"), lambda x: F.size(F.filter("v", lambda y: y == x)).cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("squares", total(F.transform(counts, lambda c: c * c)))
    chi, df = F.col("squares") * F.col("k") / F.col("n") - F.col("n"), F.col("k") - 1
    beyond = F.col("n") * F.greatest(F.col("k") * F.when(F.col("k") <= 16, ORDINARY_HEX).otherwise(ORDINARY) - 1, F.lit(0.0))  # the non-centrality
    p_like = 1 - upper_tail((chi - df - beyond) / F.sqrt(SCATTER * (2 * df + 4 * beyond)))
    kinds = F.regexp_replace("s", "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "#")
    changes, steps_ = F.length(kinds) - 1, F.col("n") - 1
    p_kinds = upper_tail((changes - 0.5 - steps_ * CHANGE) / F.sqrt(steps_ * CHANGE * (1 - CHANGE)))
    product = F.greatest(p_like, F.lit(1e-30)) * F.greatest(p_kinds, F.lit(1e-30))
    p_like = product * (1 - F.log(product))
    rows = rows.withColumns({"p_like": p_like, "high": F.array_join(F.transform("v", lambda x: F.when(x * 2 >= F.col("k"), "1").otherwise("0")), "")})
    n1 = (F.length("high") - F.length(F.replace("high", F.lit("1"), F.lit("")))).cast("double")
    steps = lambda pair: (F.length("high") - F.length(F.replace("high", F.lit(pair), F.lit("")))) / 2
    rows = rows.withColumns({"n1": n1, "n_runs": 1 + steps("01") + steps("10")})
    mean = 2 * F.col("n1") * (F.col("n") - F.col("n1")) / F.col("n") + 1
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    p_runs = F.when((F.col("n1") == 0) | (F.col("n1") == F.col("n")), F.pow(F.lit(2.0), 1 - F.col("n"))).when(var <= 0, F.lit(1.0)).otherwise(2 * upper_tail(F.abs(F.col("n_runs") - mean) / F.sqrt(var)))
    around = F.zip_with("v", F.concat(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(1))), F.slice("v", 1, 1)), lambda a, b: a * b)
    rows = rows.withColumns({"p_runs": p_runs, "sx": total(F.col("v")), "sxx": total(F.transform("v", lambda x: x * x)), "sxy": total(around)})
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sx")) / F.when(spread > 0, spread)
    p_serial = F.coalesce(2 * upper_tail(F.abs(r + 1 / (F.col("n") - 1)) * F.sqrt(F.col("n"))), F.lit(0.0))
    p = F.when(2 * F.least("p_runs", p_serial) < ORDER, F.lit(1.0)).otherwise(F.least(F.col("p_like"), F.lit(1.0)))
    cls = F.lit(CLASSES[0])
    for low in CLASSES[1:]:
        cls = F.when(F.col("n") >= low, F.lit(low)).otherwise(cls)
    bins = F.floor(-F.log10(F.greatest(p, F.lit(10.0 ** -DECADES))) * PER_DECADE).cast("int")
    return rows.withColumns({"cls": cls, "bin": F.greatest(bins, F.lit(0))}).select(*tokens.columns, "cls", "bin")


def cutoffs(tested: DataFrame, q: float = 0.05) -> dict[int, int]:
    """Benjamini-Hochberg in each class: the lowest bin that is a discovery. A class without discoveries is left out."""
    counts = tested.groupBy("cls", "bin").count()
    down = W.partitionBy("cls").orderBy(F.col("bin").desc())
    ranks = counts.select("cls", "bin", F.sum("count").over(down).alias("rank"), F.sum("count").over(W.partitionBy("cls")).alias("m"))
    passed = ranks.filter(F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE) <= q * F.col("rank") / F.col("m"))
    return dict(passed.groupBy("cls").agg(F.min("bin")).collect())  # at most a row for each class


def _numbered(kind: int, parts: Column) -> Column:
    """gap, match, gap, match, ..., gap -> (kind, at, gap, m) for each match."""
    gaps, matches = F.filter(parts, lambda x, j: j % 2 == 0), F.filter(parts, lambda x, j: j % 2 == 1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    return F.transform(pairs, lambda x, j: F.struct(F.lit(kind).alias("kind"), j.cast("int").alias("at"), x["gap"].alias("gap"), x["m"].alias("m")))


def meets_base() -> Column:
    """Whether a span (start, end) overlaps a base span (kind below 3) of its row: one that begins no later ends beyond its start, or the next to begin does so before its end. Two ordered passes over a row's spans."""
    w = W.partitionBy(*KEY).rowsBetween(W.unboundedPreceding, 0)
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(w.orderBy("start", "kind"))
    after = F.min(F.when(base, F.col("start"))).over(w.orderBy(F.desc("start"), F.desc("kind")))
    return F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))


def scan(docs: DataFrame, q: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, doc_id, n_assign, n_access, n_hex, base (array of struct start, kind, end), spans (likewise, with random) for every row.

    Offsets count code points, ends are exclusive; a random span that meets a base span is left
    out; of random spans at most a share ``q`` is expected to be ordinary.  Null and empty texts
    have no spans; a token of any length is tested whole; equal rows count once and get equal
    results; other columns are not looked at; an empty table gives no rows.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,m:string>>")
    found = []
    plain = F.translate(text, BAR, OTHER)  # one character for another: matches and offsets stay
    for i, pattern in enumerate(PATTERNS.values()):
        parts = F.split(F.regexp_replace(plain, pattern, f"{BAR}$0{BAR}"), BAR, -1)
        found.append(F.when(text.rlike(pattern), _numbered(i, parts)).otherwise(none))
    pieces = durable(rows.select(*KEY, F.explode(F.concat(*found)).alias("x")).select(*KEY, "x.*").distinct(), "secret-pieces")
    upto = F.sum(F.col("gap") + F.length("m")).over(W.partitionBy(*KEY, "kind").orderBy("at"))
    placed = pieces.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.length("m"))
    value = F.length(F.regexp_extract("m", PATTERNS["assign"], 2))
    good = placed.filter((F.col("kind") != 0) | (value >= 6))
    base = good.filter("kind < 3").select(*KEY, "kind", "start", "end")
    tested = durable(random_bins(good.filter("kind = 3").select(*KEY, "kind", "start", "end", "m")).drop("m"), "secret-tests")
    kept = F.lit(False)
    for cls, low in cutoffs(tested, q).items():
        kept = kept | ((F.col("cls") == cls) & (F.col("bin") >= low))
    spans = base.unionByName(tested.filter(kept).select(*KEY, "kind", "start", "end"))
    spans = spans.withColumn("_met", meets_base()).filter("kind < 3 or not _met").drop("_met")
    listed = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    listed = durable(listed.select(*KEY, F.filter("spans", lambda s: s["kind"] < 3).alias("base"), "spans"), "secret-spans")
    empty = F.array().cast(listed.schema["base"].dataType)
    out = rows.select(*KEY, F.col(id_col).alias("doc_id")).join(listed, KEY, "left").withColumns({c: F.coalesce(c, empty) for c in ("base", "spans")})
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(*KEY, "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base", "spans")


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
