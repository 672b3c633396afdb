"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for each row: the text's likelihood under hashed byte
trigrams, the language its markup declares, the suffix of its address, and its host's prior.
Priors come from grouped counts over all rows and are smoothed down a hierarchy: a host leans on
its suffix, a suffix on the whole corpus.  The trigram models are fitted on a bounded sample of
declared rows and lean on a background model of all languages, so that a few rows make a class;
everything else sees every row.

Text of none of the languages goes to an unknown class, which is never accepted.  Its likelihood
is a floor: the least a trigram of the leading language is worth on average in whole rows of that
language, each of them judged by a model without itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, discard, durable, keyed, small_batches

#: Hashed trigrams, rows of each language that the trigram model is fitted on (about), those of them that tell whether it is another name of a language.
BUCKETS, FIT_ROWS, JUDGE_ROWS = 1 << 14, 500, 50
#: Declarations looked at together; weight of the background in trigrams; how much better (log P of a trigram) a language may tell its own rows
#: and still be another name of a class, and how far below the class's median these rows may lie.
ROUND, LEAN, ALIKE, TYPICAL = 256, 8192.0, 0.05, 0.35
#: Every letter stands in three trigrams, so a text's evidence is a third of their sum, at any length.
SHARED = 3.0
#: How many (robust) standard deviations below its language's median a text's mean likelihood may lie,
#: and the least such deviation between texts (licences, markup and upper case are rare, but not foreign).
SLACK, LEAST_SPREAD = 6.0, 0.4
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes that are looked at together; keys that the rows of a host are dealt to.
CHUNK, SALT = 1 << 18, 16


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed trigrams of the text's letters in lower case, in chunks; none that span only blanks."""
    raw = b" " + b" ".join((text or "").lower().encode().translate(LETTERS).split()) + b" "
    for at in range(0, len(raw) - 2, CHUNK):
        b = np.frombuffer(raw[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        yield ((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) >> np.uint32(7)) & np.uint32(BUCKETS - 1)


def classes(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, DataFrame | None]:
    """The languages, log P(trigram | language) (BUCKETS x languages), their floors, and (declared, place): the class that a declaration speaks for.

    Every declared language is a class, however few its rows, unless its rows are told at least as
    well by a class of more rows and look like that class's own rows: then it is another name of
    that class.  So codes of one language fall together by likeness, and memory follows the number
    of unlike languages.  Declarations are looked at by their number of rows, ROUND at a time.
    """
    codes = durable(rows.filter("declared is not null").groupBy("declared").agg(F.count("*").alias("total")), "langid-codes")
    names: list[str] = []
    counts, own, whole, places = np.zeros((BUCKETS, 0)), np.zeros((0, 3)), None, []
    for at in itertools.count(step=ROUND):
        new = [tuple(r) for r in codes.orderBy(F.desc("total"), "declared").offset(at).limit(ROUND).collect()]
        if not new:
            break
        sample = sample_of(rows, new)
        fresh = counted(sample, len(new))
        whole = fresh.sum(1) if whole is None else whole  # the background: the languages of most rows
        tables = np.hstack([counts, fresh])
        floor, better = judged(sample, tables, whole, len(names))
        own = np.vstack([own, floor])
        keep, stands = list(range(len(names))), {}
        for i in range(len(names), len(names) + len(new)):
            like = [k for k in keep if better[i - len(names), k] <= ALIKE and typical(better[i - len(names)], k, own[k])]
            stands[i] = min(like, key=lambda k: better[i - len(names), k]) if like else i
            if like:
                tables[:, stands[i]] += tables[:, i]
            else:
                keep.append(i)
        names += [new[i - len(names)][0] for i in keep if i >= len(names)]
        number = {k: j for j, k in enumerate(keep)}
        places += [(new[i - tables.shape[1] + len(new)][0], number[k]) for i, k in stands.items()]
        counts, own = tables[:, keep], own[keep]
        discard(sample)
        if len(new) < ROUND:
            break
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32), own, None
    order = sorted(range(len(names)), key=names.__getitem__)  # ties go to the language first by name
    place = {k: j for j, k in enumerate(order)}
    spoken = rows.sparkSession.createDataFrame([(code, place[k]) for code, k in places], "declared string, place int")
    return [names[k] for k in order], model_of(counts[:, order], whole), own[order], spoken


def smoothed(own: np.ndarray, total: np.ndarray | float, back: np.ndarray) -> np.ndarray:
    """P(trigram | language): counts that lean on the background with the weight of LEAN trigrams, a quarter of the language's own at most."""
    lean = np.minimum(LEAN, np.maximum(np.asarray(total) / 4, 1.0))
    return (own + lean * back) / (total + lean)


def background(whole: np.ndarray, less: np.ndarray | float = 0.0, n: float = 0.0, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """P(trigram) over all languages, without the counts ``less`` (n in all) of one text."""
    return (np.maximum(whole[at] - less, 0) + 0.5) / (max(whole.sum() - n, 0) + 0.5 * BUCKETS)


def model_of(tables: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log(smoothed(tables, tables.sum(0), background(whole)[:, None])).astype(np.float32)


def sample_of(rows: DataFrame, codes: list[tuple[str, int]]) -> DataFrame:
    """code, judge, text of about FIT_ROWS rows of each of the codes; about JUDGE_ROWS of them are judges. Rows are drawn where they are read, by hash, so no text is shuffled by language."""
    named = rows.sparkSession.createDataFrame([(name, i, total) for i, (name, total) in enumerate(codes)], "declared string, code int, total long")  # at most ROUND rows
    chance = F.abs(F.xxhash64("_k1", "_k2") % 1_000_000) / 1_000_000 * F.col("total")
    drawn = rows.join(F.broadcast(named), "declared").filter(chance < FIT_ROWS)
    return durable(drawn.select("code", (chance < JUDGE_ROWS).alias("judge"), "text"), "langid-sample")


def counted(sample: DataFrame, n: int) -> np.ndarray:
    """Counts of the sample's trigrams, BUCKETS x n."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, np.ndarray] = {}
        for batch in batches:
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for grams in trigrams(text.as_py()):
                    table[code] = table.get(code, 0) + np.bincount(grams, minlength=BUCKETS)
        for i, own in table.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(own[at])], names=["l", "b", "n"])

    table = np.zeros((BUCKETS, n))
    with small_batches(sample.sparkSession):
        found = sample.select("code", "text").mapInArrow(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS x ROUND
    table[found["b"].to_numpy(), found["l"].to_numpy()] += found["n"].to_numpy()
    return table


def judged(sample: DataFrame, tables: np.ndarray, whole: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(floors, better) of the languages from number ``before`` on.

    floors: the median m of the rows' mean log P(trigram), and variances v within and b between
    rows.  A text of n trigrams lies above m - SLACK * sqrt(v / n + b) if it is of the language.
    Every row is judged by the counts without its own.  Medians bear rows with a wrong declaration.
    b is LEAST_SPREAD squared at least.

    better: by how much a language tells a trigram of its judges better than each of the others
    does (by the counts without the row), and then, in two more columns, their own mean and number.
    """
    models = model_of(tables, whole)
    shared = sample.sparkSession.sparkContext.broadcast((tables, models, whole))  # 192 KB a language

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, models, whole = shared.value
        sums, out, met = counts.sum(0), [], {}
        for batch in batches:
            for code, judges, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.zeros(BUCKETS, np.int64)
                for grams in trigrams(text.as_py()):
                    own += np.bincount(grams, minlength=BUCKETS)
                at, n, i = np.flatnonzero(own), int(own.sum()), before + code
                if not n:
                    continue
                like = np.log(smoothed(counts[at, i] - own[at], sums[i] - n, background(whole, own[at], n, at)))
                mean = float(like @ own[at]) / n
                out.append((code, -1, n, mean, float((like - mean) ** 2 @ own[at]) / n))
                if judges:
                    met[code] = met.get(code, 0) + np.append(own[at] @ models[at].astype(np.float64), [mean * n, n])
        for code, total in met.items():
            out += [(code, k, 0, float(x), 0.0) for k, x in enumerate(total)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["l", "k", "n", "mean", "var"])

    with small_batches(sample.sparkSession):
        found = durable(sample.mapInArrow(judge, "l long, k long, n long, mean double, var double"), "langid-judged")
    rows = np.array([tuple(r) for r in found.filter("k < 0").select("l", "n", "mean", "var").collect()], float).reshape(-1, 4)  # about FIT_ROWS a language of the round
    n = tables.shape[1] - before
    sums = np.zeros((n, tables.shape[1] + 2))
    for r in found.filter("k >= 0").groupBy("l", "k").agg(F.sum("mean").alias("s")).collect():  # at most ROUND x languages
        sums[r["l"], r["k"]] = r["s"]
    discard(found)
    floor = np.tile([np.log(1 / BUCKETS), 0.0, 0.0], (n, 1))
    for i in range(n):
        own = rows[rows[:, 0] == i]
        if len(own):
            middle, within = np.median(own[:, 2]), np.median(own[:, 3])
            between = (1.4826 * np.median(np.abs(own[:, 2] - middle))) ** 2
            floor[i] = middle, within, between
    floor[:, 2] = np.maximum(floor[:, 2], LEAST_SPREAD**2)
    size = np.maximum(sums[:, -1:], 1)
    mean = sums[:, -2:-1] / size
    return floor, np.hstack([mean - sums[:, :-2] / size, mean, sums[:, -1:]])


def typical(better: np.ndarray, k: int, floor: np.ndarray) -> bool:
    """Whether a language's judges, taken together, are told by class k like the class's own rows, and well beyond chance: rows of a class of one say little."""
    told = better[-2] - better[k]
    return bool(told >= max(floor[0] - TYPICAL, 0.75 * np.log(1 / BUCKETS)))


def text_scores(rows: DataFrame, model: np.ndarray, floor: np.ndarray) -> DataFrame:
    """Row key, doc_id, declared, host, suffix, n_letters and loglik (one for each language, and the unknown class's last), divided by SHARED."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats: 64 KB a language

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        part = max(1, (1 << 20) // max(table.shape[1], 1))  # trigrams at a time: 4 MB
        for batch in batches:
            n, like = [], []
            for text in batch.column(6):
                t, seen, total = text.as_py(), 0, np.zeros(table.shape[1])
                for grams in trigrams(t):
                    for at in range(0, len(grams), part):
                        total += table[grams[at : at + part]].sum(0, dtype=np.float64)
                    seen += len(grams)
                n.append(len(b"".join(t.encode().translate(LETTERS).split())) if t else 0)
                if len(total):
                    middle, within, between = floor[total.argmax()]
                    total = np.append(total, seen * (middle - SLACK * np.sqrt(within / max(seen, 1) + between)))
                like.append((total / SHARED if n[-1] else total * 0).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(n, pa.int64()), pa.array(like, pa.list_(pa.float64()))], names=["_k1", "_k2", "doc_id", "declared", "host", "suffix", "n_letters", "loglik"])

    cols = rows.select("_k1", "_k2", "doc_id", "declared", "host", "suffix", "text")
    with small_batches(rows.sparkSession):
        return durable(cols.mapInArrow(each, "_k1 long, _k2 long, doc_id long, declared string, host string, suffix string, n_letters long, loglik array<double>"), "langid-scores")


def _best(scores: str | Column) -> Column:
    """Place of the largest element, the first of equals; null for an empty array."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1)


def _shares(counts: DataFrame, by: str, n: int) -> DataFrame:
    """by -> c, the counts of each of n classes as an array, and their sum t."""
    per = counts.groupBy(by, "lang").agg(F.sum("n").cast("double").alias("n")).groupBy(by)
    per = per.agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"), F.sum("n").alias("t"))
    return per.select(by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("c"), "t")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", suffix_col: str | None = None, least: float = 0.5, lean: float = 20.0) -> DataFrame:
    """Row key, doc_id, declared, language, posterior, accepted for every row.

    Rows are accepted when the text has a letter and the leading language has a posterior of
    ``least`` or more; the unknown class has its share of the posteriors, but language names the
    leading language all the same.  Null, empty and letterless texts have language null, posterior 0 and are
    not accepted; a missing declaration is no evidence; every declared language is a class or
    another name of one (classes()), in a table of any size; missing hosts and suffixes count as one
    host and suffix; ties go to the language first by name; without any declared language nothing is
    accepted; equal rows get equal results; an empty table gives no rows.
    """
    text = lambda c: F.lower(F.trim(F.col(c).cast("string"))) if c else F.lit(None).cast("string")
    extra = [c for c in (declared_col, host_col, suffix_col) if c]
    rows = keyed(docs, *extra, id_col=id_col, text_col=text_col)
    rows = rows.select(*KEY, F.col(id_col).cast("long").alias("doc_id"), text(declared_col).alias("declared"), F.coalesce(text(host_col), F.lit("")).alias("host"), F.coalesce(text(suffix_col), F.lit("")).alias("suffix"), F.col(text_col).alias("text"))
    languages, model, floor, spoken = classes(rows)
    n = len(languages)
    scores = text_scores(rows, model, floor)
    if not n:
        return scores.select(*KEY, "doc_id", "declared", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    scores = scores.join(spoken, "declared", "left").withColumns({"lang": F.when(F.col("n_letters") > 0, _best("loglik")).cast("int"), "said": F.coalesce("place", F.lit(-1))}).drop("place")
    counts = durable(scores.filter("lang is not null").groupBy("host", "suffix", "lang", "said").agg(F.count("*").alias("n")), "langid-counts")
    # declared given class, and the corpus's prior: a sum for each pair of classes at most; the last column is the unknown class, the last row no declaration
    said = np.full((n + 1, n + 1), 0.5)
    said[n] = 0
    for r in counts.groupBy("said", "lang").agg(F.sum("n")).collect():
        said[r[0], r[1]] += r[2]
    prior = said.sum(0) / said.sum()
    log_said = np.log(said[:n] / said[:n].sum(0))
    whole = F.array(*[F.lit(float(x)) for x in prior])
    smooth = lambda c, t, up: F.zip_with(c, up, lambda x, p: (x + lean * p) / (t + lean))
    suffixes = _shares(counts, "suffix", n + 1).select("suffix", smooth(F.col("c"), F.col("t"), whole).alias("up"))
    hosts = counts.groupBy("host", "suffix", "lang").agg(F.sum("n").alias("n")).withColumn("at", F.struct("host", "suffix"))
    hosts = _shares(hosts, "at", n + 1).select("at.host", "at.suffix", "c", "t").join(suffixes, "suffix")
    hosts = durable(hosts.select("host", "suffix", smooth(F.col("c"), F.col("t"), F.col("up")).alias("prior")), "langid-hosts")
    silent = [0.0] * (n + 1)  # a missing declaration says nothing
    table = docs.sparkSession.createDataFrame([(-1, silent), *((i, x.tolist()) for i, x in enumerate(log_said))], "said int, row array<double>")  # a row for each language
    # one host may have a third of all rows: they are dealt to SALT keys, and each host is there once for each
    salted = scores.withColumn("_salt", F.pmod(F.xxhash64("_k1", "_k2"), F.lit(SALT)).cast("int"))
    hosts = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = salted.join(hosts, ["host", "suffix", "_salt"], "left").withColumn("prior", F.coalesce("prior", whole)).join(F.broadcast(table), "said")
    total = F.zip_with(F.zip_with("loglik", "row", lambda a, b: a + b), "prior", lambda a, p: a + F.log(p))
    post = joined.withColumn("total", total).withColumn("top", F.array_max("total"))
    post = post.withColumn("mass", F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    fine = F.col("n_letters") > 0
    lead = F.slice("total", 1, n)
    named = F.element_at(F.array(*map(F.lit, languages)), (_best(lead) + 1).cast("int"))
    posterior = F.when(fine, F.exp(F.array_max(lead) - F.col("top")) / F.col("mass")).otherwise(F.lit(0.0))
    return post.select(*KEY, "doc_id", "declared", F.when(fine, named).alias("language"), posterior.alias("posterior"), (fine & (posterior >= least)).alias("accepted"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as rows for identify(): page_id, text, declared (the markup's lang), host, suffix (the host's last label).

    A null html has a null text and no declaration, a null url an absent host; equal pages give equal
    rows, an empty table none; other columns are left behind.
    """
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]+;", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", body.alias("text"), F.nullif(F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1), F.lit("")).alias("declared"),
                        host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"))
