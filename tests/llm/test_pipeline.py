"""The pipeline's stages, each on what its predecessor kept."""

import re
from collections import defaultdict

import corpus_pipeline
from strandline.llm import mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        else:
            assert docs.count() == before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "sharding"]
    assert len(kept["language_id"]) == 200

    shingles = {}
    for r in spark.read.parquet(str(tmp_path / "language_id")).collect():
        w = WORD.findall(r["text"].lower())
        shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)
    stay = kept["jaccard_join"]
    assert not any(near(shingles[a], shingles[b]) for i, a in enumerate(stay) for b in stay[:i])
    gone = set(shingles) - set(stay)
    assert gone and all(any(near(shingles[a], shingles[b]) for b in shingles if b != a) for a in gone)

    taken = defaultdict(int)
    for d in kept["mixing"]:
        taken[d] += 1
    assert set(taken.values()) <= {1, 2} and set(kept["mixing"]) <= set(kept["decontamination"])
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "decontamination"))).collect()}
    assert {d: n for d, n in plan.items() if n} == dict(taken)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "shard"} <= set(out.columns)


def test_odd_rows(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows and columns named like the operators' own go through every stage as its docstring says."""
    from .cases import SCHEMA, documents, made_texts

    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in base.collect()]
    odd = [(9001, None, "en", "s"), (9002, "", None, None), (None, None, None, None), (9003, rows[0][1], rows[0][2], rows[0][3]), rows[1], rows[1], (None, rows[2][1], rows[2][2], rows[2][3]), (9004, " 123 \n", "en", "s"), (9005, rows[3][1] * 40, rows[3][2], "s")]
    names = ["doc_id", "text", "lang", "source", "_k1", "_k2", "row", "copies", "shard", "size", "keeper", "t", "h", "accepted", "n_hit"]
    kind = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names[4:])
    docs = spark.createDataFrame([(*r, *range(len(names) - 4)) for r in rows + odd], kind)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "sharding":
            assert docs.columns == names
            assert {tuple(r)[4:] for r in docs.collect()} <= {tuple(range(len(names) - 4))}
    ids = {name: sorted((r[0] for r in df.select("doc_id").collect()), key=str) for name, df in seen.items()}
    assert not {9001, 9002, 9004} & set(ids["language_id"]) and ids["language_id"].count(None) == 1 and ids["language_id"].count(rows[1][0]) == 3
    assert 9003 not in ids["jaccard_join"] and None not in ids["jaccard_join"] and ids["jaccard_join"].count(rows[1][0]) <= 1
    assert 9005 not in ids["jaccard_join"]  # forty times one text: but for 4 windows at each seam its word windows are those of document 3
    assert seen["sharding"].count() == seen["mixing"].count() > 0

    none = documents(spark, made_texts(4)).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "sharding" or out.columns == [x.split()[0] for x in SCHEMA.split(", ")])
