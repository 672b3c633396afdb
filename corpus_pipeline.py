"""A corpus pipeline of five stages, each by one of the corpus operators.

All stages follow rows by id and text, carry the other columns unchanged whatever their names,
and take null and empty texts, null ids, repeated rows and empty tables; each says what becomes of
them.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, langid, lsh_forest, mixing, sharding
from strandline.llm.common import KEY, durable, rowed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go: those without letters (null and empty ones too) and those of no known language.

    Equal rows stay or go together.
    """
    gone = durable(langid.identify(docs).filter("not accepted").select(*KEY).distinct(), "rejected")
    return rowed(docs).join(gone, KEY, "left_anti").select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of least id (without an id only where none has one).

    Of rows with the same id and text the first by the other columns stays.  Texts without words
    are no duplicates of other documents; rows of one id without words are of each other.
    """
    keep = durable(lsh_forest.join(docs).filter("keeper").select(*KEY).distinct(), "keepers")
    return rowed(docs).join(keep, KEY, "left_semi").groupBy(*KEY).agg(F.min("row").alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth go; texts without words stay, and equal rows stay or go together."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = durable(decontam.contamination(docs, items).filter("contaminated").select(*KEY).distinct(), "contaminated")
    return rowed(docs).join(gone, KEY, "left_anti").select("row.*")


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source (null is one) is repeated or thinned to its target: a row for each copy that the mix takes; texts without words go."""
    return mixing.mixed_documents(docs)


def sharding_by_hash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, shard and the shard's size for every row, null and empty texts (0 bytes) and repeated rows too."""
    return sharding.shard(docs).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs", "oversized")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("sharding", sharding_by_hash),
]

#: Minhash signatures and trigram models have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; what a stage returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
