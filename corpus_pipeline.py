"""Documents to a training mixture in five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents as they came, the last adds what the mix takes.

Defined results, for every stage: extra columns pass through whatever their names (but for those the last one makes);
rows that repeat an id and a text share one fate; an empty table stays empty; texts of any length are read whole.  What nulls and
empty texts give is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmark.llm import decontam, jaccard, langid, mixing, secrets
from proofmark.llm.common import materialize, remove, scope, shared_dir, spread


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language: models are learned from all labelled rows.

    A document goes if it has no letter (null and empty texts, too), or if its best mixture explains its letters
    far worse than chance, as in an unlearned language or in junk.  Without any label nothing is learned and all go.
    Null ids and sources are no matter.
    """
    return langid.keep_known(docs, langid.learn(docs.select("text", "lang")))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of exact and near copies.

    Null and empty texts are in no group and stay; of a group's rows those without an id go if any has one.
    """
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or a paraphrase of one; null and empty texts hold none and stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document; secrets in it become a mark, and n_chars follows.  Null texts stay null."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, taken and repeats.

    A null source is a source of its own; documents without words are not taken; ties of a hash bin are taken together.
    """
    mixed = mixing.mix(docs)
    return mixed.where("taken > 0").withColumn("repeats", (F.col("taken") / F.col("size")).cast("int"))


STAGES = [
    ("language id", language_id),
    ("n-gram jaccard join", jaccard_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
]

#: SQL cannot express the first and third stage; tests/llm holds the rows against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    folder = shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        with scope(spark):  # what an operator wrote on its way goes with it
            docs = materialize(stage(spark, docs, sf_dir), folder, f"stage{i}")
        if i:
            remove(spark, f"{folder}/stage{i - 1}")
    return docs
