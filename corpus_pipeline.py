"""The corpus pipeline: each stage reads what its predecessor kept, as Parquet, and its decisions take effect.

STAGES, in order: toxic documents go; one document of each near-duplicate group stays; documents that hold a benchmark item
go; personal values are replaced by pseudonyms, under the key of the setting spark.tessera.pii.key where it is set; texts are
encoded and decoded by byte-level BPE.

Cases: a null text counts as empty and stays null up to the last stage, which gives it no ids; null and empty texts, and texts
without words, are one group of near-duplicates; a row without a doc_id stays only if its whole group has none; rows of one
doc_id with unlike texts stay; of repeated rows one stays; columns of the table are kept by all but the last stage, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, common, decontaminate, pii, simhash, toxicity
from tessera.llm.queries import BYTE_RANKS, pii_key


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values as pseudonyms; n_chars follows the text."""
    done = pii.pseudonymise(docs, pii_key(spark), counts=False)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    return byte_bpe.digest_documents(docs, BYTE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("pii", personal),
    ("byte_bpe", tokens),
]
#: The stages' models and permutations have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
