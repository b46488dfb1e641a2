"""A training-data pipeline over documents: five stages, each written as Parquet and read again as the next one's input.

quality: documents that the classifier rejects go. near_duplicates: one document of each group stays, the one of least id.
personal_data: spans are replaced by marks. mixing: sources are brought to their target weights, so documents repeat or go.
tokens: ids of every document, with digests of the ids and of the text decoded from them.

Tables in between hold the columns of documents. A stage reads no text twice over the network: what it decides (scores, classes, spans,
thresholds) is worked out beside the rows or joined to them from a side that is small and counted, else by a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, jaccard, mixing, pii, quality
from tarn.llm.common import documents, settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out()).select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    return quality.select(docs, labels, least=0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs, pii.learn(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: A kernel classifier, a similarity join and tokenization are beyond SQL; the tests hold each stage against a plain version, and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
