"""Corpus pipeline: five stages over ``documents``, each written and read again before the next.

toxicity        documents whose noisy-or score reaches 0.5 go; the model is learned from ``labels``
near duplicates one document of each component of similarity 0.8 (5-word shingles) stays, the one with the least id
substring dedup words in 13-word windows that start in a document with a smaller id go; other texts stay as they are
decontamination documents that contain a ``benchmark`` item go
sentencepiece   every text is encoded; decoding the ids gives the text back

Every stage works on all rows its predecessor kept, with nulls, empty and repeated rows treated as its operator defines.
SQL cannot express the first and last stage, so there is no SQL; tests compare stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import contamination, jaccard, pieces, superkmers, toxicity
from batchloom.llm.durable import written
from batchloom.llm.queries import held_out

ORACLE_SQL = None


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=~held_out())
    return toxicity.score(docs, model).where("tox_score < 0.5").select(*docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_copies(docs).select(*docs.columns)


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = superkmers.with_repeats_removed(docs)
    cut = F.col("sk_removed") > 0
    out = out.withColumns({"text": F.when(cut, F.col("sk_kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("sk_kept").cast("long")).otherwise(F.col("n_chars"))})
    return out.select(*docs.columns)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def _sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("sp_ids").alias("n_tokens"), F.col("sp_ids").alias("ids"))


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("substring_dedup", _substring_dedup),
    ("decontamination", _decontamination),
    ("sentencepiece", _sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
