"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, secret scans, packing. Each stage calls one operator.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one packed pieces. Its input is the whole of what
the stage before kept. n_chars follows the text where a stage changes it. Null texts count as empty; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentframe.llm import jaccard, line_dedup, packing, quality, secrets
from agentframe.llm.common import documents, materialise, quoted


#: Texts that pass between Spark and Python at a time; whole rows, so results do not depend on it.
BATCH_BYTES = "8m"
#: Words that a Python worker remembers between stages: workers live on, and their memory stands beside that of the next stage.
CACHE_WORDS = 100_000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that LINE_DOCS different texts of their host have, whatever share of it that is."""
    _bounded(spark)
    return _sized(quality.kept_documents(docs, line_share=0.0)).select(*map(quoted, docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    _bounded(spark)
    index = line_dedup.LineIndex.of(docs)
    packed = docs.select(F.struct(*map(quoted, docs.columns)).alias("__row"), F.col("text").alias("__text"))
    kept = line_dedup.drop_lines(packed, index, "__text")
    return _sized(kept.select(F.col("__row").withField("text", F.col("kept_text")).alias("__row")).select("__row.*"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest doc_id (nulls last); documents without words all stay."""
    _bounded(spark)
    return jaccard.first_documents(docs).select(*map(quoted, docs.columns))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    _bounded(spark)
    detector = secrets.detector_for(docs, "doc_id", "text")
    return _sized(secrets.mask(docs, detector)).select(*map(quoted, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    _bounded(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=CACHE_WORDS)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]
#: The network of the secret scans and the packing cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
