"""A training corpus from ``documents``: toxic documents, repeated lines, near copies and benchmark leaks go; the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import byte_bpe, decontamination, jaccard_join, line_dedup, toxicity
from lattica.llm.common import read, shared_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. Rows with null ids or texts are scored like any other."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxic_score(docs["`text`"], model) < 0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat; n_chars is counted anew. A document may be left with an empty text."""
    out = line_dedup.line_dedup(docs, counts=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Rows with a null id stay; rows that share an id stay or go together, and stay if one of their texts leads its group.
    """
    found = jaccard_join.jaccard_join(docs).filter("doc_id IS NOT NULL")
    gone = found.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("class_id")).alias("gone")).filter("gone").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["`doc_id`"] == gone["gone_id"], "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them. Rows with a null id stay."""
    found = decontamination.contaminated(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs["`doc_id`"] == found["found_id"], "left_anti")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as tokens: (doc_id, n_tokens, ids_sha256, decoded_sha256, tokens), ids as little-endian unsigned 32-bit integers."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, digests=True).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", encoding_stage),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
