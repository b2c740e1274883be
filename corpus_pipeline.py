"""From raw documents to token ids: the stages of a training corpus, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a frame with the columns of ``documents``; the last returns token ids.
Rows are judged by their own text, also where a doc_id is null or repeats; of equal texts, rows without a doc_id go if one
with it stays. Only the near-duplicate stage knows documents by doc_id: there, rows without one stay, and rows of one
doc_id stay or go together.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm import bpe, decontamination, exact_dedup, jaccard_join, language_id
from demandspark.session import shared_dir

TOKENIZER = "byte_bpe_50k.json"


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    # What is dropped has no bound, so the join is a merge at every size.
    return docs.join(dropped.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; those without a letter or with too low a score go."""
    return language_id.accepted(docs, language_id.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, the document with the largest doc_id."""
    gone = exact_dedup.exact_groups(docs, digest=True).filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")).distinct().hint("merge")
    text = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (text == gone["gone_text"]), "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 80 % of their five-word shingles, the one with the least doc_id."""
    return _without(docs, jaccard_join.jaccard_groups(docs, words=5, percent=80).filter("doc_id <> component_id"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, benchmark)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the text that the ids decode to."""
    return bpe.recode(docs, public_tokenizers.path(TOKENIZER)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", token_ids),
]

# The language model, the shingle join and the BPE have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
