"""The corpus pipeline: quality rules, one document of each near-duplicate group, decontamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one with token counts and
digests; ``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import bpe, decontam, jaccard, pii, quality_rules
from lodestone.llm.common import durable

#: Near duplicates here: sets of five-word shingles with a Jaccard similarity of at least 80 %.
SHINGLE, LINK = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the learned decision list reject."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by similarity of five-word shingles."""
    return jaccard.keep_one(docs, shingle=SHINGLE, link=LINK)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size(F.col(found.columns[-1])["spans"]) == 0).select(*docs.columns)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the text."""
    found = pii.pseudonymize(docs, pii.session_key(spark))
    changed = F.size(F.col(found.columns[-1])) > 0
    length = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return found.withColumn("n_chars", length).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, beside the document."""
    return bpe.encode(docs, bpe.vocabulary_path(), digests=True)


STAGES = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one),
    ("decontamination", drop_leaks),
    ("pii", hide_persons),
    ("bpe", tokens),
]
#: Learned rules, exact similarity components and surrogates have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
