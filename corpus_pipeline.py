"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. run() writes what a stage
returns as Parquet in the folder that driver and executors share, and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.decontaminate import without_contaminated
from parchment.llm.pieces import encode
from parchment.llm.quality import kept_documents
from parchment.llm.secrets import redact
from parchment.llm.shared import forget, new_path
from parchment.llm.similar import first_of_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that pairs of Jaccard similarity 0.8 or more, by five-word shingles, connect."""
    return first_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows."""
    return redact(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of every text, which decode to it."""
    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("sentence pieces", piece_ids),
]
#: SQL can express neither the classifier nor the fingerprints' hash; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out, at = stage(spark, docs, sf_dir), new_path(spark, name.replace(" ", "-"))
        out.write.parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)
        if before:  # nothing reads a stage's input again once its output is written
            forget(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
