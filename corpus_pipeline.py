"""Training-corpus pipeline over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns what it keeps, with the columns of ``docs`` in all stages but the last.
``run`` writes every stage's result as Parquet below the shared folder and reads
it again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import exact_dedup, language_id, lsh_forest, packing, secrets
from pulsegrid.llm.common import durable, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: no letter, or mostly background in the mixture."""
    return language_id.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    return lsh_forest.drop_near(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced in the text (n_chars follows); all documents stay."""
    return secrets.redact(docs).withColumn(
        "n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("secret scan", secret_scan),
    ("packing", packing_plan),
]

# mixture inference, signatures and pattern packing have no SQL form; tests/llm
# holds the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"stage-{name.replace(' ', '-')}")
    return docs
