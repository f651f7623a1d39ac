"""Queries and oracle SQL of the corpus operators, production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bpe_sql, exact_dedup, language_id, lsh_forest, merkle, multi_index, packing,
               piece_bpe, projected_search, secrets, substring_dedup, token_counts, toxicity)
from .common import table


def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark, sf_dir):
    return projected_search.nearest_neighbours(table(spark, sf_dir, "embeddings"),
                                               F.col("vec_id") % 50 == 0, k=5)


def op3_near_dedup(spark, sf_dir):
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark, sf_dir):
    return bpe_sql.encode_documents(table(spark, sf_dir, "documents"), digests=True)


def op5_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark, sf_dir):
    return language_id.report(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark, sf_dir):
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return multi_index.mined(table(spark, sf_dir, "embeddings"))


def op13_piece_codec(spark, sf_dir):
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"), digests=True)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_near_dedup": op3_near_dedup,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_piece_codec": op13_piece_codec,
}

ORACLES = {
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_secret_scan": secrets.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_hard_negatives": multi_index.SQL,
}
