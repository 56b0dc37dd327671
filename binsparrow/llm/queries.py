"""The corpus operators over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curves, decontam, importance, langid, lexical, negatives, neardup, packing, sharding, substring, token_files, transducer, warc

ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_whole(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return importance.importance_resample(table(spark, sf_dir, "documents"), target, share=0.5)


def op3_hilbert_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), bpe(), capacity=2048, end_id=0)


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(table(spark, sf_dir, "pages"))


ORACLE["op6_revisits"] = warc.oracle_sql()


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), bpe(), end_id=2)


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op9_spaced_seeds"] = decontam.oracle_sql()


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.even_tree(8))


def op11_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), bpe(), limit=1024)


def op12_wavelet_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE["op12_wavelet_trees"] = lexical.oracle_sql()


def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), every=100, positives=5, negatives=5, low=80)


ORACLE["op13_norm_buckets"] = negatives.oracle_sql()


QUERIES = {f.__name__: f for f in (op1_kneser_ney, op2_importance, op3_hilbert_curves, op4_block_anchors, op5_best_fit_packing, op6_revisits, op7_chosen_path, op8_token_files, op9_spaced_seeds, op10_hash_tree, op11_transducer, op12_wavelet_trees, op13_norm_buckets)}
