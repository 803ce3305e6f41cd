"""The operators of this subpackage, each applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, chat, fingerprint, jaccard_join, language_id, line_dedup, mixing, ngram_lm, packing, url_filter
from .common import id_bucket, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_bucket(F.col("doc_id"), 5) == 1
    scored = ngram_lm.score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (F.col("mark") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op3_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "copy_id", "class_id", "links")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.train(url_filter.seed_table()))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model, keep=["doc_id", held_out.alias("held_out")])


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate(table(spark, sf_dir, "conversations")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_source_mixing, op3_bm25_search, op4_jaccard_join, op5_url_filter, op6_line_dedup, op7_language_id, op8_perspective_rotation, op9_best_fit_packing, op10_fingerprint)}

ORACLES: dict[str, str] = {"op3_bm25_search": bm25.SEARCH_SQL, "op6_line_dedup": line_dedup.DIGEST_SQL, "op8_perspective_rotation": chat.DIGEST_SQL}
