"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, mixing, prefix_trie, quality, resampling, sentencepiece_bpe, simhash, substring_dedup, token_counts, toxicity, warc
from .oracles import ORACLE


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return verdicts.withColumns({c: F.round(c, 6) for c in ("gram_char_share", "line_char_share")})


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(turns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", toxicity.in_fold("doc_id").alias("held_out"))
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").where(~toxicity.in_fold("doc_id")))
    scored = toxicity.toxic_scores(docs, model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(_read(spark, sf_dir, "conversations"))))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resampled(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_ALL = (
    op1_quality, op2_chat, op3_mixing, op4_substring_dedup, op5_decontaminate, op6_toxicity, op7_warc, op8_simhash, op9_token_counts, op10_licenses, op11_prefix_trie, op12_sentencepiece,
    op13_resampling,
)
QUERIES = {f.__name__: f for f in _ALL}

__all__ = ["ORACLE", "QUERIES"]
