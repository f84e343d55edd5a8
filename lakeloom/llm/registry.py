"""Queries of this subpackage: opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import bpe, chat, decontam, maxent, merkle, minhash, onebit, oracles, repair, simhash, substr, tokencount, toxicity, turns
from lakeloom.llm._common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_pairs(chat.branched_pairs(table(spark, sf_dir, "conversations"))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path), path)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(table(spark, sf_dir, "documents"))


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=2)
    return repair.read(spark, path)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokencount.write_flat(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return tokencount.named(tokencount.scan(files), files)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=4, per_cent=80)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.digests(substr.removed(table(spark, sf_dir, "documents"), length=35))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))


def op13_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.neighbours(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_toxicity, op3_bpe, op4_simhash, op5_maxent, op6_repair, op7_token_counts, op8_decontamination, op9_minhash_dedup, op10_substring_dedup, op11_merkle, op12_turns, op13_onebit)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
