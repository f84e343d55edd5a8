"""A training corpus from raw documents, in five stages that each call one operator of lakeloom.llm.

Stages 1 to 4 return the columns of documents; the last returns each document's token ids. A stage judges its own input:
1. toxicity: documents whose probability of `toxic` reaches 0.5 go.
2. near_duplicates: of each group of documents (five-word shingles, similarity 0.8) the one with the least doc_id stays.
3. substring_dedup: words inside passages of 35 words or more that occur elsewhere go; a changed text is its words that are
   left, joined by one space, and n_chars follows. Documents stay, even if nothing is left of their text.
4. decontamination: documents that hold a benchmark window of 10 words go.
5. bpe: doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256.

A null text counts as empty; a null doc_id is linked with nothing and stays. Further columns come through unchanged, whatever their
names; n_chars may be absent. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, decontam, minhash, substr, toxicity
from lakeloom.llm._common import stored, table
from lakeloom.llm.registry import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs, n=5, per_cent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows of one doc_id may differ in text, so the text is part of the key
    cut = substr.removed(docs, length=35).filter("n_removed > 0").groupBy(F.struct("doc_id", "text_md5").alias("cut_of")).agg(F.decode(F.any_value("kept"), "UTF-8").alias("left_text"))
    # the documents' columns in a struct of their own meet no names of ours
    whole = docs.select(F.struct("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5")).alias("own_key"), F.struct("*").alias("own"))
    joined = whole.join(cut, F.col("own_key") == F.col("cut_of"), "left")
    left, changed = F.col("left_text"), F.col("left_text").isNotNull()
    new = {"text": F.coalesce(left, F.col("own.text")), "n_chars": F.when(changed, F.char_length(left)).otherwise(F.col("own.n_chars")) if "n_chars" in docs.columns else None}
    own = lambda c: F.col("own").getField(c)
    return joined.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else own(c).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(docs, path), path)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The stages train a classifier, hash and tokenize; SQL cannot express them. tests/llm/test_pipeline.py checks them by
#: brute force; the first against its operator, which tests/llm/test_toxicity.py holds against a plain chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a written table, from which the next one starts."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
