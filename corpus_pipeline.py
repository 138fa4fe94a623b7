"""The corpus pipeline: quality rules, near-duplicates, repeated strings, mixing and tokens, in that order.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; all but the last return the columns of
``documents``. The driver, like ``run``, writes each result as Parquet and reads it again for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, quality, simhash, suffix_dedup
from tessera.llm.common import table
from tessera.store import checkpointed, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go; null languages and sources are groups; rows alike are judged alike; an empty table
    stays empty. Texts are measured once: what is kept for the verdict is a row of numbers under 128 bits of hashes of the document.
    """
    key = [F.xxhash64(F.lit(seed), "doc_id", "text", "lang", "source").alias(f"quality_key_{seed}") for seed in (1, 2)]
    names = ["quality_key_1", "quality_key_2"]
    measured = checkpointed(quality.measures(docs.select("text", "lang", "source", *key), keep=["lang", "source", *names]))
    kept = quality.judge(measured, quality.fences(measured)).where("quality_kept").select(*names)
    return docs.select(F.struct("*").alias("quality_row"), *key).join(kept, names, "left_semi").select("quality_row.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles at a similarity of 0.8.

    The least id stays, null ids last; null and empty texts are one group; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 100 bytes that start earlier too.

    Null texts stay null; a null id is the smallest; rows alike in id and text are one document; texts that lose all are empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = suffix_dedup.cut(docs.select("doc_id", "text", F.struct(*others).alias("suffix_row")))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return left.select(*(own.get(c, F.col("suffix_row")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, three times at most.

    Texts without words are not taken; null is a source; rows alike are documents of their own; an empty table stays empty.
    """
    return mixing.materialise(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, and the text that they decode to; a null text is empty."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    keep = ["doc_id", "lang", "source"]
    coded = bpe.round_trip(docs, path, keep)
    return coded.select(*keep, F.size("bpe_ids").cast("long").alias("n_tokens"), F.col("bpe_ids").alias("ids"), F.col("bpe_decoded").alias("text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; their results are tables in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
