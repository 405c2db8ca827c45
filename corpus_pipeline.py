"""A corpus-cleaning pipeline. Each stage works on all that its predecessor kept; its result is
written as Parquet and read again. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import decontaminate, quality_rules, sentencepiece_codec, simhash, suffix_dedup
from bitloom.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes or more that also occur elsewhere are cut out of the texts."""
    return suffix_dedup.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the token ids of the text, their number, and whether the
    text comes back from them."""
    import public_tokenizers

    named = docs.select("doc_id", "lang", "source", "n_chars", docs["text"].alias("text"))
    out = sentencepiece_codec.encode_decode(named.withColumn("before", named["text"]), public_tokenizers.path("piece_bpe_32k.model"))
    return out.selectExpr("doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "decoded = coalesce(before, '') as round_trip")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
