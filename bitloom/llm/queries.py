"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import digests

    return digests(table(spark, sf_dir, "documents"), _tokenizer())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn_and_identify

    return learn_and_identify(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hexadecimal, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hexadecimal().alias("fingerprint"), "component_id")


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import conversations

    return conversations(table(spark, sf_dir, "conversations"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .token_rollup import maintained

    return maintained(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed

    return removed(table(spark, sf_dir, "documents"))


def op10_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrapper_html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_rules": op1_quality_rules, "op2_sentencepiece": op2_sentencepiece, "op3_warc": op3_warc, "op4_langid": op4_langid, "op5_decontaminate": op5_decontaminate, "op6_simhash": op6_simhash, "op7_quotes": op7_quotes, "op8_token_counts": op8_token_counts, "op9_suffix_dedup": op9_suffix_dedup, "op10_wrapper_html": op10_wrapper_html}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, quality_rules, quotes, suffix_dedup, warc

    return {"op1_quality_rules": quality_rules.oracle_sql(), "op7_quotes": quotes.ORACLE_SQL, "op5_decontaminate": decontaminate.ORACLE_SQL, "op3_warc": warc.ORACLE_SQL, "op9_suffix_dedup": suffix_dedup.ORACLE_SQL}
