"""The operators over their whole tables, with production parameters: one query for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import oracle
from millrace.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import pii

    return pii.digests(table(spark, sf_dir, "documents"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import repeats

    return repeats.without_repeats(table(spark, sf_dir, "documents"), 200, digest=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import decontam

    return decontam.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import shards

    return shards.shard(table(spark, sf_dir, "documents"), 16)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import secrets

    return secrets.digests(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import media

    return media.digests(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm import lm

    return lm.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import quality

    return quality.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_neardup, op3_repeats, op4_decontamination, op5_sharding, op6_secrets, op7_media, op8_bpe, op9_lm, op10_quality)
}

#: DuckDB SQL of those that SQL can express fast enough over whole tables.
ORACLE_SQL: dict[str, str] = {"op2_neardup": oracle.OP2, "op3_repeats": oracle.OP3, "op4_decontamination": oracle.OP4}
