"""One query per corpus operator, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm._io import fresh_path, table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.mixing import mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.pii import private_data

    return private_data(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.decontam import leak_measures

    return leak_measures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.sentences import GRAM, remove_repeated_spans

    return remove_repeated_spans(table(spark, sf_dir, "documents"), gram=GRAM)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gleaner.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_nearest_neighbours, op2_mixing, op3_warc, op4_minhash_near_dedup, op5_suffix_array_dedup, op6_quality_classifier, op7_pii, op8_benchmark_decontamination, op9_substring_dedup, op10_token_counts]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
