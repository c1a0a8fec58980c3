"""The library's own queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.queries import comparing, extracting, filing, reading, recording, searching

_ALL = comparing.QUERIES | reading.QUERIES | extracting.QUERIES | recording.QUERIES | searching.QUERIES | filing.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparing.field_stats(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
