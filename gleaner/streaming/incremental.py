"""Only what is new: file streams whose checkpoint knows which files have been done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def new_rows(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(format).load(path)


def run_new(rows: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, state: str, once_by: list[str] | None = None) -> None:
    """Applies work to rows of files that came since the last run and appends what it gives as Parquet.

    With once_by, of rows that are equal in these columns the first one alone counts, over all runs; the state store
    holds a key for each. A run that is cut short goes on where its checkpoint in `state` ends, without a row twice.
    """
    rows = rows.dropDuplicates(once_by) if once_by else rows
    query = work(rows).writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(output)
    query.awaitTermination()
