"""Catalog tables: schemas from dataclasses, appends that fit a table, queries with parameters."""

from __future__ import annotations

import dataclasses
import enum
import types
import typing
from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), datetime: T.TimestampType()}
#: What a dictionary of texts is stored as.
LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("status", T.StringType())])


def _kind(hint) -> T.DataType:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        return _kind(next(a for a in args if a is not type(None)))
    if origin is list:
        return T.ArrayType(_kind(args[0]))
    if origin is dict:
        return LINK
    if dataclasses.is_dataclass(hint):
        return table_schema(hint)
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return T.StringType()
    return _PLAIN.get(hint, T.StringType())


def table_schema(model: type, include: list[str] | None = None, exclude: list[str] | None = None) -> T.StructType:
    """A dataclass as a schema: optional fields unwrapped, lists as arrays, dataclasses as structs, enums as text.

    A field of a type that is not known is text. With include only those fields count, without those in exclude.
    """
    hints = typing.get_type_hints(model)
    names = [f.name for f in dataclasses.fields(model) if (not include or f.name in include) and f.name not in (exclude or ())]
    return T.StructType([T.StructField(n, _kind(hints[n])) for n in names])


def create_tables(spark: SparkSession, database: str, schemas: Mapping[str, T.StructType], location: str | None = None) -> None:
    """Creates the tables that are not there yet, and their database, in `location` or where the warehouse puts it."""
    if location is None:
        spark.sql("CREATE DATABASE IF NOT EXISTS IDENTIFIER(:db)", args={"db": database})
    else:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS IDENTIFIER(:db) LOCATION '{location}'", args={"db": database})
    for name, schema in schemas.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.createDataFrame([], schema).write.format("parquet").saveAsTable(f"{database}.{name}")


def fitted(rows: DataFrame, columns: list[str], stamp: Column | None = None) -> DataFrame:
    """Those of the columns that rows have, in the given order, and inserted_at with a stamp."""
    kept = rows.select(*[F.col(f"`{c}`") for c in columns if c in rows.columns and c != "inserted_at"])
    return kept if stamp is None else kept.withColumn("inserted_at", stamp)


def append_rows(rows: DataFrame, table: str) -> list[str]:
    """Appends to a catalog table what of rows it has columns for; missing columns are null; stamps inserted_at.

    Rows with a value that does not fit its column are left out. Returns the distinct faults, at most one a column.
    """
    target = rows.sparkSession.table(table).schema
    ready = fitted(rows, target.names, F.current_timestamp() if "inserted_at" in target.names else None)
    there = [f for f in target.fields if f.name in ready.columns]
    faults = F.array_compact(F.array(*[F.when(F.col(f"`{f.name}`").isNotNull() & _cast(ready, f).isNull(), F.lit(f"{f.name}: not a {f.dataType.simpleString()}")) for f in there])) if there else F.array().cast("array<string>")
    checked = ready.withColumn("_faults", faults)
    found = [r.fault for r in checked.select(F.explode("_faults").alias("fault")).distinct().orderBy("fault").collect()]  # one a column
    fit = checked.where(F.size("_faults") == 0)
    fit.select(*[(_cast(ready, f) if f in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields]).write.mode("append").saveAsTable(table)
    return found


def _cast(rows: DataFrame, field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    nested = isinstance(rows.schema[field.name].dataType, (T.ArrayType, T.MapType, T.StructType))
    return column.cast(field.dataType) if nested else column.try_cast(field.dataType)


def equals_all(wanted: Mapping[str, object]) -> Column:
    """Every named column has its value; names without a value do not count; nothing named is always true."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None], F.lit(True))


def query(spark: SparkSession, text: str, parameters: Mapping[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with named parameters (:name) and tables ({name}); values are never spliced into the text."""
    return spark.sql(text, args=dict(parameters or {}), **tables)


def abstracts(papers: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Distinct pid, abstract, request_id of papers that have an abstract and fit."""
    return papers.where(F.col("abstract").isNotNull() & equals_all(wanted)).select("pid", "abstract", "request_id").distinct()
