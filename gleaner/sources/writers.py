"""Sinks: JSON and CSV reports, failures, timings. Each writes a folder of part files unless it is asked for one file."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.values import without_controls
from gleaner.operators import flatten


#: Sheets of a report that are left out if they have no rows.
OPTIONAL_SHEETS = ("Summary Statistics", "Field Stats", "Execution Statistics")


def write_json(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A JSON object per line, in folders by the given columns; nulls are written."""
    writer = rows.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def append_json(rows: DataFrame, path: str) -> None:
    write_json(rows, path, mode="append")


def write_table(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header. One file takes one task: for reports alone."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_joined(results: DataFrame, path: str) -> list[str]:
    """All result documents (columns of flatten.RESULT_SCHEMA) as one CSV file, a row per scenario; the columns' names."""
    rows = flatten.flattened(results)
    fields = [f for f in flatten.field_names(rows) if f not in ("PID", "SCENARIO NAME")]
    table = flatten.wide(rows, fields).orderBy("PID", "scenario_idx").drop("scenario_idx")
    write_table(table, path, one_file=True)
    return table.columns


def write_failures(papers: DataFrame, path: str) -> bool:
    """pid, path, error of papers that failed, if there are any."""
    failed = papers.where("error is not null").select("pid", "path", "error")
    if failed.isEmpty():
        return False
    write_table(failed, path, one_file=True)
    return True


def clean_for_sheets(table: DataFrame) -> DataFrame:
    """Control characters in text columns, which a workbook cannot hold, become spaces."""
    return table.withColumns({f.name: without_controls(F.col(f"`{f.name}`")) for f in table.schema.fields if isinstance(f.dataType, T.StringType)})


def write_report(path: str, sheets: dict[str, DataFrame], optional: tuple[str, ...] = OPTIONAL_SHEETS) -> list[str]:
    """A folder per sheet; optional sheets without rows are left out. Returns the names of those written."""
    written = []
    for name, table in sheets.items():
        if name in optional and table.isEmpty():
            continue
        write_table(clean_for_sheets(table), f"{path}/{name.lower().replace(' ', '_')}")
        written.append(name)
    return written


@contextmanager
def timed(spark: SparkSession, path: str, run: str, step: str) -> Iterator[None]:
    """Appends run, step, start, end and seconds of a block to a table of timings."""
    start = time.time()
    yield
    end = time.time()
    row = spark.createDataFrame([(run, step, start, end, end - start)], "run string, step string, start double, end double, seconds double")
    row.write.mode("append").option("header", True).csv(path)
