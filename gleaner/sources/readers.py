"""Sources: papers as files, extraction results, manual tables, concept configurations."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.concepts import CONFIG_COLUMNS, SCENARIO_LITERAL
from gleaner.operators.flatten import RENAMED, parsed_results
from gleaner.sources import pdf
from gleaner.sources.workbooks import workbook_parts
from gleaner.storage import stored

_STEM = r"([^/]+?)(?:\.[^./]*)?$"


def paper_files(spark: SparkSession, paths: list[str], pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, pid (the file's stem), content of the files that folders hold (not their subfolders) or paths name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
    return files.select("path", F.regexp_extract("path", _STEM, 1).alias("pid"), "content")


def paper_texts(files: DataFrame, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """path, pid, text, error: pages' texts joined without a separator. A file that cannot be read has an error.

    `pages` is a provider, such as a PDF library's reader; it runs on executors, a file at a time.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, pid, content in zip(batch["path"], batch["pid"], batch["content"], strict=True):
                try:
                    rows.append((path, pid, "".join(pages(content)), None))
                except Exception as e:  # any fault of one file stays with that file
                    rows.append((path, pid, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "pid", "text", "error"])

    return files.mapInPandas(read, "path string, pid string, text string, error string")


def pdf_papers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """paper_texts() of PDF files, by the built-in reader of pages."""
    return paper_texts(paper_files(spark, paths), pdf.pages)


def paper_tables(files: DataFrame, tables: Callable[[bytes], list[tuple[int, list[list[str]]]]]) -> DataFrame:
    """pid, page, table_no, row_no, cells of the tables that a provider finds in each file, in page order."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(pid, page, t, r, cells) for pid, content in zip(batch["pid"], batch["content"], strict=True) for t, (page, grid) in enumerate(tables(content)) for r, cells in enumerate(grid)]
            yield pd.DataFrame(rows, columns=["pid", "page", "table_no", "row_no", "cells"])

    return files.mapInPandas(read, "pid string, page int, table_no int, row_no int, cells array<string>")


def plain_pages(content: bytes) -> list[str]:
    """The offline reader: the file is one page of UTF-8 text."""
    return [content.decode("utf-8", "replace")]


def text_papers(spark: SparkSession, paths: list[str]) -> DataFrame:
    return paper_texts(paper_files(spark, paths, "*.[tT][xX][tT]"), plain_pages)


def result_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, metadata, tokens, results of JSON files, one document each; what is not such a document has no results."""
    files = spark.read.text(paths, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), parsed_results(F.col("value")).alias("d"))
    return files.select("path", F.col("d.metadata").alias("metadata"), F.coalesce("d.tokens", F.create_map().cast("map<string, string>")).alias("tokens"), F.coalesce("d.results", F.array().cast("array<struct<concepts: array<map<string, string>>>>")).alias("results"))


def runs(results: DataFrame) -> DataFrame:
    """pid, exec_time, total_tokens of result documents."""
    return results.select("metadata.pid", "metadata.exec_time", F.try_element_at("tokens", F.lit("total")).try_cast("double").alias("total_tokens"))


def table_with_headers(spark: SparkSession, path: str, header_rows: int | list[int] = 2, separator: str = ",", sheet: str | None = None) -> DataFrame:
    """A sheet of a workbook (.xlsx; the first one unless named) or of separated text: columns are named by one header
    row or by several, joined by `_`, in upper case. Of columns with the same name the first one stays.

    header_rows counts from 0; rows above the last header row are left out. Adds idx, a row's place. Such a table is
    made by hand, so it is one file and one partition; a folder of workbooks with the same header rows is one table, too,
    whose parts follow each other by name. Workbooks are read once.
    """
    heads = [header_rows] if isinstance(header_rows, int) else sorted(header_rows)
    if PurePosixPath(path).suffix.lower() == ".xlsx":
        cells = stored(workbook_parts(spark, path, sheet), "workbook-cells")
        width = cells.agg(F.max(F.size("cells"))).first()[0] or 0
        raw = cells.select(*[F.get("cells", F.lit(i)).alias(f"_c{i}") for i in range(width)], "part", "idx")
    else:
        raw = spark.read.csv(path, header=False, multiLine=True, escape='"', sep=separator).withColumns({"part": F.lit(""), "idx": F.monotonically_increasing_id()})
    tops = raw.where(F.col("idx").isin(*heads)).collect()
    top = {r["idx"]: r for r in tops if r["part"] == min(t["part"] for t in tops)}
    names: list[str] = []
    for c in raw.columns[:-2]:
        parts = [str(top[h][c]).strip() for h in heads if h in top and top[h][c] is not None and str(top[h][c]).strip()]
        name = "_".join(parts).upper()
        name = RENAMED.get(name, name) or c.upper()
        names.append(name)
    first = [i for i, n in enumerate(names) if n not in names[:i]]
    body, place = raw.where(F.col("idx") > heads[-1]), F.col("idx") - heads[-1] - 1
    if len({t["part"] for t in tops}) > 1:
        sizes = sorted(body.groupBy("part").agg(F.max("idx") - heads[-1]).collect())
        starts = [(r[0], n) for r, n in zip(sizes, itertools.accumulate((r[1] for r in sizes), initial=0), strict=False)]
        body, place = body.join(F.broadcast(spark.createDataFrame(starts, "part string, _first long")), "part"), place + F.col("_first")
    return body.select(place.alias("idx"), *[F.col(raw.columns[i]).alias(names[i]) for i in first])


def config_rows(spark: SparkSession, path: str) -> DataFrame:
    """pos and CONFIG_COLUMNS of a configuration in CSV form; column names in any case. A missing column is an error."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("pos", F.monotonically_increasing_id())
    names = {c.strip().lower(): c for c in raw.columns}
    missing = [c for c in CONFIG_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"missing columns {missing}; found {raw.columns[:-1]}")
    return raw.select("pos", *[F.col(f"`{names[c]}`").alias(c) for c in CONFIG_COLUMNS])


def json_config(spark: SparkSession, path: str) -> dict:
    """A configuration in JSON form: defaults, aspects, concepts. It is a declaration, read by the driver."""
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0].value)


def json_concepts(spark: SparkSession, config: dict, scenarios: bool = False) -> DataFrame:
    """pos, name, description, aspect, by_scenario, structure of a JSON configuration; a list of items is its fields.

    With scenarios, concepts that go by scenario begin with a field `scenario` whose values are the paper's scenarios:
    concepts.outside_scenarios() and has_every_scenario() check them.
    """
    rows = []
    for pos, c in enumerate(config["concepts"]):
        structure = c["structure"]
        items = structure.get("items")
        fields = [(k, v) for item in items for k, v in item.items()] if isinstance(items, list) else list(structure.items())
        pick = lambda k: c[k] if c.get(k) is not None else config.get("defaults", {}).get(k)  # noqa: E731, B023
        if pick("by_scenario") is None:
            raise ValueError(f"concept {c['name']!r} needs by_scenario, or a default for it")
        if scenarios and pick("by_scenario"):
            fields = [("scenario", SCENARIO_LITERAL), *fields]
        rows.append((pos, c["name"], c.get("description"), pick("aspect"), bool(pick("by_scenario")), fields))
    return spark.createDataFrame(rows, "pos long, name string, description string, aspect string, by_scenario boolean, structure array<struct<field: string, type: string>>")


def concepts_of(spark: SparkSession, path: str) -> DataFrame:
    """The concepts of a configuration, whichever of the two forms its name tells."""
    from gleaner.operators.concepts import grouped_concepts

    match PurePosixPath(path).suffix.lower():
        case ".csv":
            return grouped_concepts(config_rows(spark, path))
        case ".json":
            return json_concepts(spark, json_config(spark, path))
    raise ValueError(f"a configuration is a .csv or .json file: {path}")
