"""An extracted table against a hand-made one: match, measure, summarise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import hashed_embedding
from gleaner.operators import flatten, matching, metrics, statistics
from gleaner.sources.workbooks import write_workbook
from gleaner.sources.writers import OPTIONAL_SHEETS, write_report
from gleaner.storage import stored


@dataclass
class Comparison:
    joined: DataFrame
    cells: DataFrame
    by_pair: DataFrame
    overall: DataFrame
    by_field: DataFrame
    manual_only: list[str]


def auto_table(results: DataFrame) -> DataFrame:
    """pid, idx, scenario and a column per field of result documents, ready to be compared."""
    rows = flatten.flattened(results)
    fields = [f for f in flatten.field_names(rows) if f not in ("SCENARIO NAME", "PID")]
    table = flatten.wide(rows, fields)
    return table.select(F.col("PID").alias("pid"), F.col("scenario_idx").cast("long").alias("idx"), F.col("SCENARIO NAME").alias("scenario"), *[F.col(f"`{f}`") for f in fields])


def compare(auto: DataFrame, manual: DataFrame, ignored: tuple[str, ...] = (), embed: Callable[[Column], Column] = hashed_embedding, judge: Callable[[Column, Column], Column] | None = None) -> Comparison:
    """auto and manual: pid, idx, scenario and fields as text. Names and cells are compared by `embed`'s vectors."""
    names = matching.scenario_names(auto).select("scenario").union(matching.scenario_names(manual).select("scenario")).distinct()
    mapping = matching.assigned(auto, manual, names.withColumn("v", embed(F.col("scenario"))))
    joined = stored(matching.full_outer(auto, manual, mapping), "comparison-joined")
    fields = matching.paired_fields(auto, manual, ignored)
    similar = metrics.with_hashed_similarity(matching.cells(joined, fields, with_pid=True), embed)
    cells = metrics.cell_metrics(similar)
    if judge:
        cells = metrics.cell_metrics(metrics.with_judgement(stored(cells, "comparison-cells"), judge), judged=True)
    cells = stored(cells.withColumns({m: F.when(F.col("field") != "PID", F.col(m)) for m in metrics.METRICS}), "comparison-cells")
    measured = cells.where("field <> 'PID'")
    by_pair = statistics.pair_statistics(cells)
    return Comparison(joined, measured, by_pair, statistics.overall_statistics(joined, measured, by_pair), statistics.field_statistics(measured), matching.manual_only_fields(auto, manual))


def wide_cells(found: Comparison, fields: list[str]) -> DataFrame:
    """joined with each field's measures as columns <FIELD>__match_<measure>, beside the field's two values."""
    keys = ["pid", "idx", "pid_manual", "idx_manual"]
    table = found.cells.groupBy(*keys).pivot("field", [f.upper() for f in fields]).agg(*[F.first(m).alias(f"_match_{m}") for m in metrics.METRICS])
    met = found.joined.alias("j").join(table.alias("t"), [F.col(f"j.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    order = [c for f in fields for c in (F.col(f"j.`{f}`"), F.col(f"j.`{f}_manual`"), *[F.col(f"t.`{f.upper()}__match_{m}`") for m in metrics.METRICS])]
    rest = [F.col(f"j.`{c}`") for c in found.joined.columns if c not in {x for f in fields for x in (f, f"{f}_manual")} and c not in ("pid", "scenario", "scenario_manual")]
    return met.select("j.pid", "j.scenario", "j.scenario_manual", *order, *rest)


def report(path: str, found: Comparison, execution: DataFrame) -> list[str]:
    """Joined data and statistics as one workbook (a path that ends in .xlsx) or as a folder of tables; names of the sheets."""
    sheets = {"Joined Data": found.joined, "Statistics": found.by_pair, "Summary Statistics": found.overall, "Field Stats": found.by_field, "Execution Statistics": execution}
    return write_workbook(path, sheets, OPTIONAL_SHEETS) if path.lower().endswith(".xlsx") else write_report(path, sheets)
