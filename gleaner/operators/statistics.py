"""Agreement statistics over cells in long form: by pair of scenarios, by field, overall, and of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.values import is_empty

SIMILARITIES = {"cosine": "Cosine_Similarity", "fuzzy_cosine": "Fuzzy_Cosine_Similarity", "llm_meaning_equal": "LLM_Meaning_Equal"}
GAPS = {"empty_manual_nonempty_auto_pct": "Empty_Manual_NonEmpty_Auto_Pct", "empty_auto_nonempty_manual_pct": "Empty_Auto_NonEmpty_Manual_Pct"}


def _within(c: str) -> Column:
    """A measure, if it lies between 0 and 1; NaN does not."""
    return F.when(F.col(c).between(0, 1), F.col(c))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


def pair_statistics(cells: DataFrame) -> DataFrame:
    """One row per pid and pair of scenario names of rows that have a name on the auto side.

    cells: as from matching.cells(with_pid=True), with cosine (null for the pid pair). Two aggregations: each field's
    facts, then the fields'. Pairs whose score is 0 keep their names and score alone.
    """
    keys = ["pid", "scenario", "scenario_manual"]
    named = cells.where("pid is not null and scenario is not null").select(
        "pid", "scenario", F.coalesce("scenario_manual", F.lit("")).alias("scenario_manual"), "field", "pos", "score",
        (~is_empty("auto_val")).alias("mine"), (~is_empty("manual_val")).alias("theirs"), _within("cosine").alias("within"),
    )
    mine, theirs = F.col("mine"), F.col("theirs")
    by_field = named.groupBy(*keys, "field", "pos").agg(
        F.max("score").alias("score"), F.count("*").alias("n"),
        F.count_if(~theirs).alias("manual_empty"), F.count_if(~mine).alias("auto_empty"),
        F.bool_or(theirs & ~mine).alias("manual_not_auto"), F.bool_or(mine & ~theirs).alias("auto_not_manual"),
        F.sum("within").alias("s"), F.count("within").alias("k"),
    )
    missing = F.array_sort(F.collect_list(F.when(F.col("manual_not_auto"), F.struct("pos", "field"))))
    by_pair = by_field.groupBy(*keys).agg(
        F.max("score").alias("score"), F.try_divide(F.sum("s"), F.sum("k")).alias("average_match_ratio"),
        F.count_if(F.col("manual_not_auto")).alias("columns_manual_not_auto_count"),
        F.array_join(F.transform(missing, lambda x: x["field"]), ", ").alias("columns_manual_not_auto_names"),
        _percent(F.sum("manual_empty"), F.sum("n")).alias("manual_empty_percent"), _percent(F.sum("auto_empty"), F.sum("n")).alias("auto_empty_percent"),
        _percent(F.count_if(F.col("auto_not_manual")), F.count("*")).alias("empty_manual_nonempty_auto_pct"),
        _percent(F.count_if(F.col("manual_not_auto")), F.count("*")).alias("empty_auto_nonempty_manual_pct"),
    )
    facts = [c for c in by_pair.columns if c not in (*keys, "score")]
    return by_pair.select(*keys, "score", *[F.when(F.coalesce("score", F.lit(0.0)) != 0, F.col(c)).alias(c) for c in facts])


def is_matched(a: Column, m: Column) -> Column:
    """Both scenario names are there and not blank."""
    return ~is_empty(a) & ~is_empty(m)


def _spread(column: Column, name: str) -> list[Column]:
    return [F.avg(column).alias(f"{name}_Mean"), F.min(column).alias(f"{name}_Min"), F.max(column).alias(f"{name}_Max")]


def as_statistics(one_row: DataFrame) -> DataFrame:
    """(statistic, value) rows of the columns of a single row, in their order."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in one_row.columns)
    return one_row.select(F.expr(f"stack({len(one_row.columns)}, {parts}) as (statistic, value)"))


def overall_statistics(joined: DataFrame, cells: DataFrame, by_pair: DataFrame) -> DataFrame:
    """(statistic, value), 17 rows: matched and unmatched rows, similarities of matched cells, gaps of matched pairs."""
    both = is_matched(F.col("scenario"), F.col("scenario_manual"))
    rows = joined.agg(F.count_if(both).alias("Matched_Scenarios"), F.count_if(~both).alias("Unmatched_Scenarios"))
    measured = cells.where(both).agg(*[c for m, name in SIMILARITIES.items() for c in _spread(_within(m), name)])
    gaps = by_pair.where("score <> 0").agg(*[c for m, name in GAPS.items() for c in _spread(F.col(m), name)])
    return as_statistics(rows).unionByName(as_statistics(measured)).unionByName(as_statistics(gaps))


def field_statistics(cells: DataFrame) -> DataFrame:
    """Mean, least and greatest similarity of each field over cells of matched rows, by field."""
    both = is_matched(F.col("scenario"), F.col("scenario_manual"))
    short = {"cosine": "cosine", "fuzzy_cosine": "fuzzy", "llm_meaning_equal": "llm"}
    parts = [f(_within(m)).alias(f"{s}_{n}") for m, s in short.items() for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return cells.where(both).groupBy("field").agg(*parts).orderBy("field")


def execution_statistics(runs: DataFrame) -> DataFrame:
    """(statistic, value) of exec_time and total_tokens over runs; nulls where there are none."""
    names = {"exec_time": "Execution_Time", "total_tokens": "Total_Tokens"}
    return as_statistics(runs.agg(*[c for m, name in names.items() for c in _spread(F.col(m).cast("double"), name)]))


def tally(runs: DataFrame, error: str = "error") -> DataFrame:
    return runs.agg(F.count_if(F.col(error).isNull()).alias("succeeded"), F.count_if(F.col(error).isNotNull()).alias("failed"), F.array_join(F.array_sort(F.collect_set(error)), "; ").alias("errors"))
