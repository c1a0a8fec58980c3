"""From nested extraction results to long and wide tables. Rows are flattened in place: no shuffle before a pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import let

#: A concept's content stays JSON text until it is flattened, so numbers and lists keep the form they were written in.
RESULT_SCHEMA = "metadata struct<exec_time: double, pid: string, pdf_path: string, model: string>, tokens map<string, string>, results array<struct<concepts: array<map<string, string>>>>"

# Names that results and manual tables share.
SCENARIO, SCENARIO_NAME = "Scenario", "Scenario Name"
RENAMED = {"STUDY DETAILS_SCENARIO NAME": "SCENARIO NAME", "METADATA_PID": "PID"}

_FIELDS = "map<string, string>"


def parsed_results(json_text: Column) -> Column:
    """A result document's text as a struct; absent parts are empty, and text that is not JSON gives nulls."""
    return F.from_json(json_text, f"struct<{RESULT_SCHEMA.replace('metadata struct', 'metadata: struct').replace('tokens map', 'tokens: map').replace('results array', 'results: array')}>")


def scenario_name(concepts: Column) -> Column:
    """The name in the first concept that is a scenario with a name, or null."""
    named = F.transform(concepts, lambda c: F.try_element_at(F.from_json(F.try_element_at(c, F.lit(SCENARIO)), _FIELDS), F.lit(SCENARIO_NAME)))
    return F.try_element_at(F.filter(named, lambda n: n.isNotNull()), F.lit(1))


def field_entries(concepts: Column, key_only: bool = False) -> Column:
    """array<struct<field, value>> of an array of {concept: {field: value}}; of repeated fields the last one stays.

    Fields are named by concept and field, or with key_only by the field alone. Concepts without fields are left out.
    """
    name = (lambda c, f: f) if key_only else (lambda c, f: F.concat_ws("_", c, f))
    of_concept = lambda e: F.transform(F.map_entries(F.coalesce(F.from_json(e["value"], _FIELDS), F.create_map().cast(_FIELDS))), lambda x: F.struct(name(e["key"], x["key"]).alias("field"), x["value"].alias("value")))
    found = F.flatten(F.transform(concepts, lambda c: F.flatten(F.transform(F.map_entries(c), of_concept))))
    return last_of_each(found)


def last_of_each(entries: Column) -> Column:
    """Entries whose field does not come again later."""
    later = lambda es, x, i: F.exists(F.slice(es, i + 2, F.size(es)), lambda y: y["field"] == x["field"])
    return let(entries, lambda es: F.filter(es, lambda x, i: ~later(es, x, i)))


def upper_name(field: Column) -> Column:
    name = F.upper(field)
    for old, new in RENAMED.items():
        name = F.when(name == old, new).otherwise(name)
    return name


def flattened(results: DataFrame, key_only: bool = False) -> DataFrame:
    """pid, pdf_path, scenario_idx, scenario, field, value of result documents (columns of RESULT_SCHEMA).

    One result is one scenario; results without concepts are skipped. A result without fields gives no row.
    """
    each = results.select("metadata.pid", "metadata.pdf_path", F.posexplode("results").alias("scenario_idx", "r")).where(F.size("r.concepts") > 0)
    rows = each.select("pid", "pdf_path", "scenario_idx", scenario_name(F.col("r.concepts")).alias("scenario"), F.explode(field_entries(F.col("r.concepts"), key_only)).alias("e"))
    return rows.select("pid", "pdf_path", "scenario_idx", "scenario", upper_name(F.col("e.field")).alias("field"), F.col("e.value").alias("value"))


def wide(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row per scenario and a column per field. The fields are given, so the pivot needs no pass to find them."""
    table = rows.groupBy("pid", "pdf_path", "scenario_idx", "scenario").pivot("field", fields).agg(F.first("value"))
    return table.withColumnRenamed("pid", "PID").withColumnRenamed("pdf_path", "PDF_PATH").withColumnRenamed("scenario", "SCENARIO NAME")


def field_names(rows: DataFrame) -> list[str]:
    """The distinct fields, sorted: as many as a configuration declares, whatever the number of papers."""
    return sorted(r.field for r in rows.select("field").distinct().collect())


def union_by_name(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def unnested(documents: DataFrame) -> DataFrame:
    """id, pos, concept, value: what was found for a document's concepts, those of its aspects first, then its own.

    documents: id, aspects array<struct<name, concepts array<struct<name, items array<string>>>>>, concepts (the same
    array). Every item of a concept is a row; a document without aspects or concepts has the other's rows alone.
    """
    items = lambda c: F.flatten(F.transform(c, lambda x: F.transform(x["items"], lambda i: F.struct(x["name"].alias("concept"), i.alias("value")))))
    none = F.array().cast("array<struct<concept: string, value: string>>")
    of_aspects = F.flatten(F.transform("aspects", lambda a: items(a["concepts"])))
    rows = documents.select("id", F.posexplode(F.concat(F.coalesce(of_aspects, none), F.coalesce(items(F.col("concepts")), none))).alias("pos", "x"))
    return rows.select("id", "pos", "x.concept", "x.value")


def without_scenarios(found: DataFrame, name: str = "Scenarios") -> DataFrame:
    """Rows of found (concept, ...) but those of the list of scenarios itself."""
    return found.where(F.col("concept").isNull() | (F.col("concept") != name))


def in_column_order(table: DataFrame, key: str = "PID") -> DataFrame:
    """A union of several papers' rows with its columns sorted by name; the rows of one paper keep the order they have."""
    several = table.select(key).distinct().limit(2).count() > 1
    return table.select(*[F.col(f"`{c}`") for c in (sorted(table.columns) if several else table.columns)])


def by_scenario(nested: DataFrame, scenarios: Column) -> DataFrame:
    """From {concept: {scenario: {field: value}}} to one row per scenario with {concept: {field: value}} as JSON.

    nested: id, data (array of map<concept, JSON text>). Only the named scenarios count, and content that is empty is
    passed over; of a concept that comes twice the last one stays. Scenarios of one id are merged in its own row.
    """
    falsy = ("", "null", "{}", "[]", "0", "false", '""')
    entry = lambda e: F.transform(F.filter(F.map_entries(F.from_json(e["value"], _FIELDS)), lambda s: ~s["value"].isin(*falsy)), lambda s: F.struct(s["key"].alias("scenario"), e["key"].alias("field"), s["value"].alias("value")))
    found = F.flatten(F.transform("data", lambda m: F.flatten(F.transform(F.map_entries(m), lambda e: F.coalesce(entry(e), F.array().cast("array<struct<scenario: string, field: string, value: string>>"))))))
    rows = nested.select("id", F.explode(F.array_distinct(F.filter(F.transform(found, lambda x: x["scenario"]), lambda s: F.array_contains(scenarios, s)))).alias("scenario"), found.alias("found"))
    own = F.filter("found", lambda x: x["scenario"] == F.col("scenario"))
    return rows.select("id", "scenario", F.explode(last_of_each(own)).alias("x")).select("id", "scenario", F.col("x.field").alias("concept"), F.col("x.value").alias("content"))


def nested_manual(rows: DataFrame) -> DataFrame:
    """pid and its scenarios as map<scenario, map<field, value>>; of a field that comes twice the last one stays.

    rows: pid, idx, scenario, field, value. A row without a name is called by its place.
    """
    named = rows.withColumn("scenario", F.coalesce("scenario", F.concat(F.lit("row_"), F.col("idx"))))
    once = named.groupBy("pid", "scenario", "field").agg(F.max_by("value", "idx").alias("value"))
    inner = once.groupBy("pid", "scenario").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return inner.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("scenario", "fields"))).alias("scenarios"))
