"""Files and tables, written and read again; declarations and their parts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators import concepts, flatten, matching, statistics
from gleaner.plans import comparison, providers
from gleaner.queries import _fixtures as fx
from gleaner.queries.extracting import CONFIG_CTES
from gleaner.sources import catalog, readers, workbooks, writers
from gleaner.storage import fresh_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a result document for each nation."""
    text = lambda c: F.col(c).cast("string")
    scenario = F.create_map(F.lit("Scenario"), F.create_map(F.lit("Scenario Name"), F.concat(F.lit("of "), "n_name"), F.lit("scenario_description"), F.lit(None).cast("string")))
    site = F.create_map(F.lit("Site"), F.create_map(F.lit("Name"), text("n_name"), F.lit("Region"), text("n_regionkey")))
    docs = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("part"), F.struct((F.col("n_regionkey") + 0.5).alias("exec_time"), text("n_nationkey").alias("pid"), F.concat(F.lit("/p/"), "n_nationkey").alias("pdf_path")).alias("metadata"),
        F.create_map(F.lit("total"), F.col("n_nationkey") * 10).alias("tokens"), F.array(F.struct(F.array(scenario, site).alias("concepts"))).alias("results"),
    )
    path = fresh_folder(spark, "documents")
    writers.write_json(docs, path, by=["part"])
    return path


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.result_files(spark, [_documents(spark, sf_dir)])
    return flatten.flattened(found).select("pid", "pdf_path", "scenario", "field", "value")


def result_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.runs(readers.result_files(spark, [_documents(spark, sf_dir)]))


def joined_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "joined")
    writers.write_joined(readers.result_files(spark, [_documents(spark, sf_dir)]), path)
    return spark.read.csv(path, header=True)


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "texts")
    _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("part"), F.concat_ws("\n", "n_name", F.lit("two lines"))).write.partitionBy("part").text(path)
    return readers.text_papers(spark, [f"{path}/*"]).select("text", "error")


def config_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "config") + ".csv"
    writers.write_table(fx.derived(spark, sf_dir, fx.CONFIG).orderBy("pos").drop("pos"), path, one_file=True)
    found = concepts.grouped_concepts(readers.config_rows(spark, path), check=False)
    return found.select("pos", "name", "description", "aspect", "by_scenario", F.array_join(F.transform("structure", lambda x: F.concat_ws("=", x["field"], x["type"])), ";").alias("structure"), "problem")


_JSON = {
    "defaults": {"by_scenario": False, "aspect": "Methods"}, "aspects": [{"name": "Methods", "description": "m"}, {"name": "Results", "description": "r"}],
    "concepts": [{"name": "Site", "description": "Where", "structure": {"Nation": "str", "Area": "List[float]"}}, {"name": "Price", "description": "Cost", "aspect": "Results", "by_scenario": True, "structure": {"items": [{"Total": "float"}]}}],
}


def _json_concepts(spark: SparkSession, scenarios: bool = False) -> DataFrame:
    path = fresh_folder(spark, "config")
    spark.createDataFrame([(json.dumps(_JSON),)], "value string").coalesce(1).write.text(path)
    return readers.json_concepts(spark, readers.json_config(spark, path), scenarios)


def json_config_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _json_concepts(spark, scenarios=True)
    return found.select("pos", "name", "description", "aspect", "by_scenario", F.array_join(F.transform("structure", lambda x: F.concat_ws("=", x["field"], x["type"])), ";").alias("structure"))


def concepts_by_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = concepts.by_aspect(concepts.with_defaults(_json_concepts(spark), {"llm_role": "reader", "by_scenario": False}))
    return found.withColumn("concepts", F.array_join("concepts", ","))


def aspect_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aspects = spark.createDataFrame([("Results",)], "name string")
    return concepts.assigned_to_aspects(_json_concepts(spark), aspects).select("pos", "name", "aspect")


def scenario_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("scenario_idx"), F.col("o_orderpriority").alias("scenario"))
    nested = concepts.under_scenarios(_json_concepts(spark).where("by_scenario"), orders)
    return nested.select("pid", "concept", F.explode("structure").alias("scenario", "fields")).select("pid", "concept", "scenario", F.array_join(F.transform("fields", lambda x: x["field"]), ",").alias("fields"))


def manual_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks with two header rows, whose third column comes twice; as many as the rows need."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pid"), "c_name", "c_mktsegment", F.lit("again").alias("x"))
    heads = ["pid", "scenario name", "b", "b"]
    path = f"{fresh_folder(spark, 'manual')}.xlsx"
    workbooks.write_workbooks(path, "Manual", [["Metadata", "Study details", "a", "a "], heads], rows, [F.col("pid").cast("long")], {"Other": (["c_custkey", "c_name", "c_mktsegment", "x"], [heads])})
    return readers.table_with_headers(spark, path, [0, 1], sheet="Manual").select("idx", "PID", "SCENARIO NAME", "A_B")


def json_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, region = fresh_folder(spark, "lines"), _table(spark, sf_dir, "region")
    writers.write_json(region, path)
    writers.append_json(region.where("r_regionkey > 1"), path)
    return spark.read.schema("r_regionkey int, r_name string").json(path)


def failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = fx.derived(spark, sf_dir, fx.PAPERS).select(F.col("doc_id").cast("string").alias("pid"), F.concat(F.lit("/p/"), "doc_id").alias("path"), F.when(F.col("doc_id") % 50 == 49, F.lit('no "text", or none')).alias("error"))
    path = fresh_folder(spark, "failures")
    writers.write_failures(papers, path)
    return spark.read.csv(path, header=True, escape='"')


def catalog_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose number can be read, in a table that has a column more and lacks one."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("inserted_at", T.TimestampType())])
    database = f"filing_{uuid.uuid4().hex}"
    catalog.create_tables(spark, database, {"parts": schema}, location=fresh_folder(spark, "database"))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 == 0, "large").otherwise(F.col("p_size").cast("string")).alias("size"), "p_brand")
    faults = catalog.append_rows(rows, f"{database}.parts")
    return spark.table(f"{database}.parts").select("id", "size", "note", F.col("inserted_at").isNotNull().alias("stamped"), F.lit("; ".join(faults)).alias("faults"))


def unnested_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda name, *values: F.struct(F.lit(name).alias("name"), F.array(*values).alias("items"))
    text = F.col("n_nationkey").cast("string")
    docs = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.array(F.struct(F.lit("Methods").alias("name"), F.array(item("Site", F.col("n_name"), text), item("Scenarios", F.lit("main"))).alias("concepts"))).alias("aspects"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(item("Region", F.col("n_regionkey").cast("string")))).alias("concepts"),
    )
    return flatten.without_scenarios(flatten.unnested(docs)).select("id", F.col("pos").cast("long").alias("pos"), "concept", "value")


def step_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("pid"), F.col("role").alias("step"), F.col("text").alias("call"))
    return concepts.step_tokens(calls)


def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "PID")
    orders = [("several", flatten.in_column_order(rows).columns), ("one", flatten.in_column_order(rows.where("PID = 1")).columns)]
    auto, manual = fx.derived(spark, sf_dir, fx.AUTO), fx.derived(spark, sf_dir, fx.MANUAL)
    orders += [("paired", matching.paired_fields(auto, manual, ("YEAR",))), ("manual", matching.manual_only_fields(auto, manual))]
    return spark.createDataFrame([(k, ",".join(v)) for k, v in orders], "of string, columns string")


def empty_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of tables without rows: counts alone have values."""
    auto, manual = fx.derived(spark, sf_dir, fx.AUTO).limit(0), fx.derived(spark, sf_dir, fx.MANUAL).limit(0)
    return comparison.compare(auto, manual, embed=fx.letters).overall


def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations as the strict and as the lenient parser reads them."""
    def strict(text: str) -> str | None:
        try:
            return concepts.parsed_type(text).simpleString()
        except ValueError:
            return None

    return spark.createDataFrame([(t, strict(t), concepts.parsed_type(t, strict=False).simpleString()) for t in _DECLARED], "declared string, strict string, lenient string")


_DECLARED = {
    "str": ("string", "string"), "float | None": ("double", "double"), "List[int]": ("array<bigint>", "array<bigint>"), "Optional[List[float]]": ("array<double>", "array<double>"), "dict[str, str]": ("map<string,string>", "map<string,string>"),
    "word": (None, "string"), "List[word]": (None, "array<string>"), "bool": ("boolean", "boolean"), "Literal:scenarios": ("string", "string"), "int | str": (None, "string"), "": (None, "string"),
}


def concept_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each JSON concept's structure as a schema, with a list of objects among its fields."""
    structures = {c["name"]: c["structure"] for c in _JSON["concepts"]}
    rows = [(name, concepts.structure_schema(s).simpleString()) for name, s in structures.items()]
    return spark.createDataFrame(rows, "name string, schema string")


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, round(providers.delay(n, 0.5), 6), round(providers.slow_delay(n, 0.5), 6)) for n in range(8)]
    return spark.createDataFrame(rows, "attempt long, quick double, slow double")


def wide_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a wide comparison, in their order."""
    found = comparison.compare(*(fx.derived(spark, sf_dir, text, deal=False) for text in (fx.AUTO, fx.MANUAL)), embed=fx.letters)
    names = comparison.wide_cells(found, ["price", "status"]).columns
    return spark.createDataFrame(list(enumerate(names)), "pos long, name string")


_VALUES = lambda rows, names: "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows) + f") AS t({names})"
_WIDE = ["pid", "scenario", "scenario_manual", *[c for f in ("price", "status") for c in (f, f"{f}_manual", *[f"{f.upper()}__match_{m}" for m in ("cosine", "fuzzy_cosine", "clean_string_equal", "numeric_exact", "numeric_distance", "llm_meaning_equal")])], "idx", "year", "pid_manual", "idx_manual", "year_manual", "unit_manual", "score"]

QUERIES = {
    "result_files": (result_files, """SELECT CAST(n_nationkey AS VARCHAR) AS pid, '/p/' || n_nationkey AS pdf_path, 'of ' || n_name AS scenario, f AS field,
        CASE f WHEN 'SCENARIO_SCENARIO NAME' THEN 'of ' || n_name WHEN 'SITE_NAME' THEN n_name WHEN 'SITE_REGION' THEN CAST(n_regionkey AS VARCHAR) END AS value
        FROM nation, (VALUES ('SCENARIO_SCENARIO NAME'), ('SCENARIO_SCENARIO_DESCRIPTION'), ('SITE_NAME'), ('SITE_REGION')) AS t(f)"""),
    "result_runs": (result_runs, "SELECT CAST(n_nationkey AS VARCHAR) AS pid, n_regionkey + 0.5e0 AS exec_time, n_nationkey * 10e0 AS total_tokens FROM nation"),
    "joined_csv": (joined_csv, """SELECT CAST(n_nationkey AS VARCHAR) AS "PID", '/p/' || n_nationkey AS "PDF_PATH", 'of ' || n_name AS "SCENARIO NAME", 'of ' || n_name AS "SCENARIO_SCENARIO NAME",
        CAST(NULL AS VARCHAR) AS "SCENARIO_SCENARIO_DESCRIPTION", n_name AS "SITE_NAME", CAST(n_regionkey AS VARCHAR) AS "SITE_REGION" FROM nation"""),
    "text_files": (text_files, "SELECT n_name || chr(10) || 'two lines' || chr(10) AS text, CAST(NULL AS VARCHAR) AS error FROM nation"),
    "config_file": (config_file, fx.with_ctes(CONFIG_CTES, "SELECT * FROM grouped")),
    "json_config_file": (json_config_file, "SELECT * REPLACE (CAST(pos AS BIGINT) AS pos) FROM (VALUES (0, 'Site', 'Where', 'Methods', false, 'Nation=str;Area=List[float]'), (1, 'Price', 'Cost', 'Results', true, 'scenario=Literal:scenarios;Total=float')) AS t(pos, name, description, aspect, by_scenario, structure)"),
    "concepts_by_aspect": (concepts_by_aspect, "SELECT * FROM (VALUES ('Methods', false, 'Site'), ('Results', true, 'Price')) AS t(aspect, by_scenario, concepts)"),
    "aspect_assignment": (aspect_assignment, "SELECT CAST(1 AS BIGINT) AS pos, 'Price' AS name, 'Results' AS aspect"),
    "scenario_nesting": (scenario_nesting, "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS pid, 'Price' AS concept, o_orderpriority AS scenario, 'Total' AS fields FROM orders"),
    "manual_sheet": (manual_sheet, """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, CAST(c_custkey AS VARCHAR) AS "PID", c_name AS "SCENARIO NAME", c_mktsegment AS "A_B" FROM customer"""),
    "json_append": (json_append, "SELECT * FROM region UNION ALL SELECT * FROM region WHERE r_regionkey > 1"),
    "failure_report": (failure_report, "SELECT CAST(c_custkey AS VARCHAR) AS pid, '/p/' || c_custkey AS path, 'no \"text\", or none' AS error FROM customer WHERE c_custkey % 50 = 49"),
    "catalog_append": (catalog_append, "SELECT p_partkey AS id, p_size AS size, CAST(NULL AS VARCHAR) AS note, true AS stamped, 'size: not a int' AS faults FROM part WHERE p_partkey % 9 <> 0"),
    "unnested_concepts": (unnested_concepts, """SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(0 AS BIGINT) AS pos, 'Site' AS concept, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 1, 'Site', CAST(n_nationkey AS VARCHAR) FROM nation
        UNION ALL SELECT n_nationkey, 3, 'Region', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 0"""),
    "step_tokens": (step_tokens, "SELECT CAST(conv_id AS VARCHAR) AS pid, role AS step, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\s\\x0b]+')), 0)) AS BIGINT) AS tokens FROM conversations GROUP BY ALL"),
    "column_order": (column_order, _VALUES([("several", "PID,n_name,n_nationkey"), ("one", "n_nationkey,n_name,PID"), ("paired", "price,status"), ("manual", "unit")], "of, columns").replace("t(of,", 't("of",')),
    "empty_statistics": (empty_statistics, "SELECT * FROM (VALUES ('Matched_Scenarios', 0e0), ('Unmatched_Scenarios', 0e0)) AS t(statistic, value) UNION ALL SELECT n || '_' || s, NULL FROM (VALUES " + ", ".join(f"('{n}')" for n in (*statistics.SIMILARITIES.values(), *statistics.GAPS.values())) + ") AS a(n), (VALUES ('Mean'), ('Min'), ('Max')) AS b(s)"),
    "declared_types": (declared_types, _VALUES([(d, *k) for d, k in _DECLARED.items()], "declared, strict, lenient")),
    "concept_schemas": (concept_schemas, "SELECT * FROM (VALUES ('Site', 'struct<Nation:string,Area:array<double>>'), ('Price', 'struct<items:array<struct<Total:double>>>')) AS t(name, schema)"),
    "retry_delays": (retry_delays, "SELECT n AS attempt, CAST(least(20, 2 ** n) AS DOUBLE) AS quick, CAST(5 * 2 ** n * 1.25 AS DOUBLE) AS slow FROM range(8) AS t(n)"),
    "wide_comparison": (wide_comparison, _VALUES(list(enumerate(_WIDE)), "pos, name").replace("*", "CAST(pos AS BIGINT) AS pos, name", 1)),
}
