"""Results, configurations, tasks, usage, and the extraction plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import concepts, flatten, statistics
from gleaner.plans import extraction
from gleaner.queries import _fixtures as fx


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.derived(spark, sf_dir, fx.RESULTS).select("id", flatten.parsed_results(F.col("doc")).alias("d")).select("id", "d.*")


def flatten_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.flattened(_results(spark, sf_dir)).select("pid", "pdf_path", F.col("scenario_idx").cast("long").alias("scenario_idx"), "scenario", "field", "value")


def wide_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flatten.flattened(_results(spark, sf_dir))
    return flatten.wide(rows, ["PRICE_TOTAL", "PRICE_STATUS", "PRICE_TAGS", "PID"]).drop("PID").select("PDF_PATH", F.col("scenario_idx").cast("long").alias("scenario_idx"), "SCENARIO NAME", "PRICE_TOTAL", "PRICE_STATUS", "PRICE_TAGS")


def explode_by_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    inner = F.to_json(F.create_map("o_orderpriority", F.create_map(F.lit("status"), F.col("o_orderstatus")), F.lit("5-LOW "), F.create_map(F.lit("status"), F.lit("low"))))
    nested = orders.select(F.col("o_orderkey").alias("id"), F.array(F.create_map(F.lit("Price"), inner, F.lit("Site"), inner), F.create_map(F.lit("Site"), F.to_json(F.create_map("o_orderpriority", F.create_map(F.lit("k"), F.col("o_orderkey").cast("string")))))).alias("data"))
    return flatten.by_scenario(nested, F.array(F.lit("1-URGENT"), F.lit("5-LOW "), F.lit("5-LOW")))


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.union_by_name(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region")])


def nested_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.derived(spark, sf_dir, fx.MANUAL).select("pid", "idx", "scenario", F.expr("stack(2, 'PRICE', price, 'YEAR', year) as (field, value)"))
    found = flatten.nested_manual(rows)
    return found.select("pid", F.size("scenarios").cast("long").alias("n_scenarios"), F.array_join(F.array_sort(F.map_keys("scenarios")), "|").alias("names"), F.try_element_at(F.try_element_at("scenarios", F.lit("5-LOW")), F.lit("YEAR")).alias("low_year"))


def config_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = concepts.grouped_concepts(fx.derived(spark, sf_dir, fx.CONFIG), check=False)
    return found.select("pos", "name", "description", "aspect", "by_scenario", F.array_join(F.transform("structure", lambda x: F.concat_ws("=", x["field"], x["type"])), ";").alias("structure"), "problem")


def config_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.configured_aspects(fx.derived(spark, sf_dir, fx.CONFIG))


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.grouped_concepts(fx.derived(spark, sf_dir, fx.CONFIG).where("pos in (0, 1, 2, 6, 7, 11)"))


def task_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("pid"), F.col("c_name").alias("text"))
    scenarios = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("scenario_idx"), F.col("o_orderpriority").alias("scenario"))
    sections = docs.where("cast(pid as int) % 2 = 0").select("pid", F.lit("Methods").alias("section"), F.concat(F.lit("methods of "), "text").alias("section_text"))
    tasks = concepts.extraction_tasks(docs, scenarios, _concepts(spark, sf_dir), sections)
    return tasks.select("pid", F.col("scenario_idx").cast("long").alias("scenario_idx"), "scenario", "concept", "description", F.size("structure").cast("long").alias("n_fields"), "text")


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.token_usage(fx.derived(spark, sf_dir, fx.CALLS))


def scenario_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto, manual = fx.derived(spark, sf_dir, fx.AUTO), fx.derived(spark, sf_dir, fx.MANUAL)
    return concepts.outside_scenarios(manual.where("scenario is not null").select("pid", "scenario", "idx"), auto.where("scenario is not null"))


def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = (spark.read.parquet(f"{sf_dir}/{t}.parquet").withColumnRenamed("doc_id", "pid") for t in ("documents", "labels"))
    return extraction.unprocessed(docs, done).select("pid", "source", "n_chars")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return statistics.tally(docs.select(F.when(F.col("n_chars") < 100, F.concat(F.lit("too short: "), "lang")).alias("error")))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fx.derived(spark, sf_dir, fx.PAPERS)
    return text.select(F.col("doc_id").cast("string").alias("pid"), F.concat(F.lit("/papers/"), "doc_id").alias("path"), "text", F.when(F.col("doc_id") % 50 == 49, "unreadable").alias("error"))


def _extracted(spark: SparkSession, sf_dir: str, head: str = "", **how: str) -> extraction.Extraction:
    config = spark.createDataFrame([(0, "Site", "Where", "Methods", False, [("System boundary", "str")]), (1, "Outcome", "What", "Results", True, [("Yield", "float")])], "pos long, name string, description string, aspect string, by_scenario boolean, structure array<struct<field: string, type: string>>")
    return extraction.extract(_papers(spark, sf_dir).withColumn("text", F.concat(F.lit(head), "text")), config, **how)


def _flat(found: extraction.Extraction) -> DataFrame:
    return flatten.flattened(found.results).select("pid", "pdf_path", F.col("scenario_idx").cast("long").alias("scenario_idx"), "scenario", "field", "value")


def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extraction with the rule-based extractor, flattened."""
    return _flat(_extracted(spark, sf_dir))


def extraction_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of papers with two scenarios, each concept being asked once for both, over whole texts."""
    return _flat(_extracted(spark, sf_dir, "Scenario: low\nScenario: high\n", scope="full", scenario_mode="schema"))


def extraction_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_extracted(spark, sf_dir, scope="per_section"))


def extraction_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).failures


def _extraction(scenarios: list[tuple[int, str]]) -> str:
    """What the rules find in each readable paper, for each of its scenarios."""
    named = ", ".join(f"({i}, '{s}')" for i, s in scenarios)
    return f"""SELECT CAST(c_custkey AS VARCHAR) AS pid, '/papers/' || c_custkey AS pdf_path, CAST(i AS BIGINT) AS scenario_idx, s AS scenario, f AS field,
        CASE f WHEN 'SITE_SYSTEM BOUNDARY' THEN c_mktsegment WHEN 'OUTCOME_YIELD' THEN CAST(c_custkey % 97 AS VARCHAR) ELSE s END AS value
        FROM customer, (VALUES {named}) AS a(i, s), (VALUES ('SITE_SYSTEM BOUNDARY'), ('SCENARIO_SCENARIO NAME'), ('OUTCOME_YIELD')) AS b(f) WHERE c_custkey % 50 <> 49"""


_RESULTS = {
    "docs": fx.duck(fx.RESULTS),
    "results": "SELECT docs.id, doc, CAST(r.key AS BIGINT) AS scenario_idx, r.value AS r FROM docs, json_each(doc, '$.results') AS r WHERE json_array_length(r.value, '$.concepts') > 0",
    "concepts": "SELECT results.id, doc, scenario_idx, r, CAST(c.key AS BIGINT) AS ci, c.value AS c FROM results, json_each(r, '$.concepts') AS c",
    "entries": "SELECT concepts.id, doc, scenario_idx, r, ci, e.key AS concept, e.value AS content FROM concepts, json_each(c) AS e WHERE json_type(e.value) = 'OBJECT'",
    "fields": "SELECT entries.id, doc, scenario_idx, ci, upper(concept || '_' || f.key) AS field, CASE json_type(f.value) WHEN 'VARCHAR' THEN f.value ->> '$' WHEN 'NULL' THEN NULL ELSE CAST(f.value AS VARCHAR) END AS value FROM entries, json_each(content) AS f",
    "last": "SELECT * FROM fields QUALIFY row_number() OVER (PARTITION BY id, scenario_idx, field ORDER BY ci DESC) = 1",
    "flat": """SELECT doc ->> '$.metadata.pid' AS pid, doc ->> '$.metadata.pdf_path' AS pdf_path, scenario_idx, CASE WHEN scenario_idx = 0 THEN doc ->> '$.results[0].concepts[0].Scenario."Scenario Name"' END AS scenario,
        CASE field WHEN 'METADATA_PID' THEN 'PID' ELSE field END AS field, value FROM last""",
}
_STRUCT = "string_agg(structure_title || '=' || structure_data_type, ';' ORDER BY first_pos)"
CONFIG_CTES = {
    "rows": fx.duck(fx.CONFIG),
    "named": "SELECT pos, trim(name) AS name, description, aspect, lower(by_scenario) IN ('true', '1', 'yes', 'y') AS by_scenario, structure_title, structure_data_type FROM rows WHERE name IS NOT NULL AND lower(trim(name)) NOT IN ('', 'nan', 'none') AND NOT starts_with(name, 'DEFAULT:')",
    "titled": "SELECT name, structure_title, arg_max(structure_data_type, pos) AS structure_data_type, min(pos) AS first_pos FROM named WHERE structure_title <> '' GROUP BY ALL",
    "structures": f"SELECT name, {_STRUCT} AS structure FROM titled GROUP BY name",
    "grouped": """SELECT CAST(min(pos) AS BIGINT) AS pos, n.name, arg_min(description, pos) AS description, arg_min(aspect, pos) AS aspect, arg_min(by_scenario, pos) AS by_scenario, coalesce(any_value(s.structure), '') AS structure,
        CASE WHEN count(DISTINCT description) > 1 THEN 'inconsistent description for concept ' || n.name WHEN any_value(s.structure) IS NULL THEN 'no structure field for concept ' || n.name END AS problem FROM named n LEFT JOIN structures s ON s.name = n.name GROUP BY n.name""",
}

QUERIES = {
    "flatten_concepts": (flatten_concepts, fx.with_ctes(_RESULTS, "SELECT * FROM flat")),
    "wide_results": (wide_results, fx.with_ctes(_RESULTS, """SELECT pdf_path AS "PDF_PATH", scenario_idx, scenario AS "SCENARIO NAME", max(value) FILTER (field = 'PRICE_TOTAL') AS "PRICE_TOTAL", max(value) FILTER (field = 'PRICE_STATUS') AS "PRICE_STATUS", max(value) FILTER (field = 'PRICE_TAGS') AS "PRICE_TAGS" FROM flat GROUP BY pid, pdf_path, scenario_idx, scenario""")),
    "explode_by_scenario": (explode_by_scenario, """SELECT o_orderkey AS id, o_orderpriority AS scenario, 'Price' AS concept, '{"status":"' || o_orderstatus || '"}' AS content FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
        UNION ALL SELECT o_orderkey, o_orderpriority, 'Site', '{"k":"' || o_orderkey || '"}' FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
        UNION ALL SELECT o_orderkey, '5-LOW ', c, '{"status":"low"}' FROM orders, (VALUES ('Price'), ('Site')) AS t(c)"""),
    "union_by_name": (union_by_name, "SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region"),
    "nested_manual": (nested_manual, fx.with_ctes({"m": fx.duck(fx.MANUAL), "n": "SELECT pid, idx, coalesce(scenario, 'row_' || idx) AS s, year FROM m"}, "SELECT pid, count(DISTINCT s) AS n_scenarios, array_to_string(list_sort(list_distinct(list(s))), '|') AS names, arg_max(year, idx) FILTER (s = '5-LOW') AS low_year FROM n GROUP BY pid")),
    "config_group": (config_group, fx.with_ctes(CONFIG_CTES, "SELECT * FROM grouped")),
    "config_aspects": (config_aspects, fx.with_ctes({"rows": fx.duck(fx.CONFIG)}, "SELECT CAST(min(pos) AS BIGINT) AS pos, aspect AS name, aspect AS description FROM rows WHERE name IS NOT NULL AND trim(name) NOT IN ('', 'nan') AND aspect <> 'nan' GROUP BY aspect")),
    "task_fanout": (task_fanout, """SELECT CAST(c_custkey AS VARCHAR) AS pid, CAST(NULL AS BIGINT) AS scenario_idx, CAST(NULL AS VARCHAR) AS scenario, 'Site' AS concept, 'Where it is' AS description, CAST(2 AS BIGINT) AS n_fields,
        CASE WHEN c_custkey % 2 = 0 THEN 'methods of ' || c_name ELSE c_name END AS text FROM customer
        UNION ALL SELECT CAST(o_custkey AS VARCHAR), o_orderkey, o_orderpriority, 'Price', 'What it costs - for scenario ''' || o_orderpriority || '''', 2, c_name FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "token_usage": (token_usage, fx.with_ctes({"c": fx.duck(fx.CALLS)}, """SELECT pid, CASE WHEN grouping(scope) = 1 THEN 'total' ELSE scope END AS scope, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(q) AS BIGINT) AS completion_tokens, CAST(sum(p + q) AS BIGINT) AS total_tokens
        FROM (SELECT pid, coalesce(scenario, 'aspect_tokens') AS scope, coalesce(prompt_tokens, 0) AS p, completion_tokens AS q FROM c) GROUP BY GROUPING SETS ((pid, scope), (pid))""")),
    "scenario_constraint": (scenario_constraint, fx.with_ctes({"a": fx.duck(fx.AUTO), "m": fx.duck(fx.MANUAL)}, "SELECT pid, scenario, idx FROM m WHERE scenario IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.pid = m.pid AND a.scenario = m.scenario)")),
    "skip_existing": (skip_existing, "SELECT doc_id AS pid, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "failures": (failures, "SELECT count(*) FILTER (n_chars >= 100) AS succeeded, count(*) FILTER (n_chars < 100) AS failed, coalesce(array_to_string(list_sort(list_distinct(list('too short: ' || lang) FILTER (n_chars < 100))), '; '), '') AS errors FROM documents"),
    "extraction_plan": (extraction_plan, _extraction([(0, "main")])),
    "extraction_per_section": (extraction_per_section, _extraction([(0, "main")])),
    "extraction_at_once": (extraction_at_once, _extraction([(0, "low"), (1, "high")])),
    "extraction_failures": (extraction_failures, "SELECT CAST(c_custkey AS VARCHAR) AS pid, '/papers/' || c_custkey AS path, 'unreadable' AS error FROM customer WHERE c_custkey % 50 = 49"),
}
