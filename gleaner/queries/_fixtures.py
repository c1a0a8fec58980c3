"""Inputs that are derived from the driver's tables by the same SQL text on both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.vectors import stop_words
from gleaner.storage import dealt, stored

_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)"

AUTO = f"""SELECT CAST(o_custkey AS STRING) AS pid, CAST(o_orderkey AS BIGINT) AS idx,
    CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderpriority END AS scenario,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE {_PRICE} END AS price,
    CASE WHEN o_orderkey % 37 = 0 THEN '  ' ELSE o_orderstatus END AS status,
    CAST(year(o_orderdate) AS STRING) AS year
    FROM {{orders}} WHERE o_orderkey % 17 <> 0"""

MANUAL = f"""SELECT CAST(o_custkey AS STRING) AS pid, CAST(o_orderkey AS BIGINT) AS idx,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'MANUAL ' || o_orderpriority ELSE o_orderpriority END AS scenario,
    CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN replace({_PRICE}, '.', ',')
        WHEN 3 THEN CAST(CAST(o_totalprice + 1.5 AS DECIMAL(12,2)) AS STRING) ELSE {_PRICE} END AS price,
    CASE o_orderkey % 5 WHEN 0 THEN lower(o_orderstatus) WHEN 1 THEN ' ' || o_orderstatus || ' ' WHEN 2 THEN NULL WHEN 3 THEN 'X' ELSE o_orderstatus END AS status,
    CAST(year(o_orderdate) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS STRING) AS year,
    'kg' AS unit
    FROM {{orders}} WHERE o_orderkey % 13 <> 0"""

SCENARIO_VECTORS = """SELECT n.scenario, e.embedding AS v FROM (
        SELECT scenario, row_number() OVER (ORDER BY scenario) - 1 AS vec_id FROM (
            SELECT o_orderpriority AS scenario FROM {orders} UNION SELECT 'MANUAL ' || o_orderpriority FROM {orders}) AS s) AS n
    JOIN {embeddings} AS e ON e.vec_id = n.vec_id"""

VALUE_VECTORS = """SELECT n.value, e.embedding AS v FROM (SELECT lower(o_orderstatus) AS value FROM {orders} UNION SELECT 'x') AS n
    JOIN {embeddings} AS e ON e.vec_id = ascii(n.value) - 97"""

NUMBERS = """SELECT id, v FROM (VALUES (-1, '12.5'), (-2, '12,5'), (-3, '1.234,5'), (-4, '1,234.5'), (-5, '1e3'), (-6, '1_000'), (-7, '1,234'),
        (-8, '1,234,567'), (-9, '12 5'), (-10, '5 kg'), (-11, ''), (-12, '   '), (-13, '1d'), (-14, '1.5D'), (-15, '1__0'), (-16, '0x10'), (-17, '+.5'),
        (-18, '-3,5'), (-19, ' 7 '), (-20, '.'), (-21, '1.2.3'), (-22, '1e'), (-23, NULL)) AS t(id, v)
    UNION ALL SELECT CAST(l_orderkey * 10 + l_linenumber AS INT), CASE l_orderkey % 5
        WHEN 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)
        WHEN 1 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '.', ',')
        WHEN 2 THEN CAST(l_partkey % 9 + 1 AS STRING) || '.' || lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0') || ',' || CAST(l_linenumber AS STRING)
        WHEN 3 THEN CAST(l_partkey AS STRING) || ' kg' ELSE ' ' || CAST(l_linenumber AS STRING) || ' 000 ' END FROM {lineitem}"""

MEASURES = """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS STRING) || ' kg' WHEN 1 THEN CAST(p_size AS STRING) || '.5kg CO2' WHEN 2 THEN '-' || CAST(p_size AS STRING) || 'e2 m'
    WHEN 3 THEN 'about ' || CAST(p_size AS STRING) WHEN 4 THEN ' .5 ' WHEN 5 THEN NULL ELSE CAST(p_size AS STRING) || ' 7' END AS v FROM {part}"""

DOIS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://doi.org/10.1234/ABC.' || CAST(page_id AS STRING) WHEN 1 THEN ' DOI:10.55555/x-' || CAST(page_id AS STRING) || ' '
        WHEN 2 THEN '10.99/short' WHEN 3 THEN '' ELSE NULL END AS doi,
    CASE WHEN page_id % 6 = 5 THEN NULL ELSE 'SS' || CAST(page_id AS STRING) END AS semantic_scholar, url FROM {pages}"""

CITATIONS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'See ' || c_name ELSE c_name || ', A. (' || CAST(2000 + c_custkey % 20 AS STRING) || '). The case of ' || c_mktsegment || '. Journal of '
    || n_name || ', ' || CAST(1 + c_custkey % 40 AS STRING) || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '(' || CAST(1 + c_custkey % 9 AS STRING) || ')' END || ', '
    || CAST(c_custkey AS STRING) || '-' || CAST(c_custkey + 9 AS STRING) || '. doi: 10.1016/j.x.' || CAST(c_custkey AS STRING) || ';' END AS v
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""

PAPERS = """SELECT c_custkey AS doc_id, 'Abstract' || chr(10) || c_name || ' reports on ' || lower(c_mktsegment) || '.' || chr(10) || '1. Introduction' || chr(10) || 'It is known. And we ask why.'
    || chr(10) || '2. Methods' || chr(10) || 'Sites of ' || n_name || '.' || chr(10) || chr(10) || 'System boundary: ' || c_mktsegment || chr(10) || 'RESULTS AND OUTLOOK' || chr(10)
    || 'Yield: ' || CAST(c_custkey % 97 AS STRING) || chr(10) || chr(10) || 'Shared remarks of all papers.' || chr(10) || 'Discussion' || chr(10) || 'shared REMARKS of all papers.' || chr(10) || chr(10)
    || 'Own remarks ' || CAST(c_custkey AS STRING) || '.' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Conclusion' || chr(10) || 'It holds.' || chr(10) || chr(10) || 'Own remarks ' || CAST(c_custkey AS STRING) || '.' || chr(10) END
    || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'References' || chr(10) || 'Doe, J. (2001). A work.' || chr(10) || 'www.example.org/' || CAST(c_custkey AS STRING) || chr(10) END
    || CASE WHEN c_custkey % 5 = 0 THEN 'Short tail' ELSE 'Table A ' || repeat('cell ', 110 + CAST(c_custkey % 7 AS INT)) || 'manuscript accepted accepted manuscript' END AS text
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""

RESULTS = """SELECT o_orderkey AS id, '{{"metadata":{{"pid":"' || CAST(o_custkey AS STRING) || '","exec_time":' || CAST(o_orderkey % 50 AS STRING) || '.5,"pdf_path":"/p/' || CAST(o_orderkey AS STRING) || '.pdf"}},'
    || CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '"tokens":{{"total":' || CAST(100 + o_orderkey % 900 AS STRING) || '}},' END
    || '"results":[{{"concepts":[{{"Scenario":{{"Scenario Name":"' || o_orderpriority || '","scenario_description":null}}}},{{"Price":{{"Total":' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)
    || ',"Status":"' || o_orderstatus || '","Tags":[1,2]}}}},{{"Price":{{"Status":"late ' || o_orderstatus || '"}}}},{{"Note":"free text"}}]}},{{"concepts":[]}},{{"concepts":[{{"Metadata":{{"PID":"own"}}}}]}}]}}' AS doc FROM {orders}"""

CONFIG = """SELECT * FROM (VALUES (0, 'Price', 'What it costs', 'Results', 'TRUE', 'Total', 'float'), (1, 'Price', 'What it costs', 'Results', 'yes', 'Status', 'str | None'),
        (2, ' Site ', 'Where it is', 'Methods', 'FALSE', 'Nation', 'str'), (3, 'DEFAULT: x', 'd', 'Methods', '1', 'F', 'int'), (4, NULL, 'd', 'Other', '1', 'F', 'int'), (5, 'nan', 'd', 'nan', '1', 'F', 'int'),
        (6, 'Price', 'What it costs', 'Results', '1', 'Total', 'int'), (7, 'Price', 'What it costs', 'Results', 'y', '', 'int'), (8, 'Split', 'One', 'Results', '0', 'A', 'int'), (9, 'Split', 'Two', 'Results', '0', 'B', 'int'),
        (10, 'Bare', 'None', 'Methods', 'no', '', 'int'), (11, 'Site', 'Where it is', 'Methods', 'no', 'Area', 'List[float]')) AS t(pos, name, description, aspect, by_scenario, structure_title, structure_data_type)"""

CALLS = """SELECT CAST(o_custkey AS STRING) AS pid, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS scenario,
    CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE CAST(o_orderkey % 300 AS BIGINT) END AS prompt_tokens, CAST(o_orderkey % 41 AS BIGINT) AS completion_tokens FROM {orders}"""


#: Characters that letters() counts.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789.,"


def letters(text: Column) -> Column:
    """A vector that both engines can make: how often each of some characters stands in a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.transform(F.array(*map(F.lit, COUNTED)), lambda c: (F.length(low) - F.length(F.replace(low, c, F.lit("")))).cast("double"))


def duck_letters(text: str) -> str:
    return f"list_transform(string_split('{COUNTED}', ''), lambda c: CAST(length(lower(coalesce({text}, ''))) - length(replace(lower(coalesce({text}, '')), c, '')) AS DOUBLE))"


def duck_cosine(a: str, b: str) -> str:
    """Null where a vector has no length."""
    return f"nullif(list_cosine_similarity({a}, {b}), 'NaN'::DOUBLE)"


def duck_words(text: str) -> str:
    """A text's distinct words without stop words."""
    stop = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words()) + "]"
    return f"list_distinct(list_filter(string_split_regex({text}, '[\\s\\x0b]+'), lambda w: w <> '' AND NOT list_contains({stop}, w)))"


def duck_fuzzy(source: str, a: str = "a", b: str = "b") -> dict[str, str]:
    """CTEs that end in `fuzzy`(a, b, plain, fuzzy) of the distinct pairs of texts of a table, by letters()."""
    words = lambda c: f"len(list_filter(string_split_regex({c}, '[\\s\\x0b]+'), lambda w: w <> ''))"
    return {
        "fz_pairs": f"SELECT DISTINCT {a} AS a, {b} AS b FROM {source}",
        "fz_texts": "SELECT a AS t FROM fz_pairs UNION SELECT b FROM fz_pairs",
        "fz_parts": f"SELECT t, unnest(list_prepend(t, {duck_words('t')})) AS x FROM fz_texts",
        "fz_vectors": f"SELECT x, {duck_letters('x')} AS v FROM (SELECT DISTINCT x FROM fz_parts)",
        "fz_sides": "SELECT DISTINCT t, v FROM fz_parts JOIN fz_vectors USING (x)",
        "fz_best": f"SELECT a, b, max({duck_cosine('i.v', 'j.v')}) AS best FROM fz_pairs JOIN fz_sides i ON i.t = a JOIN fz_sides j ON j.t = b GROUP BY a, b",
        "fz_whole": f"SELECT a, b, {duck_cosine('i.v', 'j.v')} AS plain FROM fz_pairs JOIN fz_vectors i ON i.x = a JOIN fz_vectors j ON j.x = b",
        "fuzzy": f"SELECT a, b, plain, CASE WHEN NOT ({words('a')} = 1 AND {words('b')} = 1) THEN (best + plain) / 2 END AS fuzzy FROM fz_whole JOIN fz_best USING (a, b)",
    }


def tables_in(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


#: Rows of a table that a task derives from; papers' texts are a hundred times as long as the rows they come from.
ROWS, PAPER_ROWS = 1 << 15, 1 << 12


def derived(spark: SparkSession, sf_dir: str, text: str, deal: bool = True) -> DataFrame:
    """A fixture's rows on Spark. Their tables are packed far closer than they are, so they are dealt by rows, not by bytes.

    Not with deal=False, for one whose first steps move the rows by key anyway.
    """
    def read(table: str) -> DataFrame:
        found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if not deal:
            return found
        rows, most = found.count(), PAPER_ROWS if text is PAPERS else ROWS
        return dealt(found, rows, most=most) if rows > most else found

    return spark.sql(text, **{t: read(t) for t in tables_in(text)})


def by_pairs(rows: DataFrame, measure: Callable[[Column, Column], Column]) -> DataFrame:
    """rows (a, b, not null) with measure of both: each distinct pair of texts is measured once and joined back."""
    told = stored(rows.select("a", "b").distinct().select("a", "b", measure(F.col("a"), F.col("b"))), "fixture-pairs")
    return rows.join(told, ["a", "b"])


def duck(text: str) -> str:
    """The same fixture as DuckDB reads it."""
    return text.format(**{t: t for t in tables_in(text)})


def with_ctes(ctes: dict[str, str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({q})" for n, q in ctes.items()) + f" {body}"
