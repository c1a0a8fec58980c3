"""Every query against its SQL, and those without SQL for rows and a stable schema."""

import pytest
from oracle import connected, difference

from gleaner import catalogue

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connected(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, SQL[name]) == ""


@pytest.mark.parametrize("name", ["section_extract", "extraction_plan", "comparison_plan", "title_match"])
def test_queries_without_sql_have_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "field"


def test_extraction_takes_all_papers(spark):
    readable = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").where("c_custkey % 50 <> 49").count()
    assert readable > 1000
    assert QUERIES["extraction_plan"](spark, "/root/testdata/sf0.01").select("pid").distinct().count() == readable
