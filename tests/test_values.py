"""Truth tables of values and cell measures, written by hand."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import prose, values
from gleaner.operators import concepts, matching, metrics

NUMBERS = [("12.5", 12.5), ("12,5", 12.5), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("1e3", 1000.0), ("1_000", 1000.0), ("1,234", 1.234), ("1,234,567", None), ("12 5", 125.0), ("5 kg", None), ("", None), (None, None), ("1d", None)]
CELLS = [
    (None, " ", (1, 1, 1, 1, None)), ("x", None, (0, 0, 0, 0, None)), ("10", "12", (0.818182, 0.818182, 0, 0, 2)), ("-10", "-12", (1.181818, 1.181818, 0, 0, 2)),
    ("5", "-5", (1, 1, 0, 0, 10)), ("1", "9", (0, 0, 0, 0, 8)), ("12,5", "12.5", (1, 1, 0, 1, 0)), (" Beef ", "beef", (1, 1, 1, None, None)),
]
HEADERS = [("1. Introduction", True), ("10) Methods", True), ("METHODS AND MATERIALS", True), ("Results", True), ("Results and Discussion", True), ("Standard deviation was 3", True), ("11. Foo", False), ("2.1 Sites", False), ("H I G H L I G H T S", False), ("ab", False), ("this is prose", False), (None, False)]


def test_numbers(spark):
    rows = spark.createDataFrame(list(enumerate(n for n, _ in NUMBERS)), "i int, v string").select("i", values.number("v").alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [n for _, n in NUMBERS]


def test_cell_measures(spark):
    rows = spark.createDataFrame([(i, a, m, 0.9) for i, (a, m, _) in enumerate(CELLS)], "i int, auto_val string, manual_val string, score double").withColumn("text_cosine", F.lit(0.5))
    got = metrics.cell_metrics(rows).orderBy("i").collect()
    for r, (_, _, wanted) in zip(got, CELLS, strict=True):
        assert [r[m] for m in metrics.METRICS[:5]] == pytest.approx(list(wanted), abs=1e-6)


def test_cells_of_unmatched_rows_have_no_measures(spark):
    rows = spark.createDataFrame([("1", "1", 0.0), ("1", "1", None)], "auto_val string, manual_val string, score double").withColumn("text_cosine", F.lit(None).cast("double"))
    assert all(r[m] is None for r in metrics.cell_metrics(rows).collect() for m in metrics.METRICS)


def test_headers(spark):
    rows = spark.createDataFrame(list(enumerate(h for h, _ in HEADERS)), "i int, h string").select("i", prose.is_main_header(F.col("h")).alias("y"), prose.is_main_header(F.col("h"), strict=False).alias("z")).orderBy("i").collect()
    assert [r.y for r in rows] == [y for _, y in HEADERS]
    assert not rows[5].z


@pytest.mark.parametrize(("text", "kind"), [("str", "string"), ("Optional[List[float]]", "array<double>"), ("List[str | None]", "array<string>"), ("dict[str, int]", "map<string,bigint>"), ("bool | None", "boolean"), ("Literal:scenarios", "string"), ("dict", "map<string,string>")])
def test_types(text, kind):
    assert concepts.parsed_type(text).simpleString() == kind


@pytest.mark.parametrize("text", ["word", "List[", "List[int]]", "int | str", "None", ""])
def test_what_is_not_a_type_is_an_error(text):
    with pytest.raises(ValueError):
        concepts.parsed_type(text)


def test_structures_are_schemas():
    got = concepts.structure_schema({"Total": "float", "items": [{"Name": "str"}]})
    assert got == T.StructType([T.StructField("Total", T.DoubleType()), T.StructField("items", T.ArrayType(T.StructType([T.StructField("Name", T.StringType())])))])


def test_concepts_whose_rows_disagree_are_an_error(spark):
    rows = spark.createDataFrame([(0, "A", "one", "M", "1", "F", "int"), (1, "A", "two", "M", "1", "G", "int")], "pos int, name string, description string, aspect string, by_scenario string, structure_title string, structure_data_type string")
    with pytest.raises(Exception, match="inconsistent description"):
        concepts.grouped_concepts(rows).collect()


def test_both_ways_of_matching_are_the_greedy_one(spark):
    import random

    rng = random.Random(5)
    pairs = [(f"p{p}", f"a{a}", f"m{m}", a, m, rng.choice([-0.5, 0.1, 0.4, 0.4, 0.9])) for p in range(12) for a in range(rng.randint(1, 6)) for m in range(rng.randint(1, 6))]
    df = spark.createDataFrame(pairs, "pid string, a string, m string, ai long, mi long, sim double")
    wanted, used = set(), set()
    for pid, a, m, _, _, _ in sorted(pairs, key=lambda x: (x[0], -x[5], x[3], x[4])):
        if (pid, a) not in used and (pid, m) not in used:
            used |= {(pid, a), (pid, m)}
            wanted.add((pid, a, m))
    for way in (matching.folded_assignment, matching.round_assignment):
        assert {(r.pid, r.a, r.m) for r in way(df).collect()} == wanted
