"""What the second round's findings were about: each of these failed before."""

import re

import duckdb
from pyspark.sql import functions as F

from gleaner.functions import prose, values
from gleaner.operators import sections, topics
from gleaner.queries import _fixtures as fx
from gleaner.queries import searching


def test_a_header_s_second_word_ends_before_any_letter_outside_ascii(spark):
    lines = ["He and Erachü chöü verenver", "He and Erach", "one & twoé", "Sand andſ", "Kand b", "He andü", "hé and you"]
    found = spark.createDataFrame([(1, "\n".join(lines))], "id int, text string").select(prose.potential_headers(F.col("text")).alias("h")).first()["h"]
    duck = [x for x in lines if duckdb.execute(r"SELECT regexp_matches(?, '(?i)^([A-Za-z]+)\s*(?:and|&)\s*([A-Za-z]+)\b')", [x]).fetchone()[0]]
    assert found == duck and lines[0] in found and "He andü" not in found


def test_stripping_takes_white_space_of_any_script_and_no_pattern(spark):
    white = "".join(c for c in map(chr, range(0x3100)) if re.match(r"[\s\x1c-\x1f]", c))
    odd = [white + "a" + white + "b" + white, white, "", "᠎a​", "a\n\n", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id int, x string").select("id", values.stripped("x").alias("y"))
    assert [r["y"] for r in rows.orderBy("id").collect()] == ["a" + white + "b", "", "", "᠎a​", "a", None]
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_papers_are_dealt_by_rows(spark, monkeypatch, tmp_path):
    for t in ("customer", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    monkeypatch.setattr(fx, "PAPER_ROWS", 10)
    papers = fx.derived(spark, str(tmp_path), fx.PAPERS)
    assert papers.rdd.getNumPartitions() >= papers.count() // 10


def test_texts_meet_their_headers_without_being_sorted(spark):
    docs = spark.createDataFrame([(i, "Methods\nWe did.\nResults\nIt is.\nReferences\nDoe, J. 2001\n" + "tail " * 200) for i in range(20)], "doc_id int, text string")
    found = sections.extracted(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert plan.count("references|bibliography") <= 2  # once in the initial plan, once more where it is planned anew
    text = {(r["doc_id"], r["section"]): r["section_text"] for r in found.collect()}
    assert text[0, "Methods"].startswith("We did.\n\ntail")
    assert text[0, "Results"].startswith("It is.\nReferences") and text[0, "Results"].endswith("tail tail")


def test_a_distinct_pair_of_texts_is_measured_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def measure(a, b):
        seen.add(1)
        return len(a + b)

    rows = spark.createDataFrame([(i, f"a{i % 3}", "") for i in range(300)], "id int, a string, b string")
    assert fx.by_pairs(rows, lambda a, b: measure(a, b).alias("m")).groupBy("m").count().collect() == [(2, 300)]
    assert seen.value == 3


def test_only_vectors_that_a_remainder_names_are_broadcast(spark):
    vectors = spark.range(-2000, 2000).withColumnRenamed("id", "vec_id")
    assert searching._of_remainder(vectors).count() == 999


def test_topics_by_vectors_do_not_join_texts_with_their_topics(spark):
    docs = spark.createDataFrame([(i, f"apple pear {'red' if i % 2 else 'blue'}", [float(i % 2), 1.0]) for i in range(40)], "doc_id int, text string, vector array<double>")
    found, labelled = topics.topics_by_vectors(docs, topics=2)
    assert sorted(r["count"] for r in found.collect()) == [20, 20] and labelled.count() == 40
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_topics_by_terms_know_terms_of_enough_documents(spark):
    docs = spark.createDataFrame([(i, ("apple pear " if i % 2 else "stone iron ") + f"only{i}") for i in range(40)], "doc_id int, text string")
    found, labelled = topics.topics_by_terms(docs, topics=2)
    assert sorted(tuple(sorted(r["representation"][:3])) for r in found.collect()) == [("apple", "apple pear", "pear"), ("iron", "stone", "stone iron")]
    assert labelled.count() == 40
