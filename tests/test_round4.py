"""What the second round's last findings were about: each of these failed before, or holds a rewritten step to plain loops."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions.vectors import stop_words
from gleaner.operators import flatten, topics
from gleaner.plans import extraction, providers
from gleaner.queries import reading

_CONFIG = "pos long, name string, description string, aspect string, by_scenario boolean, structure array<struct<field: string, type: string>>"


@pytest.mark.parametrize("mode", ["loop", "schema"])
def test_a_paper_is_asked_in_its_own_row(spark, monkeypatch, mode):
    class Odd(providers.RuleExtractor):
        def extract(self, call):
            if "Broken" in call.text and call.concept == "Out":
                raise ValueError(call.description)
            return super().extract(call)

        def scenarios(self, text):
            if "Blank" in text:
                raise ValueError("none")
            return [("a", None), ("b", "second"), ("a", None)] if "Twice" in text else super().scenarios(text)

    texts = {"one": "Site: x\nYield: 5", "two": "Scenario: low\nScenario: high\nSite: y\nYield: 6", "again": "Twice\nSite: z\nYield: 7", "bad": "Broken\nSite: w", "blank": "Blank", "none": None, "gone": "Yield: 1"}
    papers = spark.createDataFrame([(p, f"/{p}", t, "unreadable" if p == "gone" else None) for p, t in texts.items()], "pid string, path string, text string, error string")
    config = spark.createDataFrame([(1, "Out", "What", None, True, [("Yield", "float")]), (0, "Where", "Place", "Methods", False, [("Site", "str")])], _CONFIG)
    monkeypatch.setattr(providers.asked, "__defaults__", (False, 1))
    found = extraction.extract(papers, config, Odd(), scope="full", scenario_mode=mode)
    plan = found.results._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "InPandas" not in plan
    rows = flatten.flattened(found.results).select("pid", "scenario_idx", "field", "value").collect()
    told = {}
    for r in rows:
        told.setdefault((r["pid"], r["scenario_idx"]), {})[r["field"]] = r["value"]
    assert told["one", 0] == {"WHERE_SITE": "x", "SCENARIO_SCENARIO NAME": "main", "OUT_YIELD": "5"}
    assert told["two", 1] == {"WHERE_SITE": "y", "SCENARIO_SCENARIO NAME": "high", "OUT_YIELD": "6"}
    assert told["bad", 0] == {"WHERE_SITE": "w", "SCENARIO_SCENARIO NAME": "main", "OUT_YIELD": None}
    assert ("OUT_YIELD" in told["again", 2]) == (mode == "loop") and told["again", 1]["SCENARIO_SCENARIO_DESCRIPTION"] == "second"
    assert {p for p, _ in told} == {"one", "two", "again", "bad"}
    assert {(r["pid"], r["error"]) for r in found.failures.collect()} == {("blank", "no scenarios found"), ("none", "no text"), ("gone", "unreadable")}
    usage = {(r["pid"], r["scope"]): r["total_tokens"] for r in found.usage.collect()}
    words = {"one": 4, "two": 8, "again": 5}
    assert usage["one", "main"] == words["one"] + 1 and usage["two", "total"] == 3 * (words["two"] + 1) and usage["bad", "main"] == 0
    assert usage["two", "low"] == (words["two"] + 1) * (1 if mode == "loop" else 2) and usage["again", "total"] == (words["again"] + 1) * (4 if mode == "loop" else 3)
    tokens = {r["pid"]: r["tokens"] for r in found.results.select("pid", F.col("tokens")).collect()}
    assert tokens["two"]["total"] == str(usage["two", "total"]) and tokens["one"]["main"] == '{"prompt_tokens":4,"completion_tokens":1,"total_tokens":5}'


def test_a_call_s_text_is_the_section_that_its_aspect_names(spark):
    body = "Site: whole\n1. Introduction\nIt is known.\n2. Methods\nSite: inside\n3. Results\nSite: after"
    papers = spark.createDataFrame([("p", "/p", body, None)], "pid string, path string, text string, error string")
    config = spark.createDataFrame([(i, f"C{i}", "d", aspect, False, [("Site", "str")]) for i, aspect in enumerate(["Methods", "Results", "Absent", None])], _CONFIG)
    found = flatten.flattened(extraction.extract(papers, config, scope="per_section").results)
    assert {r["field"]: r["value"] for r in found.collect() if r["field"].endswith("SITE")} == {"C0_SITE": "inside", "C1_SITE": "after", "C2_SITE": "whole", "C3_SITE": "whole"}


def _plain_terms(documents):
    """How many documents have each term, and how often it occurs, by plain loops over lists of words."""
    has, occurs = Counter(), Counter()
    for words in documents:
        found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        has.update(set(found))
        occurs.update(found)
    return {t: (has[t], occurs[t]) for t in occurs}


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_terms_are_counted_within_runs_of_documents(monkeypatch, most):
    monkeypatch.setattr(topics, "WORDS_AT_ONCE", most)
    some = random.Random(1)
    documents = [[2 * some.choice("abcdefgé") for _ in range(some.choice([0, 1, 2, 5, 30]))] for _ in range(200)]
    column = pa.array([[], *documents, []], pa.list_(pa.string()))
    has, occurs = Counter(), Counter()
    for batch in topics._count_terms(iter([pa.RecordBatch.from_arrays([column.slice(a, n)], names=["words"]) for a, n in ((0, 50), (50, 0), (50, 152))])):
        for term, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            has[term] += n
            occurs[term] += m
    assert {t: (has[t], occurs[t]) for t in occurs} == _plain_terms(documents)


def test_documents_are_dealt_before_their_terms_are_counted(spark, monkeypatch):
    monkeypatch.setattr(topics, "DOCUMENTS", 10)
    some = random.Random(2)
    texts = [None, "", "the", *(" ".join(some.choice(["Apple", "pear", "the", "Öl", "x", "n_1", "fig,"]) for _ in range(some.randrange(12))) for _ in range(97))]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = topics.term_weights(documents)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc_id#\d+L?, 10\)", plan)  # one task read all of a row group
    counted = _plain_terms([[w for w in re.findall(r"\w{2,}", (t or "").lower()) if w not in stop_words()] for t in texts])
    kept = {t: (n, m, round(math.log(101 / (1 + n)) + 1, 9)) for t, (n, m) in counted.items() if 5 <= n <= 80}
    assert {r["term"]: (r["documents"], r["occurrences"], round(r["idf"], 9)) for r in found.collect()} == kept and len(kept) > 10


def test_a_text_is_lowered_once_for_all_its_sections(spark):
    texts = ["RESULTS AND OUTLOOK\nA.\nDiscussion\nB.\nConclusion\nC.\nReferences\nD.", "no sections", None]
    found = reading._split_sections(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(text#") == 1
    told = {(r["doc_id"], r["section"]): r["section_text"] for r in found.collect()}
    assert [told[0, s] for s in ("Results", "Discussion", "Conclusion")] == ["A.", "B.", "C."] and {told[i, s] for i, s in told if i} == {None}
