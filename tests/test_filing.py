"""Readers, sinks and providers that need no table: PDF pages, workbooks, encodings, groups of extractors."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gleaner.functions import encoding
from gleaner.operators import concepts, papers, ranking, topics
from gleaner.plans import comparison, extraction, providers, topic_ranking
from gleaner.sources import pdf, readers, workbooks, writers


def _pdf(*pages: bytes, packed: bool = True) -> bytes:
    """A PDF with a content stream per page."""
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)]
    for i, text in enumerate(pages):
        data = zlib.compress(text) if packed else text
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i))
        bodies.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if packed else b"", data))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, b) for i, b in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_pages():
    first = rb"BT /F1 12 Tf 72 720 Td (1. Introduction) Tj 0 -14 Td [(It \(is\) kno) 20 (wn) -300 (that)] TJ T* <C3A9> Tj ET"
    got = pdf.pages(_pdf(first, b"BT (Next \\050page\\051) Tj ET"))
    assert got == ["1. Introduction\nIt (is) known that\nÃ©\n", "Next (page)\n"]
    assert pdf.pages(_pdf(b"BT (plain) Tj ET", b"", packed=False)) == ["plain\n", ""]
    for broken in (b"", b"no pdf", b"%PDF-1.4 without pages"):
        with pytest.raises(ValueError):
            pdf.pages(broken)


def test_pdf_papers_and_those_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "good.PDF").write_bytes(_pdf(b"BT (A) Tj ET", b"BT (B) Tj ET"))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_text("not asked for")
    got = {r.pid: (r.text, r.error) for r in readers.pdf_papers(spark, [str(tmp_path)]).collect()}
    assert got == {"good": ("A\nB\n", None), "bad": (None, "ValueError: not a PDF")}
    tables = readers.paper_tables(readers.paper_files(spark, [str(tmp_path)]).where("pid = 'good'"), lambda content: [(1, [["a", "b"], ["c", None]])])
    assert [tuple(r) for r in tables.orderBy("row_no").collect()] == [("good", 1, 0, 0, ["a", "b"]), ("good", 1, 0, 1, ["c", None])]


def test_workbooks_keep_values(spark, tmp_path):
    table = spark.createDataFrame([("a\x01b", 1, 2.5, True), (None, None, float("nan"), None), ("<&>", 10**12, -1e-9, False)], "t string, n long, x double, b boolean")
    path = str(tmp_path / "book.xlsx")
    assert workbooks.write_workbook(path, {"One": table, "Field Stats": table.limit(0)}, writers.OPTIONAL_SHEETS) == ["One"]
    assert workbooks.sheet_names((tmp_path / "book.xlsx").read_bytes()) == ["One"]
    rows = [r.cells for r in workbooks.workbook_rows(spark, path).orderBy("idx").collect()]
    assert rows == [["t", "n", "x", "b"], ["a b", "1", "2.5", "True"], [None, None, "nan", None], ["<&>", "1000000000000", "-1e-09", "False"]]
    with pytest.raises(Exception, match="no sheet"):
        workbooks.workbook_rows(spark, path, "Two").collect()
    with pytest.raises(ValueError):
        workbooks.workbook({"a/b": (["x"], [])})


def test_sheets_of_other_programs():
    """Shared strings, cells that are left out, rows without numbers."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="t" Target="/xl/worksheets/x.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        z.writestr("xl/worksheets/x.xml", f'<worksheet {main}><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c><c r="AB3"><f>1+1</f><v>2</v></c></row><row><c t="s"><v>0</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>')
    rows = dict(workbooks.sheet_rows(body.getvalue(), "S"))
    assert rows[2][1] == "two" and rows[2][27] == "2" and len(rows[2]) == 28 and rows[3] == ["one", "True"]


def test_texts_are_cut_by_tokens_of_an_encoding(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(0, "one two three four"), (1, "naïve 🙂 text, again"), (2, ""), (3, None), (4, "word " * 50_000)], "i int, t string")
    got = {r.i: r for r in rows.select("i", "t", encoding.encoded_count(F.col("t"), path).alias("n"), encoding.first_encoded(F.col("t"), path, 3).alias("cut"), encoding.first_encoded(F.col("t"), path).alias("whole")).collect()}
    assert got[2].n == 0 and got[2].cut == "" and got[3].n is None and got[3].cut is None
    assert got[4].n > 32_766 and len(got[4].whole) < len(got[4].t) and got[0].whole == got[0].t
    again = rows.sparkSession.createDataFrame([(i, got[i].cut) for i in (0, 1)], "i int, t string")
    for r in again.select("i", "t", encoding.encoded_count(F.col("t"), path).alias("n")).collect():
        assert r.n <= 3 and got[r.i].t.startswith(r.t)


class _Broken:
    def extract(self, call):
        raise RuntimeError("down")

    def scenarios(self, text):
        raise RuntimeError("down")


def test_groups_of_extractors_and_retries():
    call = providers.Call("Yield: 5", "c", "d", ["Yield"], None)
    group = providers.Fallback(_Broken(), providers.RuleExtractor())
    assert group.extract(call).values == {"Yield": "5"} and group.scenarios("Scenario: a") == [("a", None)]
    with pytest.raises(RuntimeError):
        providers.Fallback(_Broken()).extract(call)
    waits = []
    with pytest.raises(RuntimeError):
        providers.with_retries(lambda: _Broken().extract(call), providers.SLOW_ATTEMPTS, waits.append, providers.slow_delay)
    assert len(waits) == 7 and all(5 * 2**i <= w <= 7.5 * 2**i for i, w in enumerate(waits))


def test_failed_calls_at_once_have_null_fields(spark):
    papers_ = spark.createDataFrame([("p", "/p", "Scenario: a\nScenario: b\nYield: 5", None)], "pid string, path string, text string, error string")
    config = spark.createDataFrame([(0, "Out", "d", "Results", True, [("Yield", "float")])], "pos long, name string, description string, aspect string, by_scenario boolean, structure array<struct<field: string, type: string>>")

    class Half(providers.RuleExtractor):
        def extract(self, call):
            raise ValueError("no")

    found = extraction.extract(papers_, config, providers.Fallback(Half(), scenarios_by=providers.RuleExtractor()), scope="full", scenario_mode="schema")
    assert {tuple(r) for r in found.usage.select("scope", "total_tokens").collect()} == {("a", 0), ("b", 0), ("total", 0)}
    with pytest.raises(ValueError):
        extraction.extract(papers_, config, scenario_mode="other")


def test_aspects_without_concepts_are_an_error(spark):
    found = spark.createDataFrame([(0, "A", "Methods")], "pos long, name string, aspect string")
    with pytest.raises(ValueError, match="Results"):
        concepts.assigned_to_aspects(found, spark.createDataFrame([("Methods",), ("Results",)], "name string"))


def test_reports_as_workbook_and_as_folders(spark, tmp_path):
    auto = spark.createDataFrame([("p", 0, "base", "1"), ("p", 1, "high", "x")], "pid string, idx long, scenario string, yield string")
    found = comparison.compare(auto, auto.withColumn("unit", F.lit("kg")))
    none = spark.createDataFrame([], "statistic string, value double")
    assert comparison.report(str(tmp_path / "r.xlsx"), found, none) == ["Joined Data", "Statistics", "Summary Statistics", "Field Stats"]
    assert comparison.report(str(tmp_path / "r"), found, none) == ["Joined Data", "Statistics", "Summary Statistics", "Field Stats"]
    assert found.manual_only == ["unit"]
    assert workbooks.sheet_names((tmp_path / "r.xlsx").read_bytes())[0] == "Joined Data"


def test_step_timings(spark, tmp_path):
    for step in ("one", "two"):
        with writers.timed(spark, str(tmp_path / "t"), "run", step):
            pass
    rows = spark.read.csv(str(tmp_path / "t"), header=True).collect()
    assert {r.step for r in rows} == {"one", "two"} and all(float(r.seconds) >= 0 for r in rows)


def test_ranking_in_blocks_is_the_same(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    docs = [(i, vector()) for i in range(300)] + [(300, None), (301, [1.0]), (302, [float("nan")] * 4)]
    asked = [(i, vector()) for i in range(40)] + [(41, None)]
    d = spark.createDataFrame(docs, "doc_pos long, vector array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    want = set()
    for i, v in asked[:-1]:
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), p) for p, w in docs[:300]))
        want |= {(i, p, n) for n, (_, p) in enumerate(scores[:7], 1)}
    for most in (ranking.MOST_NUMBERS, 20):
        monkeypatch.setattr(ranking, "MOST_NUMBERS", most)
        assert {(r.query_id, r.doc_pos, r["rank"]) for r in ranking.nearest_by_vector(q, d, 7).collect()} == want


def test_best_titles_against_difflib(spark):
    import difflib
    import random

    rng = random.Random(6)
    title = lambda: " ".join(rng.choice(["life", "cycle", "of", "milk", "Beef", "assessment", "a", "study"]) for _ in range(rng.randint(1, 6)))
    refs = [(i, title()) for i in range(30)] + [(99, None)]
    cands = [(i % 30, i, title().upper()) for i in range(150)] + [(3, 500, None)]
    got = papers.best_titles(spark.createDataFrame(refs, "ref_id int, title string"), spark.createDataFrame(cands, "ref_id int, cand_pos int, cand_title string"))
    want = {}
    for ref, t in refs[:-1]:
        best = None
        for r, pos, c in cands:
            if r == ref and c is not None:
                ratio = difflib.SequenceMatcher(None, t.lower(), c.lower()).ratio()
                if ratio > 0.6 and (best is None or ratio > best[0]):
                    best = (ratio, pos)
        if best:
            want[ref] = best[1]
    assert {r.ref_id: r.cand_pos for r in got.collect()} == want


def test_topics_part_documents_that_share_no_words(spark, tmp_path):
    kinds = ["milk cow dairy barn", "steel iron furnace coke", "solar panel silicon wafer"]
    rows = [(i, " ".join([kinds[i % 3]] * 3) + f" n{i}.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, labelled = topics.topics_by_terms(docs, topics=3)
    assert sorted(r["count"] for r in found.collect()) == [20, 20, 20]
    assert len({(r.topic_id, r.doc_id % 3) for r in labelled.collect()}) == 3
    ranked = topic_ranking.ranked_topics(docs, top=2, save_to=str(tmp_path / "topics"))
    assert all(len(r.ranks) == 2 for r in ranked.where("ranks is not null").collect())
    assert spark.read.json(str(tmp_path / "topics")).count() == ranked.count()
