"""From papers' texts to result documents: sections, scenarios, calls, answers, results and failures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import concepts as C
from gleaner.operators import sections as S
from gleaner.plans import providers
from gleaner.storage import stored


@dataclass
class Extraction:
    results: DataFrame  # pid, metadata, tokens, results
    usage: DataFrame  # pid, scope, prompt_tokens, completion_tokens, total_tokens
    failures: DataFrame  # pid, path, error


def unprocessed(papers: DataFrame, done: DataFrame | None) -> DataFrame:
    """Papers whose pid has no result yet."""
    return papers if done is None else papers.join(done.select("pid").distinct(), "pid", "left_anti")


def section_texts(papers: DataFrame, scope: str = "sections") -> DataFrame:
    """pid, section, section_text that aspects are looked up in.

    scope `full`: none, so every call gets the whole text. `per_section`: each section as it is. `sections`: also the
    results (results, discussion and conclusion without repeated paragraphs) and Methods_Results, methods before them.
    """
    ids = papers.select(F.col("pid").alias("doc_id"), "text")
    if scope == "full":
        return papers.sparkSession.createDataFrame([], "pid string, section string, section_text string")
    found = S.extracted(ids)
    told = lambda rows: rows.where("section_text is not null").select(F.col("doc_id").alias("pid"), "section", "section_text")
    if scope == "per_section":
        return told(found)
    found = stored(found, "extraction-found")  # read by three plans
    plain = told(found)
    results = S.combined(found).select(F.col("doc_id").alias("pid"), F.lit("Results").alias("section"), F.col("text").alias("section_text"))
    methods = plain.where("section = 'Methods'").select("pid", F.col("section_text").alias("m"))
    both = methods.join(results.select("pid", F.col("section_text").alias("r")), "pid", "full").select("pid", F.lit("Methods_Results").alias("section"), F.concat_ws("\n\n", "m", "r").alias("section_text"))
    return plain.where("section <> 'Results'").unionByName(results).unionByName(both).where("section_text <> ''")


def extract(papers: DataFrame, concepts: DataFrame, extractor: providers.Extractor | None = None, done: DataFrame | None = None, scope: str = "sections", model: str = "rules", scenario_mode: str = "loop") -> Extraction:
    """Runs all calls of all papers (pid, path, text, error), those of a paper in its own row.

    scenario_mode `loop` asks each concept by scenario for each of them; `schema` asks it once, its structure nested
    under all scenarios. With scope `full` either one needs no sections.

    A paper that could not be read, has no text or has no scenarios fails; others are not touched by it. What each paper
    was asked is written once to the shared folder, in one row, so that results, usage and failures do not ask the
    extractor again and results move no rows. pid is unique.
    """
    if scenario_mode not in ("loop", "schema"):
        raise ValueError(f"scenario_mode is loop or schema, not {scenario_mode!r}")
    todo, few = unprocessed(papers, done), C.configured(concepts)
    texts = todo.select("pid", "path", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")
    if scope == "full":
        texts = texts.withColumn("of", F.lit(None).cast("map<string, string>"))
    else:
        # a call looks up no section but its concept's aspect
        named = section_texts(todo.where("error is null and text is not null"), scope).where(F.col("section").isin(*{c.aspect for c in few if c.aspect is not None}))
        texts = texts.join(named.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("section", "section_text"))).alias("of")), "pid", "left")
    answered = providers.asked(texts, few, extractor or providers.RuleExtractor(), scenario_mode == "schema")
    # results are put together before they are written: their readers' filters would each do it again
    told = stored(answered.withColumn("results", C.assembled(F.col("scenarios"), F.col("answers"))), "extraction-told")
    served = told.where("error is null")
    usage = C.token_usage(served.select("pid", F.explode("answers").alias("a")).select("pid", "a.*"))
    metadata = F.struct(F.lit(None).cast("double").alias("exec_time"), "pid", F.col("path").alias("pdf_path"), F.lit(model).alias("model"))
    results = served.select("pid", metadata.alias("metadata"), "tokens", "results")
    return Extraction(results, usage, told.where("error is not null").select("pid", "path", "error"))
