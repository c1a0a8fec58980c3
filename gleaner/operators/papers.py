"""Papers: their records, one row per identity, and the closest title among candidates."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.identity import paper_id

# The fields of a paper's record.
RANK = "struct<query: string, text: string, rank: bigint, score: double, pid: string, request_id: string, inserted_at: string>"
TOPIC = f"struct<topic_id: bigint, representation: array<string>, count: bigint, paper_ids: array<string>, ranks: array<{RANK}>>"
IDS = "struct<doi: string, semantic_scholar: string, mag: string, openalex: string, acl: string, arxiv: string, corpus_id: string, dblp: string, pubmed: string, pubmed_central: string>"
PAPER = f"""struct<title: string, pid: string, search_engine: string, journal: string, search_term: string, publication_year: string,
    version: string, metadata_url: string, pdf_url: string, ids: {IDS}, request_id: string, scraped_at: string, inserted_at: string,
    authors: array<string>, abstract: string, publication_date: string, fields_of_study: array<string>, keywords: array<string>,
    reference_count: bigint, citation_count: bigint, url: string, blob_url: string, error: string, pdf_size_mb: double,
    exec_time: double, full_text: string, summary: string, topics: array<{TOPIC}>>"""

# Where a paper may come from, and the ratio that a title has to exceed.
ENGINES = ("Semantic Scholar", "OpenAlex", "Web of Science", "Lens.org", "Manual")
ORIGINS = ("Semantic Scholar", "Sci-Hub", "Manual", "Pre-downloaded")
LEAST_RATIO = 0.6


def parsed(json_text: Column) -> Column:
    """A paper's record; fields that are not known are passed over."""
    return F.from_json(json_text, PAPER)


def as_json(paper: Column) -> Column:
    """A paper's record as JSON; lists that are null are empty ones."""
    lists = {"authors": "array<string>", "fields_of_study": "array<string>", "keywords": "array<string>", "topics": f"array<{TOPIC}>"}
    filled = reduce(lambda p, x: p.withField(x[0], F.coalesce(paper[x[0]], F.array().cast(x[1]))), lists.items(), paper)
    return F.to_json(filled)


def identified(papers: DataFrame) -> DataFrame:
    """Adds pid from doi and semantic_scholar. Papers that have neither have none; rejected() holds them."""
    return papers.withColumn("pid", paper_id(F.col("doi"), F.col("semantic_scholar")))


def of_known_origin(papers: DataFrame) -> DataFrame:
    """Papers whose engine, if they name one, is one of ENGINES."""
    return papers.where(F.col("search_engine").isNull() | F.col("search_engine").isin(*ENGINES))


def rejected(papers: DataFrame) -> DataFrame:
    return identified(papers).where("pid is null").withColumn("error", F.lit("neither a DOI nor another identifier"))


def deduplicated(papers: DataFrame, order: list[str]) -> DataFrame:
    """One row per pid, the first by the given columns; the choice does not depend on partitions.

    Rows are cut to one per pid within each task before they move, so a pid with very many rows is no burden.
    """
    first = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    return papers.withColumn("_n", first).where("_n <= 1").drop("_n")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The share of characters in matching blocks of two texts, without case, as difflib has it."""
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def _ratio_bound(a: str, b: str) -> float:
    """What the ratio of two texts is at most: the share of letters that both have, in whatever order."""
    return 2.0 * sum(min(a.count(c), b.count(c)) for c in set(a)) / (len(a) + len(b)) if a or b else 1.0


def _contending(ids: Iterable, left: Iterable[str | None], right: Iterable[str | None], least: float) -> list[float | None]:
    """sequence_ratio of pairs that can be over `least` and the best of their id; null for others.

    Pairs go by falling bound, so that most of an id's pairs need no ratio. One that is as good as the best has its ratio.
    """
    rows = list(zip(ids, left, right, strict=True))
    bounded = [(i, x, a.lower(), b.lower()) for i, (x, a, b) in enumerate(rows) if a is not None and b is not None]
    bounded = sorted(((_ratio_bound(a, b), i, x, a, b) for i, x, a, b in bounded), key=lambda p: -p[0])
    out: list[float | None] = [None] * len(rows)
    best: dict = {}
    for bound, i, x, a, b in bounded:
        if bound > least and bound >= best.get(x, least):
            out[i] = difflib.SequenceMatcher(None, a, b).ratio()
            best[x] = max(out[i], best.get(x, least))
    return out


def contending_ratio(least: float) -> Callable[[Column, Column, Column], Column]:
    """A function of id, left and right: sequence_ratio where the pair can be over `least` and the best of its id, else null.

    Only pairs that come in one batch are held against each other, so an id may have more ratios than its best one.
    """

    @F.pandas_udf(T.DoubleType())
    def ratio(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, left, right in rows:
            yield pd.Series(_contending(ids, left, right, least), dtype="float64")

    return ratio


def best_titles(references: DataFrame, candidates: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """ref_id, title, cand_pos, cand_title, ratio: of each reference's own candidates the closest title, if close enough.

    references: ref_id, title; candidates: ref_id, cand_pos, cand_title. Ties go to the lesser place. A reference's
    candidates come together from the join, which sorts them, and those that cannot be its closest are told without
    matching. Rows are matched where the join puts them, not in the few tasks that a small file is read by.
    """
    met = references.hint("merge").join(candidates, "ref_id")
    scored = met.withColumn("ratio", contending_ratio(least)(F.col("ref_id"), F.col("title"), F.col("cand_title"))).where(F.col("ratio") > least)
    best = scored.groupBy("ref_id").agg(F.max_by(F.struct("title", "cand_pos", "cand_title", "ratio"), F.struct("ratio", -F.col("cand_pos"))).alias("b"))
    return best.select("ref_id", "b.*")
