"""Sections of papers: the header that fits each section best, what stands under it, and texts made of sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.prose import PARAGRAPH_KEY, RESULT_SECTIONS, SECTIONS, TAILED_SECTIONS, after_references, clean_title, potential_headers, section_between
from gleaner.functions.values import stripped
from gleaner.functions.vectors import cosine, fuzzy_cosine, hashed_embedding, let
from gleaner.storage import stored

LEAST_SIMILARITY = 0.5


def headers(documents: DataFrame, sections: tuple[str, ...] = SECTIONS, scorer: Callable[[Column, Column], Column] | None = None, strict: bool = True, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """doc_id, section_pos, section, section_title, cosine_similarity, fuzzy_cosine_similarity: each section's best header.

    documents: doc_id, text. The best header has the highest score, the first one of equals; a text without headers has
    no rows. Papers share most of their headers, so distinct lines are scored once, however many papers there are; the
    fuzzy cosine is taken for best headers whose cosine is low. Without a scorer the cosine of `embed`'s vectors scores.
    """
    similarity = lambda a, b: F.coalesce(cosine(embed(a), embed(b)), F.lit(0.0))
    scorer = scorer or similarity
    lines = documents.select("doc_id", F.posexplode(potential_headers(F.coalesce("text", F.lit("")), strict)).alias("pos", "header"))
    kinds = lines.select("header").distinct().select("header", F.posexplode(F.array(*map(F.lit, sections))).alias("section_pos", "section"))
    plain = similarity(clean_title(F.col("section")), clean_title(F.col("header")))
    scored = stored(kinds.select("*", scorer(F.col("section"), F.col("header")).alias("score"), plain.alias("cosine_similarity")), "sections-scored")
    top = F.max_by(F.struct(F.col("header").alias("section_title"), "cosine_similarity"), F.struct("score", -F.col("pos")))
    best = lines.join(scored, "header").groupBy("doc_id", "section_pos", "section").agg(top.alias("b")).select("doc_id", "section_pos", "section", "b.*")
    best = stored(best, "sections-best")
    low = best.where(F.col("cosine_similarity") < LEAST_SIMILARITY).select("section", "section_title").distinct()
    low = low.withColumn("fuzzy", fuzzy_cosine(clean_title(F.col("section")), clean_title(F.col("section_title")), embed))
    found = best.join(stored(low, "sections-fuzzy"), ["section", "section_title"], "left")
    return found.select("doc_id", "section_pos", "section", "section_title", "cosine_similarity", F.coalesce(F.nullif(F.col("fuzzy"), F.lit(0.0)), "cosine_similarity").alias("fuzzy_cosine_similarity"))


def extracted(documents: DataFrame, sections: tuple[str, ...] = SECTIONS, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """doc_id, section_pos, section, section_title, cosine_similarity, fuzzy_cosine_similarity, section_text.

    A section is accepted if its header is similar enough; its text ends where the title of the next accepted section
    (in the order of the given sections) comes. What follows the references is added to methods and results.
    """
    found = headers(documents, sections, embed=embed)
    fits = (F.col("cosine_similarity") >= LEAST_SIMILARITY) | (F.col("fuzzy_cosine_similarity") >= LEAST_SIMILARITY)
    one = F.struct("section_pos", "section", "section_title", "cosine_similarity", "fuzzy_cosine_similarity", fits.alias("fits"))
    # a text meets its few headers in one row: it moves once, is not sorted, and is cut where it stands
    of = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("found")).hint("shuffle_hash")
    titles = F.array_distinct(F.transform(F.filter("found", lambda x: F.coalesce(x["fits"], F.lit(False))), lambda x: x["section_title"]))
    rows = documents.select("doc_id", "text").join(of, "doc_id").withColumn("titles", titles)

    def cut(x: Column, low: Column, tail: Column) -> Column:
        following = F.try_element_at("titles", (F.array_position("titles", x["section_title"]) + 1).cast("int"))
        own = F.when(x["fits"], section_between(F.col("text"), x["section_title"], following, low))
        tailed = lambda t: F.when(x["section"].isin(*TAILED_SECTIONS) & (t != "") & (tail != ""), F.concat(t, F.lit("\n\n"), tail)).otherwise(t)
        return F.struct(*[x[c].alias(c) for c in ("section_pos", "section", "section_title", "cosine_similarity", "fuzzy_cosine_similarity")], let(own, tailed).alias("section_text"))

    each = let(F.lower("text"), lambda low: let(after_references(F.col("text")), lambda tail: F.transform("found", lambda x: cut(x, low, tail))))
    return rows.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")


def combined(sections: DataFrame, wanted: tuple[str, ...] = RESULT_SECTIONS) -> DataFrame:
    """doc_id, text: the wanted sections' paragraphs in order, each but once.

    sections: doc_id, section, section_text. Paragraphs are the same if their first PARAGRAPH_KEY characters are,
    without case; the first one stays. Two aggregations, whose partial results are made before rows move.
    """
    order = F.array_position(F.array(*map(F.lit, wanted)), F.col("section"))
    parts = sections.where(F.col("section").isin(*wanted)).select("doc_id", order.alias("s"), F.posexplode(F.split("section_text", "\n\n")).alias("p", "raw"))
    kept = parts.select("doc_id", F.struct("s", "p").alias("at"), stripped("raw").alias("paragraph")).where("paragraph <> ''")
    once = kept.groupBy("doc_id", stripped(F.lower(F.substring("paragraph", 1, PARAGRAPH_KEY))).alias("key")).agg(F.min("at").alias("at"), F.min_by("paragraph", "at").alias("paragraph"))
    return once.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "paragraph"))), lambda x: x["paragraph"]), "\n\n").alias("text"))
