"""Identities of papers and requests: DOIs, digests, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.values import stripped

# Forms of a DOI and of a citation, and the stand-in for a missing DOI.
DOI = r"(?i)10.\d{4,9}/[-._;()/:A-Z0-9]+"
DOI_PREFIX = r"^(https://doi\.org/|doi:)"
NO_DOI = "NULL_DOI_"
CITATION = r"^(.+?)\s+\((\d{4})\)\.\s+(.+?)\.\s+(.+?),\s+(\d+)(?:\((\d+)\))?,\s+(\d+-\d+)\."
CITATION_FIELDS = ("authors", "year", "title", "journal", "volume", "issue", "pages")


def doi_normalised(c: Column) -> Column:
    """Lower case, without white space at the ends and without one leading resolver address or `doi:`."""
    return stripped(F.regexp_replace(F.lower(stripped(c)), DOI_PREFIX, ""))


def paper_id(doi: Column, semantic_scholar: Column) -> Column:
    """SHA-256 of the normalised DOI, or of a stand-in made from the other identifier; null where both are missing."""
    stand_in = F.concat(F.lit(NO_DOI), F.nullif(semantic_scholar, F.lit("")))
    return F.sha2(doi_normalised(F.coalesce(F.nullif(doi, F.lit("")), stand_in)), 256)


def request_id(engine: Column, term: Column, timestamp: Column) -> Column:
    return F.sha2(F.concat(engine, F.coalesce(term, F.lit("")), timestamp), 256)


def doi_found(c: Column) -> Column:
    """The first DOI within a text, as it is written there, or null."""
    return F.nullif(F.regexp_extract(c, DOI, 0), F.lit(""))


def citation(c: Column) -> Column:
    """A struct of the parts of `authors (year). title. journal, volume(issue), from-to.`, or null for another form."""
    part = lambda i: F.nullif(F.regexp_extract(c, CITATION, i), F.lit(""))
    return F.when(c.rlike(CITATION), F.struct(*[part(i).alias(n) for i, n in enumerate(CITATION_FIELDS, 1)]))
