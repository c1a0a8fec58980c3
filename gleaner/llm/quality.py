"""Quality by hierarchical empirical Bayes: a document's own evidence, its host's and its path's record.

The classifier's probability is evidence about one text. Hosts and paths are summed over all documents (grouped
aggregation with map-side sums, so a host with a third of all rows is no burden). What a site says about a document is
the record of its other documents: the document's own evidence is taken out of the sums, so none counts twice and a
site with one document says nothing. Each rate of good documents is shrunk towards its parent's: the path's towards the
host's, the host's towards the global one, by a strength that the spread between sites gives (method of moments). A
document's posterior log-odds are its own plus its path's distance from the global prior, which is limited so that a site
cannot condemn a clearly clean text.

Host and path are columns of the table. The tables at hand name no pages, so a document's source stands for its host
and its language for its path; a table with URLs gives better ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm._classify import MOST_LABELLED, Model, classified, train
from gleaner.llm._io import written

THRESHOLD = 0.5
#: Log-odds that a site's record can add or take.
SITE_LIMIT = 1.5
#: Sites that a broadcast may hold; more are joined by salted keys.
MOST_SITES = 100_000
_SALT = 32


def quality_model(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    return train(docs, labels, F.col("quality"), 2, most)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(sites: DataFrame, mean: float) -> float:
    """Prior observations that the spread of site means is worth: large when sites are alike."""
    r = sites.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("v"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not r.n or r.k < 2:
        return 100.0
    noise = max(mean * (1 - mean), 1e-4)
    between = max((r.v - (r.k - 1) * noise) / r.n, noise / 1000)
    return max(2.0, noise / between)


@dataclass
class Prior:
    """The global rate, and the observations that it is worth to a host, and that a host's rate is worth to a path."""

    mean: float
    host: float
    path: float


def site_sums(scores: DataFrame) -> tuple[DataFrame, Prior]:
    """scores: host, path, p_doc. Returns (host, path, s, n, host_s, host_n): sums of p_doc and rows, and the prior."""
    paths = scores.groupBy("host", "path").agg(F.sum("p_doc").alias("s"), F.count("*").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = total.s / total.n if total.n else 0.5
    prior = Prior(mean, _strength(hosts, mean), _strength(paths, mean))
    return paths.join(hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n")), "host").select("host", "path", "s", "n", "host_s", "host_n"), prior


def _with_sites(rows: DataFrame, sites: DataFrame, prior: Prior) -> DataFrame:
    """rows with host, path, p_doc: adds p_site, the shrunk rate of its path's other documents, and the posterior p_quality."""
    if sites.count() <= MOST_SITES:
        met = rows.join(F.broadcast(sites), ["host", "path"], "left")
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(_SALT)).cast("int"))
        met = salted.join(sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1)))), ["host", "path", "_salt"], "left").drop("_salt")
    p = F.col("p_doc")
    of_host = (F.col("host_s") - p + prior.host * prior.mean) / (F.col("host_n") - 1 + prior.host)
    of_path = (F.col("s") - p + prior.path * of_host) / (F.col("n") - 1 + prior.path)
    met = met.withColumn("p_site", F.greatest(F.lit(0.0), F.least(F.lit(1.0), of_path)))
    even = F.lit(math.log(max(prior.mean, 1e-6) / max(1 - prior.mean, 1e-6)))
    shift = F.greatest(F.lit(-SITE_LIMIT), F.least(F.lit(SITE_LIMIT), _logit(F.coalesce("p_site", F.lit(prior.mean))) - even))
    return met.withColumn("p_quality", 1 / (1 + F.exp(-(_logit(p) + shift)))).drop("s", "n", "host_s", "host_n")


def _scored(docs: DataFrame, model: Model | None, host: str, path: str, columns: list[str]) -> DataFrame:
    rows = classified(docs, model, 2, columns)
    name = lambda c: F.coalesce(F.col(f"row.`{c}`").cast("string"), F.lit(""))
    return rows.select("row", name(host).alias("host"), name(path).alias("path"), F.col("p")[1].alias("p_doc"))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, p_doc, p_site, p_quality, kept of every row of docs (doc_id, text, host and path columns).

    labels: doc_id, quality (0 or 1). A null host or path is a site of its own; a null text is judged as an empty one.
    Without any labelled text every probability is even and every document is kept, as is one at the threshold. Rows are
    judged one by one: equal rows, and rows with a null or repeated doc_id, each count and each have a result. Other
    columns are ignored, whatever their names.
    """
    model = quality_model(docs, labels, most)
    columns = list(dict.fromkeys(["doc_id", "text", host, path]))
    scores = _scored(docs, model, host, path, columns)
    scores = written(scores.select(F.col("row.doc_id").cast("long").alias("doc_id"), "host", "path", "p_doc"), "quality-scores")
    sites, prior = site_sums(scores)
    sites = written(sites, "quality-sites")
    return _with_sites(scores, sites, prior).select("doc_id", "p_doc", "p_site", "p_quality", (F.col("p_quality") >= threshold).alias("kept"))


def good_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of docs, with all their columns, that quality_scores() keeps; texts are read twice and never shuffled.

    An empty table gives an empty one with the same columns; columns of any name pass through.
    """
    model = quality_model(docs, labels, most)
    columns = list(dict.fromkeys(["doc_id", "text", host, path]))
    # the first pass keeps no text: what the sums need is written, not scored again for each of them
    scores = written(_scored(docs, model, host, path, columns).select("host", "path", "p_doc"), "quality-scores")
    sites, prior = site_sums(scores)
    sites = written(sites, "quality-sites")
    return _with_sites(_scored(docs, model, host, path, docs.columns), sites, prior).where(F.col("p_quality") >= threshold).select("row.*")
