"""Mixing to target weights by soft membership.

A classifier trained on the labelled table gives every document posteriors over domains. Document rates (expected
repeats, not negative) are fitted so that the expected tokens of each domain, sum of rate x tokens x posterior, meet
the target weights of the corpus total, by projected-gradient least squares from rates of one. Each step needs one
distributed sum per domain. Rates so far are written every few steps, so a step computes only what is new since then;
the residuals, of which there are at most steps x domains, give any document's rate again as a fold.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm._classify import MOST_LABELLED, classified, train
from gleaner.llm._io import written

DOMAINS = ("low", "clean", "toxic")
TARGETS = {"low": 0.01, "clean": 0.98, "toxic": 0.01}
STEPS, TOLERANCE = 60, 1e-5
#: Steps after which rates are written.
BLOCK = 6


def domain_label() -> Column:
    """Domains of the labelled table: toxic, else low quality, else clean."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 1)


def _rate(steps: list[list[float]], domains: int) -> Column:
    """The projected-gradient iterate of a document with posteriors p, from all residuals so far."""
    if not steps:
        return F.lit(1.0)
    rows = ", ".join("array(" + ", ".join(f"{x!r}D" for x in s) + ")" for s in steps)
    dot = " + ".join(f"p[{k}] * g[{k}]" for k in range(domains))
    return F.expr(f"aggregate(array({rows}), 1D, (r, g) -> greatest(0D, r - ({dot})))")


def _newer(steps: list[list[float]]) -> Column:
    """As _rate(), from the written rate `r` and posteriors p0, p1, ... on: plain arithmetic, compiled with its scan."""
    rate = F.col("r")
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p{i}") * F.lit(x) for i, x in enumerate(step[1:], 1)), F.col("p0") * F.lit(step[0])))
    return rate


def fit_rates(scores: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """scores: n_tokens, p. The residuals whose fold is each document's rate."""
    k = len(targets)
    names = [f"p{i}" for i in range(k)]
    sums = lambda rate: [F.sum(rate * F.col("n_tokens") * F.col(c)).alias(c) for c in names]
    state = written(scores.select("n_tokens", *[F.col("p")[i].alias(c) for i, c in enumerate(names)], F.lit(1.0).alias("r")), "mixing-rates")
    first = state.agg(F.sum("n_tokens").cast("double").alias("t"), *sums(F.lit(1.0))).first()
    if not first.t:
        return []
    mass = [max(first[c] / first.t, 1e-9) for c in names]
    now, history, recent = [first[c] / first.t for c in names], [], []
    for _ in range(steps):
        if max(abs(x - t) for x, t in zip(now, targets, strict=True)) <= tolerance:
            break
        # residuals relative to a domain's mass: the operator's norm is then at most one and a full step is safe
        history.append([(x - t) / m for x, t, m in zip(now, targets, mass, strict=True)])
        recent.append(history[-1])
        if len(recent) == BLOCK:
            state, recent = written(state.withColumn("r", _newer(recent)), "mixing-rates"), []
        r = state.agg(*sums(_newer(recent))).first()
        now = [r[c] / first.t for c in names]
    return history


def _shares(targets: Mapping[str, float]) -> list[float]:
    if set(targets) != set(DOMAINS) or min(targets.values()) < 0 or not sum(targets.values()):
        raise ValueError(f"targets must give weights, none negative, for {DOMAINS}")
    return [targets[d] / sum(targets.values()) for d in DOMAINS]


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain, rate of every row of docs (doc_id, text).

    labels: doc_id, quality, toxic. Tokens are words between white space. A null or blank text has no tokens and is
    rated by its posteriors like others. Without labelled texts posteriors are even and all rates are equal; so are
    those of equal rows, and rows with a null or repeated doc_id are rated each by its own text. Other columns are
    ignored, whatever their names. An empty table gives an empty one.
    """
    shares = _shares(targets)
    model = train(docs, labels, domain_label(), len(DOMAINS), most)
    scores = classified(docs, model, len(DOMAINS), ["doc_id", "text"])
    scores = written(scores.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("n_words").alias("n_tokens"), "p"), "mixing-scores")
    rate = _rate(fit_rates(scores, shares), len(DOMAINS))
    return scores.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], rate.alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, most: int = MOST_LABELLED) -> DataFrame:
    """docs with their rate, without the rows whose rate is zero; texts are read twice and never shuffled.

    Rows are rated as in mixing_rates(). Columns of any name pass through, but one named `rate` (in any case) is set anew.
    """
    shares = _shares(targets)
    model = train(docs, labels, domain_label(), len(DOMAINS), most)
    scores = written(classified(docs, model, len(DOMAINS), ["doc_id", "text"]).select(F.col("n_words").alias("n_tokens"), "p"), "mixing-scores")
    rate = _rate(fit_rates(scores, shares), len(DOMAINS))
    rated = classified(docs, model, len(DOMAINS)).withColumn("rate", rate).where("rate > 0")
    return rated.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "rate"], "rate")
