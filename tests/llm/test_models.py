"""Quality, mixing and the pipeline: held-out accuracy, targets that are met, and cases at the edge."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing, quality

GOOD, BAD, TOXIC = ("the river meadow harvest season farmer field"), ("CLICK buy!!! 999 $$$ free WIN"), ("scum filth vermin idiots rats")


def _corpus(spark, n=300):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        kind = ("good", "bad", "toxic")[0 if i % 4 < 2 else 1 if i % 4 == 2 else 2]
        words = {"good": GOOD, "bad": BAD, "toxic": GOOD + " " + TOXIC}[kind].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(60)), "src0" if i % 3 else None, "en", 7))
        labels.append((i, int(kind != "bad"), int(kind == "toxic")))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, p_doc int"), labels


def test_quality_on_held_out_texts(spark):
    docs, labels = _corpus(spark)
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality_scores(docs, known).collect()}
    held = [x for x in labels if x[0] % 5 == 0]
    assert len(got) == len(labels)
    assert sum(got[i] == bool(q) for i, q, _ in held) >= 0.95 * len(held)
    kept = quality.good_quality(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, k in got.items() if k}


def test_rates_meet_the_targets(spark):
    docs, labels = _corpus(spark)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    targets = {"low": 0.1, "clean": 0.85, "toxic": 0.05}
    rates = mixing.mixing_rates(docs, known, targets)
    total = rates.agg(F.sum("n_tokens")).first()[0]
    found = rates.agg(F.min("rate").alias("least"), *[(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) / total).alias(d) for d in mixing.DOMAINS]).first()
    assert found.least >= 0
    assert [found[d] for d in mixing.DOMAINS] == pytest.approx([targets[d] for d in mixing.DOMAINS], abs=0.005)


def test_written_rates_are_the_fold_of_all_steps(spark):
    scores = spark.createDataFrame([(10, [0.7, 0.2, 0.1]), (30, [0.1, 0.8, 0.1]), (5, [0.2, 0.1, 0.7])], "n_tokens long, p array<double>")
    steps = mixing.fit_rates(scores, [0.05, 0.9, 0.05], steps=20, tolerance=0.0)
    want = []
    for n, p in [(r.n_tokens, r.p) for r in scores.collect()]:
        rate = 1.0
        for s in steps:
            rate = max(0.0, rate - sum(a * b for a, b in zip(p, s, strict=True)))
        want.append((n, rate))
    got = scores.select("n_tokens", mixing._rate(steps, 3).alias("r")).collect()
    assert [(r.n_tokens, r.r) for r in got] == [(n, pytest.approx(r)) for n, r in want]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, 1), (2, "", "s", "en", 1), (3, "one", "s", "en", 1), (3, "one", "s", "en", 1), (4, "word " * 50_000, "s", "en", 1)]])
def test_empty_and_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, none).count() == len(rows)
    assert quality.good_quality(docs, none).count() == len(rows)  # without labels every text is kept
    assert mixing.mixing_rates(docs, none).count() == len(rows)
    assert mixing.mixed(docs, none).columns == ["doc_id", "text", "source", "lang", "rate"]


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == [*docs.columns, "rate"]
    rows = found.collect()
    assert 0 < len(rows) < docs.count()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]


def _brute_sites(rows):
    """p_quality of (host, path, p_doc) rows by plain loops."""
    n, mean = len(rows), sum(p for _, _, p in rows) / len(rows)

    def strength(keys):
        sums = {}
        for k, (_, _, p) in zip(keys, rows, strict=True):
            s, m = sums.get(k, (0.0, 0))
            sums[k] = (s + p, m + 1)
        if len(sums) < 2:
            return 100.0, sums
        noise = max(mean * (1 - mean), 1e-4)
        spread = sum(m * (s / m - mean) ** 2 for s, m in sums.values())
        return max(2.0, noise / max((spread - (len(sums) - 1) * noise) / n, noise / 1000)), sums

    a, hosts = strength([h for h, _, _ in rows])
    b, paths = strength([(h, q) for h, q, _ in rows])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for h, q, p in rows:
        host = (hosts[h][0] - p + a * mean) / (hosts[h][1] - 1 + a)
        site = min(1.0, max(0.0, (paths[h, q][0] - p + b * host) / (paths[h, q][1] - 1 + b)))
        shift = min(1.5, max(-1.5, logit(site) - math.log(mean / (1 - mean))))
        out.append((site, 1 / (1 + math.exp(-(logit(p) + shift)))))
    return out


def test_sites_against_plain_loops(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(h := rng.choice("abcd"), rng.choice("xy"), min(1.0, max(0.0, rng.gauss({"a": 0.9, "b": 0.3}.get(h, 0.6), 0.2)))) for _ in range(200)]
    rows += [("alone", "x", 0.01), ("alone2", "y", 0.99), *[("a", "x", 0.5)] * 3]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, host string, path string, p_doc double")
    want = _brute_sites(rows)
    for most in (quality.MOST_SITES, 0):
        monkeypatch.setattr(quality, "MOST_SITES", most)
        sites, prior = quality.site_sums(df)
        got = quality._with_sites(df, sites, prior).orderBy("i").collect()
        assert len(got) == len(rows)
        for r, (site, p) in zip(got, want, strict=True):
            assert (r.p_site, r.p_quality) == (pytest.approx(site), pytest.approx(p))


def test_a_document_alone_on_its_site_is_judged_by_the_prior_of_others(spark):
    rows = [(i, f"h{i}", "x", p) for i, p in enumerate([0.05, 0.5, 0.95] * 5)]
    df = spark.createDataFrame(rows, "i int, host string, path string, p_doc double")
    sites, prior = quality.site_sums(df)
    for r in quality._with_sites(df, sites, prior).collect():
        assert r.p_site == pytest.approx(prior.mean) and r.p_quality == pytest.approx(r.p_doc)


def test_fitted_rates_against_a_plain_fit(spark):
    rng = np.random.default_rng(4)
    n, p = rng.integers(1, 400, 60), rng.dirichlet([0.4, 1.0, 0.2], 60)
    scores = spark.createDataFrame([(int(x), [float(v) for v in y]) for x, y in zip(n, p, strict=True)], "n_tokens long, p array<double>").repartition(3)
    for targets in ([0.1, 0.85, 0.05], [0.0, 1.0, 0.0]):
        steps = mixing.fit_rates(scores, targets, steps=40, tolerance=1e-9)
        got = {(r.n_tokens, tuple(r.p)): r.r for r in scores.select("n_tokens", "p", mixing._rate(steps, 3).alias("r")).collect()}
        rate, total, mass = np.ones(60), n.sum(), np.maximum((n[:, None] * p).sum(axis=0) / n.sum(), 1e-9)
        for _ in range(len(steps)):
            now = (rate[:, None] * n[:, None] * p).sum(axis=0) / total
            rate = np.maximum(0.0, rate - p @ ((now - np.array(targets)) / mass))
        assert all(got[int(x), tuple(float(v) for v in y)] == pytest.approx(r, abs=1e-9) for x, y, r in zip(n, p, rate, strict=True))
        before = np.abs((n[:, None] * p).sum(axis=0) / total - targets).max()
        after = np.abs((rate[:, None] * n[:, None] * p).sum(axis=0) / total - targets).max()
        assert rate.min() >= 0 and after < before / 3 and (targets[0] == 0 or after < 0.01)
