"""Neighbour search against brute force."""

import numpy as np

from gleaner.llm.ann import nearest


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, extra string")


def test_recall_ties_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    m = (centers[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))).astype(np.float32)
    m[300:600] = m[300]  # a third of all rows are one vector
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(m)]
    rows += [(1000, None, "x"), (1100, [0.0] * 16, "x"), (1200, [float("nan")] * 16, "x"), (1300, [None] * 16, "x"), (None, rows[0][1], "x"), (1400, [1.0], "x")]
    got = nearest(_table(spark, rows)).collect()
    assert {r.query_id for r in got} == set(range(0, 900, 100))
    hits = 0
    for q in range(0, 900, 100):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        d = np.sqrt(((m.astype(np.float64) - m[q].astype(np.float64)) ** 2).sum(axis=1))
        best = [i for i in sorted(range(900), key=lambda i: (d[i], i)) if i != q][:10]
        hits += len(set(best) & {r.vec_id for r in own})
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in own)
    assert hits >= 0.9 * 90


def test_few_and_no_vectors(spark):
    got = nearest(_table(spark, [(0, [1.0, 0.0], "x"), (7, [1.0, 0.0], "x"), (9, [0.0, 1.0], "x")])).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(7, 0.0), (9, 1.414214)]
    assert nearest(_table(spark, [])).count() == 0


def test_one_row_of_another_size_leaves_recall_as_it_is(spark):
    rng = np.random.default_rng(5)
    m = (rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 16))).astype(np.float32)
    m[777, 3] = 1e8
    m[778] = 3e38
    got = nearest(_table(spark, [(i, [float(x) for x in v], "x") for i, v in enumerate(m)])).collect()
    hits = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((m.astype(np.float64) - m[q].astype(np.float64)) ** 2).sum(axis=1))
        best = [i for i in np.argsort(d, kind="stable").tolist() if i != q][:10]
        hits += len(set(best) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 400


def test_repeated_ids_other_lengths_and_clashing_names(spark):
    rows = [(0, [1.0, 0.0], 1, 2), (0, [0.0, 1.0], 1, 2), (1, [0.0, 1.0], 1, 2), (2, [3.0, 1.0], 1, 2), (100, [1.0, 1.0, 1.0], 1, 2), (101, [1.0, 1.0, 2.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, v int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 3.0), (100, 1, 101, 1.0)]
