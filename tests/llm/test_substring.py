import hashlib
import random
from collections import defaultdict

from gleaner.llm.substring import remove_repeats

SCHEMA = "doc_id long, text string, lo string"


def brute(rows, n):
    """Every window of every text in one dictionary."""
    at = defaultdict(list)
    for d, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            at[b[p : p + n]].append((d, p))
    hit = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for d, p in places:
                hit[d].update(range(p, p + n))
    out = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        left = bytes(c for i, c in enumerate(b) if i not in hit[d])
        spans = sum(1 for i in hit[d] if i - 1 not in hit[d])
        out[d] = (len(b), len(hit[d]), spans, hashlib.sha256(left).hexdigest())
    return out


def found(spark, rows, n, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r[0]: tuple(r[1:5]) for r in remove_repeats(df, n, **more).collect()}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(8)]
    rows = []
    for d in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 7))]
        rows.append((d, " ".join(parts), "x"))
    rows += [(n + i, rows[i % 3][1], "copy") for i in range(9)]
    rows += [(900, None, None), (901, "", ""), (902, "a" * 150, ""), (903, "ab" * 90, ""), (904, "é", ""), (905, rows[0][1] * 30, "long")]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        for n in (40, 25):
            assert found(spark, rows, n) == brute(rows, n)


def test_large_groups_take_the_shuffled_path(spark):
    rng = random.Random(5)
    common = "".join(rng.choice("xyz ") for _ in range(60))
    word = lambda: "".join(rng.choice("abcdef") for _ in range(25))
    rows = [(d, word() + common + word(), "") for d in range(40)] + [(50, word() + common[:45] + word(), "")]
    assert found(spark, rows, 40, group=5) == brute(rows, 40) == found(spark, rows, 40)


def test_empty_table_and_kept_bytes(spark):
    assert found(spark, [], 40) == {}
    rows = [(1, "p" * 3 + "0123456789" * 5, ""), (2, "0123456789" * 5 + "é", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id: bytes(r.kept) for r in remove_repeats(df, 40, texts=True).collect()}
    assert kept == {1: b"ppp", 2: "é".encode()}


def test_groups_that_end_as_their_rows_are_passed_on(spark):
    rng = random.Random(6)
    common = "".join(rng.choice("xyz ") for _ in range(60))
    word = lambda: "".join(rng.choice("abcdef") for _ in range(25))
    for n in (5, 10):
        rows = [(d, word() + common + word(), "") for d in range(n)]
        assert found(spark, rows, 40, group=4) == brute(rows, 40)


def test_crowded_parts_that_share_only_some_windows(spark):
    rng = random.Random(7)
    text = lambda n, letters="xyz ": "".join(rng.choice(letters) for _ in range(n))
    common = text(120)
    rows = [(d, text(30, "abcdef") + common[rng.randint(0, 40) : rng.randint(60, 120)] + text(30, "abcdef"), "") for d in range(80)]
    rows += [(100 + d, rows[d % 7][1], "") for d in range(20)]
    for n in (40, 25):
        assert found(spark, rows, n, group=2) == brute(rows, n) == found(spark, rows, n)


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    a, b = "one passage that stands in several texts, ", "a text of its own, with no part anywhere else"
    given = [(1, a + b), (1, a), (1, a), (None, "x" + a), (None, None), (2, b[:30])]
    want = brute([(i, t) for i, (_, t) in enumerate(given)], 40)
    df = spark.createDataFrame([(d, t, "") for d, t in given], SCHEMA).repartition(3)
    got = sorted((str(r[0]), *r[1:5]) for r in remove_repeats(df, 40).collect())
    assert got == sorted((str(given[i][0]), *w) for i, w in want.items())


def test_long_texts_and_many_equal_rows(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.randint(0, 99)) for _ in range(60_000))
    rows = [(0, long, ""), (1, long[50_000:], ""), *((2 + d, "the same short text in a third of all rows, word for word", "") for d in range(300))]
    got = found(spark, rows, 50)
    assert got[0][0] == len(long) and got[0][1] >= len(long) - 50_000 and got[1][1] == got[1][0]
    assert all(got[2 + d][1] == got[2 + d][0] for d in range(300))
