import random
import re

from gleaner.llm import _graph, _io
from gleaner.llm.neardup import near_duplicates, without_near_duplicates

SCHEMA = "doc_id long, text string, kept string"


def sets(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    s = {d: sets(t) for d, t, *_ in rows}
    up = {d: d for d in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(s[d]), root(d), root(d) == d) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeßé") for _ in range(rng.randint(1, 5)))
    rows = [(d, " ".join(word() for _ in range(rng.randint(6, 120))), "x") for d in range(60)]
    base = [word() for _ in range(90)]
    for d in range(100, 190):  # a chain and a cloud of near copies around the threshold
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4))):
            w[rng.randrange(len(w))] = word()
        rows.append((d, " ".join(w), "near"))
        if rng.random() < 0.2:
            base = w
    rows += [(200 + i, rows[3][1].upper().replace(" ", "\t\n"), "copy") for i in range(20)]
    rows += [(300, None, None), (301, "", ""), (302, " \n ", ""), (303, "one two", ""), (304, "ONE  two", ""), (305, "two one", ""), (306, "a b c d e", ""), (307, "a b c d e " * 300, "")]
    return rows


def test_against_brute_force(spark):
    for seed, percent, block in ((1, 85, 256), (2, 80, 7), (3, 85, 3)):
        rows = corpus(seed)
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), percent, block)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute(rows, percent)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_frequent_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(_io, "FREQUENT", 4)
    rows = corpus(6)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 85)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute(rows, 85)


def test_components_of_a_node_with_many_links(spark, monkeypatch):
    monkeypatch.setattr(_io, "FREQUENT", 3)
    pairs = [(50, i) for i in range(100) if i % 3] + [(200 + i, 201 + i) for i in range(30)] + [(50, 999), (7, 7), (50, 1)]
    got = dict(map(tuple, _graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: 1 for i in [*range(1, 100), 999] if i % 3 or i == 999} | {i: 200 for i in range(200, 231)}


def test_repeated_and_null_ids_and_long_texts(spark):
    rng = random.Random(4)
    a, b = "one two three four five six seven", "other words stand in this text here"
    long = " ".join(str(rng.randint(0, 9999)) for _ in range(40_000))
    rows = [(1, a, ""), (1, a, ""), (1, b, ""), (None, b, ""), (None, b, ""), (2, a, ""), (3, None, ""), (3, None, ""), (4, long, ""), (5, long + " end", ""), (None, "all alone are these five words", ""), (None, "All alone are these five words", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((str(r[0]), r[2], r[3]) for r in near_duplicates(df).collect()), key=str)
    assert [x for x in got if x[0] in "12345"] == [("1", 1, True), ("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("3", 3, True), ("4", 4, True), ("5", 4, False)]
    assert sorted(str(x[1:]) for x in got if x[0] == "None") == ["(1, False)", "(1, False)", "(None, False)", "(None, True)"]
    left = without_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((str(r[0]), str(r[1])[:9].lower()) for r in left.collect()) == sorted([("1", a[:9]), ("1", b[:9]), ("3", "none"), ("3", "none"), ("4", long[:9]), ("None", "all alone")])
