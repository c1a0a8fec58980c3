import hashlib
import random
import re

from gleaner.llm.decontam import leak_measures, without_leaks

DOCS, ITEMS = "doc_id long, text string, leak string", "item_id long, text string, n_hit int"


def words(t):
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    wins = {}
    for i, t, *_ in items:
        w = words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - 12)):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for d, t, *_ in docs:
        w = words(t)
        hit, got = set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if x := wins.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    got |= x
        sha = hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(got), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcéñ7") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice((3, 8, 12, 13, 14, 40))), 0) for i in range(20)]
    items += [(50, items[5][1], 0), (51, items[4][1].upper(), 0), (52, None, None), (53, " .,;", 0), (None, text(20), 0)]
    docs = []
    for d in range(60):
        parts = [text(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1] or ""
            w = w.split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts += [rng.choice(", .\n").join(w[a : a + rng.choice((12, 13, 30))]), text(rng.randint(0, 40))]
        docs.append((d, " ".join(parts), "x"))
    docs += [(70, None, None), (71, "", ""), (72, "...", ""), (73, docs[3][1], "again"), (3, docs[3][1], "again"), (74, text(30_000) + " " + items[3][1], "long"), (75, (items[2][1] + " ") * 50, "")]
    return docs, items


def test_both_ways_against_brute_force(spark):
    docs, items = corpus(4)
    d, b = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    for most in (1 << 20, 0):
        got = leak_measures(d, b, most)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    clean = {r[0] for r in want if not r[5]}
    assert {r.doc_id for r in without_leaks(d, b).collect()} == clean
    assert without_leaks(d, b).columns == d.columns


def test_empty_tables(spark):
    docs, items = corpus(5)
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert leak_measures(d.limit(0), b).collect() == []
    for most in (1 << 20, -1):
        assert all(r.n_hit == 0 and not r.contaminated for r in leak_measures(d, b.limit(0), most).collect())


def test_long_documents_lose_the_passages_they_hold(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(9)) for _ in range(n))
    passage, short, head, tail = text(40), text(6), text(1000), text(1000)
    rows = [(1, f"{head} ({passage.upper()}) {tail}", 0), (2, f"{head}\n{' '.join(passage.split()[5:18])}. {short}, {tail}", 0), (3, head, 0), (4, passage, 0), (5, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").selectExpr("doc_id", "text", "coalesce(length(text), 7) as n_chars")
    items = spark.createDataFrame([(1, passage, 0), (2, short, 0)], ITEMS)
    want = {1: f"{head} (…) {tail}", 2: f"{head}\n…, {tail}", 3: head, 5: None}
    for most in (1 << 20, 0):
        left = without_leaks(docs, items, most)
        assert left.dtypes == docs.dtypes
        got = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
        assert {d: t for d, (t, _) in got.items()} == want
        assert all(n == (7 if t is None else len(t)) for t, n in got.values())
        assert all(r.n_hit == 0 for r in leak_measures(left, items).collect())


def test_whole_documents_go_that_hold_a_full_window(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(9)) for _ in range(n))
    passage, short, long = text(40), text(6), text(2000)
    rows = [(1, f"{long} {passage}", 0), (1, long, 0), (2, f"{long} {' '.join(passage.split()[3:15])}", 0), (3, f"{long}\n{short}. End", 0), (None, f"{passage} {long}", 0), (None, None, 0), (4, long, 0), (4, long, 0)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string, leak int"), spark.createDataFrame([(1, passage, 0), (2, short, 0)], ITEMS)
    want = sorted([(1, long, 0), rows[2], (3, f"{long}\n…. End", 0), (None, None, 0), (4, long, 0), (4, long, 0)], key=repr)
    for most in (1 << 20, 0):
        assert sorted(map(tuple, without_leaks(docs, items, most, whole=True).collect()), key=repr) == want


def test_a_word_of_all_documents_on_the_joined_path(spark, monkeypatch):
    from gleaner.llm import _io

    monkeypatch.setattr(_io, "FREQUENT", 5)
    docs = [(d, f"same start w{d} x{d}", "") for d in range(60)]
    items = [(1, "same", 0), (2, "w7 x7", 0)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert sorted(map(tuple, leak_measures(d, b, 0).collect()), key=repr) == brute(docs, items)
