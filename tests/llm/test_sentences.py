import random
import re

from gleaner.llm.sentences import remove_repeated_spans

SCHEMA = "doc_id long, text string, spans string"


def split(text):
    """(words, from, to) of each sentence; it reaches to the next one's start."""
    found, prev = [], None
    text = text or ""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    for m in re.finditer(r"[^\x20\x09-\x0D]+", low):
        if prev is None or "\n" in text[prev.end() : m.start()] or prev.group()[-1] in ".!?":
            found.append([[], m.start()])
        found[-1][0].append(m.group())
        prev = m
    return [(w, a, (found[i + 1][1] if i + 1 < len(found) else len(text))) for i, (w, a) in enumerate(found)]


def spans(sents, k, n, long):
    got, lens = set(), [len(s[0]) for s in sents]
    for i in range(len(sents)):
        for j in range(i + k - 1, len(sents)):
            if sum(lens[i : j + 1]) >= n:
                got.add((i, j))
                break
        for j in range(i - k + 1, -1, -1):
            if sum(lens[j : i + 1]) >= n:
                got.add((j, i))
                break
        if lens[i] >= long:
            got.add((i, i))
    return got


def brute(rows, *least):
    seen, gone = set(), {d: set() for d, *_ in rows}
    every = sorted((d, i, j) for d, t, *_ in rows for i, j in spans(split(t), *least))
    by = {d: split(t) for d, t, *_ in rows}
    for d, i, j in every:
        key = tuple(w for s in by[d][i : j + 1] for w in s[0])
        if key in seen:
            gone[d].update(range(i, j + 1))
        seen.add(key)
    out = {}
    for d, t, *_ in rows:
        t = t or ""
        s = by[d]
        left = (t[: s[0][1]] if s else t) + "".join(t[a:b] for i, (_, a, b) in enumerate(s) if i not in gone[d])
        out[d] = (len(s), len(gone[d]), left)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 12))) + rng.choice(".!?")
    passages = [" ".join(sentence() for _ in range(rng.randint(1, 6))) for _ in range(6)]
    rows = [(d, rng.choice(" \n").join(rng.choice(passages) if rng.random() < 0.3 else sentence() for _ in range(rng.randint(0, 9))), "x") for d in range(80)]
    rows += [(100 + i, "Yes. No! " * 40 if i % 2 else rows[0][1].upper(), "") for i in range(12)]
    rows += [(200, None, None), (201, "", ""), (202, " \n", ""), (203, "w " * 60, ""), (204, "W  " * 60, ""), (205, " ".join(sentence() for _ in range(4000)), "")]
    for least in ((2, 12, 24), (3, 5, 1000)):
        got = remove_repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(3), *least)
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute(rows, *least)


def test_a_passage_goes_but_its_first_place(spark):
    p = "The quick fox went over the old wall. Nobody saw where it had gone to that night. So we waited."
    rows = [(5, f"Alpha beta. {p} Gamma.", ""), (2, f"One two three.\n{p}\nFour.", ""), (9, f"{p}", "")]
    got = {r.doc_id: r for r in remove_repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2].n_removed, got[5].n_removed, got[9].n_removed) == (0, 3, 3)
    assert got[5].text == "Alpha beta. Gamma." and got[9].text == ""


def test_empty_table(spark):
    assert remove_repeated_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_passage_within_other_sentences_loses_words(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(9)) for _ in range(n))
    passages = [text(51) for _ in range(40)]
    rows = [(d, f"{text(d)} {p} {text(30)}.", "") for d, p in enumerate(passages)] + [(100 + d, f"{text(20)} {p.upper()} {text(d)}.", "") for d, p in enumerate(passages)] + [(200, text(300), "")]
    got = {r.doc_id: r for r in remove_repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(3), gram=24).collect()}
    for d, t, _ in rows:
        left, was = got[d].text.split(), t.split()
        if 100 <= d < 200:
            gone = len(was) - len(left)
            assert 24 <= gone <= 51 and got[d].n_removed == 1
            assert left[:20] == was[:20] and left[len(left) - d + 100 :] == was[len(was) - d + 100 :]
        else:
            assert got[d].text == t and got[d].n_removed == 0


def test_every_run_of_several_sentences_counts(spark):
    rng = random.Random(11)
    sentence = lambda: " ".join(rng.choice("abcde") * rng.randint(1, 3) for _ in range(rng.randint(1, 8))) + "."
    passages = [" ".join(sentence() for _ in range(rng.randint(2, 9))) for _ in range(5)]
    rows = [(d, " ".join(rng.choice(passages) if rng.random() < 0.4 else sentence() for _ in range(rng.randint(0, 8))), "") for d in range(60)]
    every = lambda s: {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if sum(len(x[0]) for x in s[i : j + 1]) >= 12}
    seen, want = set(), {}
    for d, t, _ in rows:
        s, gone = split(t), set()
        for i, j in sorted(every(s)):
            key = tuple(w for x in s[i : j + 1] for w in x[0])
            if key in seen:
                gone.update(range(i, j + 1))
            seen.add(key)
        want[d] = len(gone)
    got = remove_repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(3), 2, 12, 10**6)
    assert {r.doc_id: r.n_removed for r in got.collect()} == want


def test_equal_rows_and_null_ids_keep_a_first_copy(spark):
    p = "The quick fox went over the old wall. Nobody saw where it had gone to that night. So we waited."
    rows = [(1, p, "x"), (1, p, "x"), (None, p, "x"), (None, None, None), (1, "Other words that stand here once alone.", "x"), (0, "", "x")]
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in remove_repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == sorted([("1", 3, 0, p), ("1", 3, 3, ""), ("None", 3, 3, ""), ("None", 0, 0, ""), ("1", 1, 0, rows[4][1]), ("0", 0, 0, "")])
