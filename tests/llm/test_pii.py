import hashlib
import random
import re

from gleaner.llm import pii
from gleaner.llm.pii import private_data, redacted, reliabilities

SCHEMA = "doc_id long, text string, n_email string"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 8 <= len(d) <= 15


def brute(text):
    text = text or ""
    found = {k: [m.span() for m in re.finditer(p, text) if passes(k, m.group())] for k, p in RULES.items()}
    said = ",".join(f"{k}:{a}:{b}" for k in RULES for a, b in found[k])
    return (*(len(found[k]) for k in RULES), hashlib.sha256(said.encode()).hexdigest()), said


def texts():
    rng = random.Random(11)
    bits = ["a.b@c.d", "x@y", "@", "a@b.c_d@e.f", "a@b.cc@d.ee", ".x@-.y-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.0004", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "4222222222222222", "+1 (555) 123-4567", "+12", "++49 30 1234567", "+1-", "é", "🙂", " ", "-", ".", "0", "77", "\n", "word"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    made += ["".join(rng.choice("0123456789 -.+@ab") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    made += ["4111111111111111 a@b.co " * 700, "9" * 3000, "1 " * 1500, "1." * 1500, "a@b" + ".c" * 1500, "x." * 1500, "+" + "1-" * 1500, "", "é" * 50 + "me@x.org"]
    return made


def test_base_spans_against_the_rules(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, None), (5, "again a@b.c", "")]
    got = private_data(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert got[0].__fields__ == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = sorted(((d, *brute(t)[0]) for d, t, _ in rows), key=repr)
    assert sorted((tuple(r[:6]) for r in got), key=repr) == want
    text = {d: t for d, t, _ in rows}
    for r in got:
        if r.doc_id is not None and r.doc_id != 5:
            assert [s for s in r.spans.split(",") if s.split(":")[0] in RULES] == [s for s in brute(text[r.doc_id])[1].split(",") if s]


def test_long_runs_neither_recurse_nor_rescan(spark):
    long = ["9" * 200_000, "1 " * 100_000, "1." * 100_000, "a@b" + ".c" * 100_000, "x." * 100_000, "+" + "1-" * 100_000]
    got = private_data(spark.createDataFrame([(i, t, "") for i, t in enumerate(long)], SCHEMA)).collect()
    assert {r.doc_id: tuple(r[1:5]) for r in got} == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, 25_000, 0, 0), 3: (1, 0, 0, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 0)}


def test_labelers_add_what_the_rules_miss(spark):
    rng = random.Random(2)
    rows = [(i, f"The password = {rng.getrandbits(64):016x} was set. Nothing else here.", "") for i in range(30)]
    rows += [(100 + i, f"We met at noon dot it was a fine day {i}.", "") for i in range(30)] + [(200, "Write to joe [at] mail [dot] org please", "")]
    got = {r.doc_id: r.spans for r in private_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].startswith("secret:4:") for i in range(30))
    assert not any(got[100 + i] for i in range(30))


def test_reliabilities_find_the_bad_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        vote = tuple((1 if y else -1) if rng.random() < a else (-1 if y else 1) for a in (0.95, 0.9, 0.9, 0.5))
        counts[vote] = counts.get(vote, 0) + 1
    model, _ = reliabilities([("k", v, n) for v, n in counts.items()])
    prior, theta = model["k"]
    right = [(theta[j, 1, 2] + theta[j, 0, 0]) / 2 for j in range(4)]
    assert abs(prior - 0.4) < 0.05 and right[0] > 0.9 and abs(right[3] - 0.5) < 0.06


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "Mail é a@b.co or +1 (555) 123-4567.", "n"), (2, None, None), (3, "clean text", ""), (4, "", "")]
    out = redacted(spark.createDataFrame(rows, "doc_id long, text string, base string"))
    assert out.columns == ["doc_id", "text", "base"]
    got = {r.doc_id: (r.text, r.base) for r in out.collect()}
    assert got == {1: ("Mail é [EMAIL] or [PHONE].", "n"), 2: (None, None), 3: ("clean text", ""), 4: ("", "")}
    assert redacted(spark.createDataFrame([], "doc_id long, text string, n_chars long")).collect() == []


def test_addresses_with_parts_of_zeros_alone(spark):
    found = ["10.0.0.1", "127.0.0.1", "0.0.0.0", "192.168.1.0", "000.00.0.01", "8.8.8.8", "0255.0.0.255"]
    rows = [(i, f"from {t} on", "x") for i, t in enumerate(found)] + [(100 + i, f"from {t} on", "x") for i, t in enumerate(["0.0.0.256", "0.0.0.0256", "00300.0.0.0", "0." + "0" * 4_000 + "256.0.0"])]
    got = {r.doc_id: tuple(r[1:6]) for r in private_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: brute(t)[0] for d, t, _ in rows}
    assert all(got[i][1] == (1 if i < 100 else 0) for i in got)
    texts = [r.text for r in redacted(spark.createDataFrame(rows[: len(found)], SCHEMA)).collect()]
    assert texts == ["from [IP] on"] * len(found)


def test_gazetteer_votes(spark):
    texts = ["call james 555-123-4567 now", "order 555-123-4567 shipped", "nothing 555-123-4567 here", "ann [at] gmail [dot] com", "password=hunter2hunter2 placeholder", "aws secret=abcd1234efgh5678"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = pii._candidates(pii.base_spans(df), pii.gazetteer_words()).selectExpr("i", "transform(cands, c -> c.v_gazetteer) as v").orderBy("i").collect()
    assert [r.v for r in rows] == [[1], [-1], [0], [1], [-1], [1]]
    own = spark.createDataFrame([("number", "Nothing", 1), ("number", None, 1), ("number", "call", -1)], "kind string, word string, vote int")
    rows = pii._candidates(pii.base_spans(df), pii.gazetteer_words(own)).selectExpr("i", "transform(cands, c -> c.v_gazetteer) as v").orderBy("i").collect()
    assert [r.v for r in rows] == [[-1], [0], [1], [0], [0], [0]]


def test_repeats_nulls_long_texts_and_empty_tables(spark):
    rows = [(1, None, 5), (1, "a@b.co 10.0.0.1", 5), (1, "a@b.co 10.0.0.1", 5), (None, "a@b.co", 5), (2, "", 5), (3, "word " * 100_000 + "a@b.co", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.spans) for r in pii.private_data(df).collect())
    assert got == sorted([("1", 0, 0, ""), ("1", 1, 1, "email:0:6,ip:7:15"), ("1", 1, 1, "email:0:6,ip:7:15"), ("None", 1, 0, "email:0:6"), ("2", 0, 0, ""), ("3", 1, 0, "email:500000:500006")])
    assert pii.private_data(df.limit(0)).collect() == [] and pii.redacted(df.limit(0)).columns == df.columns
