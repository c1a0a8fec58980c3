"""Personal data by weak supervision, in DataFrame functions alone.

Four base kinds are found by rule (email, ip, card, phone) and always stay. Beyond them, looser candidates (written-out
addresses, numbers in phone or account shape, credentials) are put to labelers that vote yes, no or nothing: the shape
of the match, a gazetteer of names, places, providers and services around it, cue words in the context before it, and
the mix of its characters. Votes are counted over
the whole corpus by pattern; there are at most some thousands of patterns whatever the corpus, and expectation-
maximisation over those counts estimates each labeler's reliability by kind. The posteriors train a logistic span
classifier, which becomes one SQL expression. Nothing but the counts of patterns reaches the driver.

Offsets are code points. Matches are located by the lengths of matches and of what stands between them; sums run in
blocks, so a text with very many matches is not quadratic. Patterns use possessive loops and look-behinds that give
the same matches as the plain rules but neither recurse nor rescan long runs.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("contact", "number", "secret")

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "contact": r"(?i)(?<![A-Za-z0-9._-])[a-z0-9._-]{2,40}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[a-z0-9-]{2,40}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[a-z]{2,10}(?![A-Za-z0-9])",
    "number": r"(?<![A-Za-z0-9=\x22.+-])(?:\([0-9]{2,4}\)\x20?[0-9]{3}[\x20.-][0-9]{3,4}|[0-9]{3}[.-][0-9]{2,3}[.-][0-9]{4}|[0-9]{4}(?:[\x20-]?[0-9]{4}){3})(?![A-Za-z0-9.-])",
    "secret": r"(?i)(?:(?<![a-z0-9])(?:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?\x22?[a-z0-9+/_-]{8,64}\x22?|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9]))",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}+)"
_CUES = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|card|account|visa|ssn|passport|login|password|passwd|token|secret|key|user)"
# Words that speak for a candidate of a kind when they stand in it or near it, and words that speak against it.
GAZETTEER = {
    ("contact", 1): """gmail googlemail yahoo hotmail outlook aol icloud proton protonmail gmx live msn yandex zoho fastmail tutanota mail
        com org net edu""",
    ("contact", -1): "look looked looking arrive arrived noon night least once home school stop stopped",
    ("number", 1): """james mary john maria anna peter paul robert michael linda david elizabeth william barbara richard susan joseph jessica
        thomas sarah charles karen daniel nancy marie jean pierre hans karl jose juan luis carmen london paris berlin madrid rome vienna
        dublin lisbon boston chicago dallas denver houston phoenix seattle""",
    ("number", -1): "isbn issn order invoice version sku build model serial issue page pages figure table ratio score copyright rev",
    ("secret", 1): "aws amazon github gitlab stripe slack google azure ssh jdbc mysql postgres redis mongodb docker jenkins admin root prod production",
    ("secret", -1): "example placeholder changeme dummy sample lorem your test mock fake",
}
#: Words that a gazetteer may hold, as every task holds it, and characters on each side of a candidate that it is looked up in.
MOST_WORDS, NEAR = 1000, 40
_STRICT = {
    "contact": r"(?i)(?:\[at\]|\(at\)).*(?:\[dot\]|\(dot\))",
    "number": r"^\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$",
    "secret": r"[0-9a-f]{16}|AKIA[A-Z0-9]{16}",
}
#: What a text must hold for a kind's pattern to be tried.
_HINTS = {
    "email": "contains(text, '@')",
    "phone": "contains(text, '+')",
    "contact": r"text rlike r'(?i)[\[(\x20]at[\])\x20]'",
    "secret": r"text rlike r'(?i)passw|secret|token|api[_-]?key|AKIA'",
}
_NUMERIC = r"text rlike r'[0-9][0-9.\x20()-]{5}'"
_BLOCK = 256
#: Labelers' votes, each -1, 0 or 1, and how candidates' lengths and digit shares are put in classes.
VOTES = ("v_shape", "v_gazetteer", "v_context", "v_mix")
ACCEPT = 0.5


def _let(name: str, value: str, body: str) -> str:
    """SQL in which `name` stands for a value that is computed once, also where the optimizer merges projections."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _located(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Adds to df(text) a column s_<kind> of array<struct<start int, end int, match string>> for each kind."""
    out = {}
    for kind in kinds:
        pattern = f"r'{PATTERNS[kind]}'"
        ahead = f"aggregate(slice(a, cast(i div {_BLOCK} as int) * {_BLOCK} + 1, i % {_BLOCK}), 0L, (s, x) -> s + x)"
        start = f"cast(element_at(o, cast(i div {_BLOCK} as int) + 1) + {ahead} + length(element_at(b, i + 1)) as int)"
        offsets = f"""aggregate(sequence(0, cast(size(a) div {_BLOCK} as int)), array(0L),
            (acc, k) -> array_append(acc, element_at(acc, -1) + aggregate(slice(a, k * {_BLOCK} + 1, {_BLOCK}), 0L, (s, x) -> s + x)))"""
        body = f"transform(m, (y, i) -> {_let('p', start, "named_struct('start', p, 'end', p + length(y), 'match', y)")})"
        body = _let("a", "transform(b, (x, i) -> length(x) + coalesce(length(try_element_at(m, i + 1)), 0))", _let("o", offsets, body))
        body = _let("b", f"split(text, {pattern}, -1)", body)
        none = "cast(array() as array<struct<start: int, end: int, match: string>>)"
        found = f"if({_HINTS.get(kind, _NUMERIC)}, regexp_extract_all(text, {pattern}, 0), cast(array() as array<string>))"
        out[f"s_{kind}"] = F.expr(_let("m", found, f"if(size(m) = 0, {none}, {body})"))
    return df.withColumns(out)


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    return (
        f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + (case when i % 2 = 1 then cast(substr({digits}, -i, 1) as int)"
        f" else cast(substr('0246813579', cast(substr({digits}, -i, 1) as int) + 1, 1) as int) end)) % 10 = 0"
    )


def base_spans(df: DataFrame) -> DataFrame:
    """Adds s_email, s_ip, s_card, s_phone to df(text): matches of the rules that also pass their check."""
    df = _located(df, BASE)
    octets = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
    checks = {
        "email": "true",
        "ip": f"x.match rlike r'{octets}'",
        "card": f"length({_digits('x.match')}) between 16 and 19 and {_luhn(_digits('x.match'))}",
        "phone": f"length({_digits('x.match')}) between 8 and 15",
    }
    return df.withColumns({f"s_{k}": F.expr(f"filter(s_{k}, x -> {c})") for k, c in checks.items()})


def gazetteer_words(table: DataFrame | None = None) -> dict[tuple[str, int], list[str]]:
    """(kind, vote 1 or -1) -> words, of GAZETTEER or of a table (kind, word, vote) of MOST_WORDS rows at most.

    Words are compared in lower case (A-Z); rows with a null are passed over. A larger table is an error.
    """
    if table is None:
        return {k: w.split() for k, w in GAZETTEER.items()}
    rows = table.select("kind", "word", "vote").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a gazetteer has {MOST_WORDS} words at most")
    out: dict[tuple[str, int], list[str]] = {}
    for kind, word, vote in rows:
        if None not in (kind, word, vote):
            out.setdefault((kind, int(vote)), []).append(word)
    return out


def _looked_up(kind: str, words: dict[tuple[str, int], list[str]]) -> str:
    """SQL: the vote of the words in and around candidate x of text; words that speak against it count first."""
    listed = lambda vote: sorted({re.sub(r"[^a-z0-9]", "", w.lower()) for w in words.get((kind, vote), ())} - {""})
    near = f"split(lower(substr(text, greatest(x.start - {NEAR - 1}, 1), x.end - greatest(x.start - {NEAR}, 0) + {NEAR})), '[^a-z0-9]+')"
    has = lambda vote: f"arrays_overlap(near, array({', '.join(repr(w) for w in listed(vote))}))" if listed(vote) else "false"
    return _let("near", near, f"case when {has(-1)} then -1 when {has(1)} then 1 else 0 end")


def _candidates(df: DataFrame, words: dict[tuple[str, int], list[str]]) -> DataFrame:
    """df with base spans -> cands: array of candidates apart from base spans, each with its votes and classes."""
    df = _located(df, ADDED)
    df = df.withColumns({"base": F.concat(*[F.transform(f"s_{k}", lambda x: F.struct(x["start"], x["end"])) for k in BASE])})
    free = "not exists(taken, b -> b.start < x.end and x.start < b.end)"
    parts = []
    for k in ADDED:
        share = "length(regexp_replace(x.match, '[^0-9]', '')) / length(x.match)"
        before = "substr(text, greatest(x.start - 29, 1), least(x.start, 30))"
        parts.append(
            f"""transform(filter(s_{k}, x -> {free}), x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end,
            'v_shape', if(x.match rlike r'{_STRICT[k]}', 1, -1),
            'v_gazetteer', {_looked_up(k, words)},
            'v_context', case when {before} rlike r'{_CUES}[^0-9A-Za-z]{{0,4}}(?:is|was|no|nr)?[^0-9A-Za-z]{{0,4}}$' then 1 when {before} rlike r'[0-9]\\x20?$' then -1 else 0 end,
            'v_mix', case when x.match rlike '[0-9]' and x.match rlike '[A-Za-z]' then 1 when '{k}' = 'number' and {share} > 0.6 then 1 when {share} = 0 then -1 else 0 end,
            'long', least(length(x.match) div 8, 5), 'digits', cast(floor({share} * 4) as int)))"""
        )
    return df.withColumns({"cands": F.expr(_let("taken", "base", f"concat({', '.join(parts)})"))})


def reliabilities(patterns: list[tuple], rounds: int = 50) -> tuple[dict, np.ndarray]:
    """Expectation-maximisation over counted vote patterns.

    patterns: (kind, votes, count). Returns per kind the prior and the vote probabilities [labeler, class, vote + 1],
    and the posterior of each pattern.
    """
    kinds = sorted({p[0] for p in patterns})
    post = np.zeros(len(patterns))
    model = {}
    for kind in kinds:
        at = [i for i, p in enumerate(patterns) if p[0] == kind]
        votes = np.array([patterns[i][1] for i in at]) + 1
        count = np.array([patterns[i][2] for i in at], float)
        q = 1 / (1 + np.exp(-(votes - 1).sum(axis=1).astype(float)))  # begins with the majority
        for _ in range(rounds):
            prior = (count @ q + 1) / (count.sum() + 2)
            theta = np.ones((votes.shape[1], 2, 3)) * 0.5
            # a labeler is taken to be better than chance: a vote for its own class has a pseudo-count more
            theta[:, 0, 0] += 1
            theta[:, 1, 2] += 1
            for j in range(votes.shape[1]):
                for v in range(3):
                    on = votes[:, j] == v
                    theta[j, 1, v] += count[on] @ q[on]
                    theta[j, 0, v] += count[on] @ (1 - q[on])
            theta /= theta.sum(axis=2, keepdims=True)
            score = math.log(prior) - math.log(1 - prior) + sum(np.log(theta[j, 1, votes[:, j]]) - np.log(theta[j, 0, votes[:, j]]) for j in range(votes.shape[1]))
            q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        post[at] = q
        model[kind] = (prior, theta)
    return model, post


def _features(kind: str, votes: tuple, long: int, digits: int) -> np.ndarray:
    x = [1.0, *(float(kind == k) for k in ADDED)]
    for v in votes:
        x += [float(v == 1), float(v == -1)]
    return np.array([*x, long / 5, digits / 4])


def train(votes: DataFrame, rounds: int = 200) -> np.ndarray:
    """Weights of the span classifier from the votes' counts (kind, VOTES, long, digits, count)."""
    rows = votes.collect()  # at most 3 kinds x 81 vote patterns x 6 lengths x 5 digit shares
    if not rows:
        return np.zeros(len(_features(ADDED[0], (0,) * len(VOTES), 0, 0)))
    rows.sort(key=lambda r: tuple(map(str, r)))
    _, post = reliabilities([(r["kind"], tuple(r[v] for v in VOTES), r["n"]) for r in rows])
    x = np.array([_features(r["kind"], tuple(r[v] for v in VOTES), r["long"], r["digits"]) for r in rows])
    n = np.array([r["n"] for r in rows], float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps of a ridge logistic regression on soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - post)) + 1e-3 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _accepted(w: np.ndarray) -> str:
    terms = [repr(float(w[0]))] + [f"if(x.kind = '{k}', {float(w[1 + i])!r}D, 0D)" for i, k in enumerate(ADDED)]
    for j, v in enumerate(VOTES):
        yes, no = float(w[1 + len(ADDED) + 2 * j]), float(w[2 + len(ADDED) + 2 * j])
        terms.append(f"case x.{v} when 1 then {yes!r}D when -1 then {no!r}D else 0D end")
    terms += [f"{float(w[-2])!r}D * x.long / 5D", f"{float(w[-1])!r}D * x.digits / 4D"]
    limit = math.log(ACCEPT / (1 - ACCEPT))
    return f"{' + '.join(terms)} > {limit!r}D"


def spans(df: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Adds to df(text, ...) `base` and `added`: arrays of struct<kind, start, end>, by kind as listed, then start.

    A null text counts as empty. The training pass reads texts alone. gazetteer: see gazetteer_words().
    """
    words = gazetteer_words(gazetteer)
    df = df.withColumns({"text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    train_on = _candidates(base_spans(df.select("text")), words)
    votes = train_on.select(F.explode("cands").alias("c")).select("c.*").groupBy("kind", *VOTES, "long", "digits").agg(F.count("*").alias("n"))
    w = train(votes)
    out = _candidates(base_spans(df), words).withColumns({"cands": F.expr(f"filter(cands, x -> {_accepted(w)})") if w.any() else F.expr("filter(cands, x -> false)")})
    tag = lambda k: F.transform(f"s_{k}", lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    added = F.transform("cands", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.withColumns({"base": F.concat(*map(tag, BASE)), "added": added})


def _joined(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def private_data(docs: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs (doc_id, text).

    A null text counts as empty: no spans, and the digest of an empty list. Rows are read one by one, so equal rows and
    rows with a null or repeated doc_id have equal results of their own. An empty table gives an empty one: the span
    classifier then accepts nothing. Other columns are ignored, whatever their names.
    """
    found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), gazetteer)
    counts = [F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("concat(base, added)").alias("spans"))


def redacted(docs: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; of overlapping spans the first one names them.

    Other columns stay; n_chars, where there is one, becomes the new text's length. A null text stays null.
    """
    names = docs.columns
    held = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_rest"), F.col("text").isNull().alias("_null"))
    found = spans(held, gazetteer).withColumns({"all": F.expr("array_sort(transform(concat(base, added), x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))")})
    cut = """aggregate(all, named_struct('at', 0, 'parts', cast(array() as array<string>)), (a, x) -> named_struct(
        'at', greatest(a.at, x.end),
        'parts', if(x.start < a.at, a.parts, concat(a.parts, array(substr(text, a.at + 1, x.start - a.at), concat('[', upper(x.kind), ']'))))),
        a -> concat(array_join(a.parts, ''), substr(text, a.at + 1)))"""
    found = found.withColumns({"text": F.when(F.col("_null"), F.lit(None).cast("string")).when(F.size("all") == 0, F.col("text")).otherwise(F.expr(cut))})
    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("_null"), F.col("_rest.n_chars")).otherwise(F.length("text").cast(docs.schema[c].dataType)).alias(c)
        return F.col(f"_rest.`{c}`").alias(c)

    return found.select(*map(column, names))
