"""What models do, behind small interfaces, and stand-ins that need none.

An extractor gets the calls of papers on an executor and must give the same answer for the same call, as tasks may be run
again. Embedders, scorers and judges are Column functions, so the stand-ins stay in the JVM and a model can be a UDF.
"""

from __future__ import annotations

import functools
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from gleaner.functions.vectors import hashed_embedding
from gleaner.operators.ranking import overlap

# Attempts and seconds between them.
ATTEMPTS, FIRST_DELAY, LONGEST_DELAY = 6, 1.0, 20.0
SLOW_ATTEMPTS, SLOW_DELAY = 8, 5.0

EMBEDDER: Callable[[Column], Column] = hashed_embedding
SCORER: Callable[[Column, Column], Column] = overlap


class Call(NamedTuple):
    text: str
    concept: str
    description: str
    fields: list[str]
    scenario: str | None


class Answer(NamedTuple):
    values: dict[str, object]
    prompt_tokens: int
    completion_tokens: int


class Extractor(Protocol):
    def extract(self, call: Call) -> Answer: ...

    def scenarios(self, text: str) -> list[tuple[str, str | None]]: ...


@functools.lru_cache(1024)
def _line_of(field: str) -> re.Pattern:
    return re.compile(rf"(?im)^[ \t]*{re.escape(field)}[ \t]*(?::|\bis\b)[ \t]*(\S[^\n]*)$")


class RuleExtractor:
    """Reads `field: value` lines, and `Scenario: name` lines as scenarios; a text without any has one, `main`."""

    def extract(self, call: Call) -> Answer:
        found: dict[str, object] = {}
        for field in call.fields:
            m = _line_of(field).search(call.text)
            found[field] = m[1].strip() if m else None
        return Answer(found, len(call.text.split()), sum(v is not None for v in found.values()))

    def scenarios(self, text: str) -> list[tuple[str, str | None]]:
        named = re.findall(r"(?im)^[ \t]*scenario[ \t]*:[ \t]*(\S[^\n]*)$", text)
        return [(n.strip(), None) for n in dict.fromkeys(named)] or [("main", None)]


class Fallback:
    """A group of extractors: the first one that answers is taken; if none does, the last one's fault is raised.

    `scenarios_by` names the one that reasons about scenarios (the first), so that a larger model can find them and a
    smaller one fill in the fields.
    """

    def __init__(self, *extractors: Extractor, scenarios_by: Extractor | None = None) -> None:
        if not extractors:
            raise ValueError("a group needs an extractor")
        self.extractors, self.reasoner = extractors, scenarios_by

    def _first(self, ask: Callable[[Extractor], object], among: tuple[Extractor, ...]):
        for extractor in among[:-1]:
            try:
                return ask(extractor)
            except Exception:  # noqa: S112, the next one is asked
                continue
        return ask(among[-1])

    def extract(self, call: Call) -> Answer:
        return self._first(lambda e: e.extract(call), self.extractors)

    def scenarios(self, text: str) -> list[tuple[str, str | None]]:
        return self._first(lambda e: e.scenarios(text), (self.reasoner, *self.extractors) if self.reasoner else self.extractors)


def slow_delay(attempt: int, jitter: float) -> float:
    """Seconds before the next attempt of the slower backend: doubled each time without a limit, and up to half more."""
    return SLOW_DELAY * 2**attempt * (1 + jitter / 2)


def delay(attempt: int, jitter: float) -> float:
    """Seconds before the next attempt: doubled each time up to a limit, times 0.7 to 1.3."""
    return min(LONGEST_DELAY, FIRST_DELAY * 2**attempt) * (0.7 + 0.6 * jitter)


def with_retries(call: Callable[[], Answer], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, wait: Callable[[int, float], float] = delay) -> Answer:
    for attempt in range(attempts):
        try:
            return call()
        except Exception:
            if attempt == attempts - 1:
                raise
            sleep(wait(attempt, random.random()))
    raise ValueError("attempts must be positive")


_ANSWER = pa.struct([("scenario_idx", pa.int32()), ("scenario", pa.string()), ("concept_pos", pa.int64()), ("concept", pa.string()), ("content", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("error", pa.string())])
_SCENARIO = pa.struct([("scenario_idx", pa.int32()), ("scenario", pa.string()), ("description", pa.string())])
_ASKED = pa.schema([("pid", pa.string()), ("path", pa.string()), ("error", pa.string()), ("scenarios", pa.list_(_SCENARIO)), ("answers", pa.list_(_ANSWER)), ("tokens", pa.map_(pa.string(), pa.string()))])
#: Papers whose answers a task gathers before it hands them on.
PAPERS_AT_ONCE = 512


def _tokens(answers: list[tuple]) -> list[tuple[str, str]] | None:
    """What concepts.token_usage() says of one paper's answers, by scope, as its result document has it."""
    sums: dict[str, list[int]] = {}
    for _, scenario, _, _, _, prompt, completion, _ in answers:
        own = sums.setdefault("aspect_tokens" if scenario is None else scenario, [0, 0])
        own[0], own[1] = own[0] + (prompt or 0), own[1] + (completion or 0)
    total = sum(p + q for p, q in sums.values())
    told = {s: f'{{"prompt_tokens":{p},"completion_tokens":{q},"total_tokens":{p + q}}}' for s, (p, q) in sums.items()}
    return sorted((told | {"total": str(total)}).items()) if answers else None


def asked(papers: DataFrame, concepts: list[Row], extractor: Extractor, at_once: bool = False, attempts: int = ATTEMPTS) -> DataFrame:
    """pid, path, error, scenarios, answers, tokens: each paper's scenarios and all its calls, asked where its text stands.

    papers: pid, path, text, error, of (map<section, text>, or null). concepts: pos, name, description, aspect,
    by_scenario, structure. The texts go to Python once, whatever the number of calls, and no rows move.

    Concepts that do not go by scenario are asked once (scenario_idx and scenario null), the others for each scenario, or
    with at_once in one go for all of them, whose usage stands with the first and whose fault is that of all. A call's
    text is the section that its aspect names, or the whole text. A call that fails in all attempts has all its fields
    null, no usage and an error; it fails nothing else. error: of a paper with an error, without text or scenarios.
    """
    loose, tight = json.JSONEncoder(ensure_ascii=False).encode, json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
    concepts = sorted((c.pos, c.name, c.description, c.aspect, c.by_scenario, [f["field"] for f in c.structure]) for c in concepts)

    def ask(text: str, concept: str, description: str | None, fields: list[str], scenario: str | None) -> Answer:
        return with_retries(lambda: extractor.extract(Call(text, concept, description, fields, scenario)), attempts)

    def one(idx: int | None, scenario: str | None, text: str, pos: int, name: str, description: str | None, fields: list[str]) -> tuple:
        try:
            a = ask(text, name, description, fields, scenario)
            return (idx, scenario, pos, name, loose(a.values), a.prompt_tokens, a.completion_tokens, None)
        except Exception as e:
            return (idx, scenario, pos, name, loose(dict.fromkeys(fields)), None, None, f"{type(e).__name__}: {e}")

    def together(scenarios: list[tuple], text: str, pos: int, name: str, description: str | None, fields: list[str]) -> list[tuple]:
        first = {s: i for i, s, _ in reversed(scenarios)}
        names, error = list(dict.fromkeys(s for _, s, _ in scenarios)), None
        try:
            found = [ask(text, name, description, fields, s) for s in names]
            said = [tight(a.values) for a in found]
            used = (sum(a.prompt_tokens for a in found), sum(a.completion_tokens for a in found))
        except Exception as e:
            said, used, error = [tight(dict.fromkeys(fields))] * len(names), (None, None), f"{type(e).__name__}: {e}"
        return [(first[s], s, pos, name, content, *(used if n == 0 else (None, None)), error) for n, (s, content) in enumerate(zip(names, said, strict=True))]

    def answers(scenarios: list[tuple], whole: str, of: dict[str, str | None]) -> list[tuple]:
        rows: list[tuple] = []
        for pos, name, description, aspect, by_scenario, fields in concepts:
            section = of.get(aspect)
            text = whole if section is None else section
            if by_scenario is False:
                rows.append(one(None, None, text, pos, name, description, fields))
            elif by_scenario and at_once:
                rows += together(scenarios, text, pos, name, description, fields)
            elif by_scenario:
                rows += [one(i, s, text, pos, name, None if description is None or s is None else f"{description} - for scenario '{s}'", fields) for i, s, _ in scenarios]
        return rows

    def told(pid: str, path: str, text: str | None, error: str | None, of: list[tuple] | None) -> tuple:
        if error is not None or text is None:
            return (pid, path, "no text" if error is None else error, None, None, None)
        try:
            scenarios = [(i, n, d) for i, (n, d) in enumerate(extractor.scenarios(text))]
        except Exception:  # the paper is reported as one without scenarios
            scenarios = []
        if not scenarios:
            return (pid, path, "no scenarios found", None, None, None)
        found = answers(scenarios, text, dict(of or ()))
        return (pid, path, None, scenarios, found, _tokens(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAPERS_AT_ONCE):
                columns = [c.to_pylist() for c in batch.slice(at, PAPERS_AT_ONCE).columns]
                rows = zip(*(told(*paper) for paper in zip(*columns, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ASKED, strict=True)], schema=_ASKED)

    strings = [F.col(c).cast("string").alias(c) for c in ("pid", "path", "text", "error")]
    return papers.select(*strings, "of").mapInArrow(run, from_arrow_schema(_ASKED))


def embedded(values: DataFrame, embedder: Callable[[Column], Column] = EMBEDDER, column: str = "value") -> DataFrame:
    """Distinct values and their vectors v: a model sees each text once."""
    return values.select(column).distinct().withColumn("v", embedder(F.col(column)))
