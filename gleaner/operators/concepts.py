"""Declared concepts: their types and schemas, grouping of configuration rows, extraction tasks, validation, usage."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.prose import token_count
from gleaner.functions.values import flag, stripped
from gleaner.functions.vectors import let

# Configuration columns, markers and words that mean nothing, and default aspects.
CONFIG_COLUMNS = ("name", "description", "aspect", "by_scenario", "structure_title", "structure_data_type")
NOTHING = ("", "nan", "none")
MARKERS = ("DEFAULT:", "ASPECT:")
DEFAULT_ASPECTS = (("Methods", "Methods of the study"), ("Results", "Results of the study"), ("Methods_Results", "Joined Methods and Results of the study"))
SCENARIO_LITERAL = "Literal:scenarios"

_SIMPLE = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "dict": T.MapType(T.StringType(), T.StringType()), "list": T.ArrayType(T.StringType())}


def parsed_type(text: str, strict: bool = True) -> T.DataType:
    """The type that a declaration such as `Optional[List[float]]`, `dict[str, str]` or `str | None` stands for.

    Every value can be null, so optional and plain types are the same. An unknown word is an error; unless strict, it
    and all else that is not a declaration is text.
    """
    if not strict:
        try:
            return parsed_type(text)
        except ValueError:
            inner = re.fullmatch(r"\s*(?:List|list)\[(.*)\]\s*(?:\|\s*None\s*)?", text)
            return T.ArrayType(parsed_type(inner[1], strict=False)) if inner else T.StringType()
    tokens = re.findall(r"Literal:scenarios|\w+|[\[\],|]", text)
    if "".join(tokens) != re.sub(r"\s", "", text):
        raise ValueError(f"not a type: {text!r}")
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take(wanted: str | None = None) -> str:
        nonlocal at
        found = peek()
        if found is None or wanted not in (None, found):
            raise ValueError(f"not a type: {text!r}")
        at += 1
        return found

    def alternatives() -> T.DataType | None:
        found = [single()]
        while peek() == "|":
            take("|")
            found.append(single())
        real = [t for t in found if t is not None]
        if len(real) > 1:
            raise ValueError(f"more than one type besides None: {text!r}")
        return real[0] if real else None

    def inner() -> list[T.DataType]:
        take("[")
        found = [alternatives()]
        while peek() == ",":
            take(",")
            found.append(alternatives())
        take("]")
        if None in found:
            raise ValueError(f"None alone is not a type: {text!r}")
        return found

    def single() -> T.DataType | None:
        word = take()
        if word == "None":
            return None
        if word == SCENARIO_LITERAL:
            return T.StringType()
        if peek() != "[":
            if word.lower() not in _SIMPLE:
                raise ValueError(f"unknown type {word!r} in {text!r}")
            return _SIMPLE[word.lower()]
        parts = inner()
        match word.lower(), parts:
            case "optional", [one]:
                return one
            case "list", [one]:
                return T.ArrayType(one)
            case "dict", [key, value]:
                return T.MapType(key, value)
        raise ValueError(f"unknown type {word!r} in {text!r}")

    out = alternatives()
    if at != len(tokens) or out is None:
        raise ValueError(f"not a type: {text!r}")
    return out


def structure_schema(structure: dict) -> T.StructType:
    """A concept's structure as a schema; a list of objects (`items: [{...}]`) is an array of structs."""
    def kind(v) -> T.DataType:
        return T.ArrayType(structure_schema(reduce(lambda a, b: a | b, v, {}))) if isinstance(v, list) else structure_schema(v) if isinstance(v, dict) else parsed_type(v)

    return T.StructType([T.StructField(name, kind(v)) for name, v in structure.items()])


def _named(rows: DataFrame) -> DataFrame:
    clean = rows.select("pos", *[stripped(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in CONFIG_COLUMNS])
    return clean.where(~F.lower("name").isin(*NOTHING))


def configured_aspects(rows: DataFrame) -> DataFrame:
    """pos, name, description of the aspects that rows name, in order of first mention, or the default ones."""
    named = _named(rows).where(~F.lower("aspect").isin(*NOTHING))
    found = named.groupBy(F.col("aspect").alias("name")).agg(F.min("pos").cast("long").alias("pos")).select("pos", "name", F.col("name").alias("description"))
    defaults = rows.sparkSession.createDataFrame([(i, *a) for i, a in enumerate(DEFAULT_ASPECTS)], "pos long, name string, description string")
    return found.unionByName(defaults.join(found.limit(1).select(F.lit(1).alias("one")), F.lit(True), "left_anti"))


def grouped_concepts(rows: DataFrame, check: bool = True) -> DataFrame:
    """pos, name, description, aspect, by_scenario, structure (array of field, type in order) of each concept.

    rows: pos and CONFIG_COLUMNS. Rows without a name and marker rows are passed over, a field without a title too; of
    a title that comes twice the last type stays, at the first place. With check, a concept whose rows disagree or that
    has no field is an error when it is read; without, the column `problem` says so.
    """
    kept = _named(rows).where(~reduce(lambda a, b: a | b, [F.startswith("name", F.lit(m)) for m in MARKERS])).withColumn("by_scenario", flag("by_scenario"))
    titled = F.when(~F.lower("structure_title").isin(*NOTHING), F.struct("pos", F.col("structure_title").alias("field"), F.col("structure_data_type").alias("type")))
    out = kept.groupBy("name").agg(
        F.min("pos").cast("long").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in ("description", "aspect", "by_scenario")],
        *[F.count_distinct(c).alias(f"_{c}") for c in ("description", "aspect", "by_scenario")], F.array_sort(F.collect_list(titled)).alias("_all"),
    )
    fields = F.array_distinct(F.transform("_all", lambda x: x["field"]))
    last = lambda f: F.element_at(F.filter("_all", lambda x: x["field"] == f), F.lit(-1))["type"]
    problem = F.coalesce(*[F.when(F.col(f"_{c}") > 1, F.concat(F.lit(f"inconsistent {c} for concept "), "name")) for c in ("description", "aspect", "by_scenario")], F.when(F.size("_all") == 0, F.concat(F.lit("no structure field for concept "), "name")))
    shaped = out.select("pos", "name", "description", "aspect", "by_scenario", F.transform(fields, lambda f: F.struct(f.alias("field"), last(f).alias("type"))).alias("structure"), problem.alias("problem"))
    return shaped.withColumn("name", F.when(F.col("problem").isNull(), F.col("name")).otherwise(F.raise_error(F.col("problem")))).drop("problem") if check else shaped


def with_defaults(concepts: DataFrame, defaults: dict) -> DataFrame:
    """Attributes that a concept leaves out come from the defaults; by_scenario must come from one of them."""
    if defaults.get("by_scenario") is None and not concepts.where("by_scenario is null").isEmpty():
        raise ValueError("by_scenario needs a default")
    for name, value in defaults.items():
        concepts = concepts.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in concepts.columns else F.lit(value))
    return concepts


#: Concepts that a configuration may have, as every task holds them.
MOST_CONCEPTS = 10_000


def configured(concepts: DataFrame) -> list[Row]:
    """concepts as rows, for what every task holds."""
    rows = concepts.limit(MOST_CONCEPTS + 1).collect()
    if len(rows) > MOST_CONCEPTS:
        raise ValueError(f"a configuration has {MOST_CONCEPTS} concepts at most")
    return rows


def _configuration(concepts: DataFrame) -> DataFrame:
    """concepts, to be broadcast once their number is checked."""
    if concepts.limit(MOST_CONCEPTS + 1).count() > MOST_CONCEPTS:
        raise ValueError(f"a configuration has {MOST_CONCEPTS} concepts at most")
    return F.broadcast(concepts)


def extraction_tasks(documents: DataFrame, scenarios: DataFrame, concepts: DataFrame, sections: DataFrame) -> DataFrame:
    """One row per call: pid, scenario_idx, scenario, concept_pos, concept, description, structure, text.

    documents: pid, text; scenarios: pid, scenario_idx, scenario; concepts: pos, name, description, aspect,
    by_scenario, structure (a configuration of MOST_CONCEPTS at most, broadcast); sections: pid, section, section_text.
    Concepts that do not go by scenario are asked once (scenario null), the others for each scenario. The text is the
    section that the aspect names, or the whole text where there is none.
    """
    few = _configuration(concepts.select(F.col("pos").alias("concept_pos"), F.col("name").alias("concept"), "description", "aspect", "by_scenario", "structure"))
    none = F.lit(None)
    once = documents.select("pid").crossJoin(few.where(~F.col("by_scenario"))).select("pid", none.cast("int").alias("scenario_idx"), none.cast("string").alias("scenario"), "concept_pos", "concept", "description", "structure", "aspect")
    each = scenarios.select("pid", F.col("scenario_idx").cast("int").alias("scenario_idx"), "scenario").crossJoin(few.where("by_scenario"))
    each = each.select("pid", "scenario_idx", "scenario", "concept_pos", "concept", F.concat("description", F.lit(" - for scenario '"), "scenario", F.lit("'")).alias("description"), "structure", "aspect")
    texts = documents.join(sections.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("section", "section_text"))).alias("of")), "pid", "left")
    # the calls of a task are held, as texts are far longer: those pass by and are not sorted
    tasks = texts.join(once.unionByName(each).hint("shuffle_hash"), "pid")
    return tasks.select("pid", "scenario_idx", "scenario", "concept_pos", "concept", "description", "structure", F.coalesce(F.try_element_at("of", F.col("aspect")), "text").alias("text"))


def assembled(scenarios: Column, answers: Column) -> Column:
    """A paper's results, one per scenario: the concepts asked once first, then the scenario, then its own concepts.

    scenarios: array of scenario_idx, scenario, description; answers: array of scenario_idx (null: asked once), concept,
    content (JSON text), in the concepts' order. All of it stands in the paper's row, as its result document does.
    """
    said = lambda mine: F.transform(F.filter(answers, mine), lambda x: F.create_map(x["concept"], x["content"]))
    head = lambda s: F.array(F.create_map(F.lit("Scenario"), F.to_json(F.struct(s["scenario"].alias("Scenario Name"), s["description"].alias("scenario_description")))))
    own = lambda s: said(lambda x: x["scenario_idx"] == s["scenario_idx"])
    return let(said(lambda x: x["scenario_idx"].isNull()), lambda once: F.transform(scenarios, lambda s: F.struct(F.concat(once, head(s), own(s)).alias("concepts"))))


def by_aspect(concepts: DataFrame) -> DataFrame:
    """aspect, by_scenario, concepts (names in order): what each aspect is asked, once and for each scenario.

    A concept without an aspect stands under a null one.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return concepts.groupBy("aspect", "by_scenario").agg(ordered.alias("concepts"))


def assigned_to_aspects(concepts: DataFrame, aspects: DataFrame) -> DataFrame:
    """The concepts whose aspect is one of aspects (name). It is an error if no aspect has any, and if one has none."""
    kept = concepts.join(aspects.select(F.col("name").alias("aspect")).distinct(), "aspect", "left_semi").select(*concepts.columns)
    bare = [r.name for r in aspects.join(kept.select(F.col("aspect").alias("name")).distinct(), "name", "left_anti").select("name").distinct().collect()]  # a configuration's aspects
    if bare:
        raise ValueError(f"no concepts for aspects {sorted(bare)}")
    return kept


def under_scenarios(concepts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """pid, concept_pos, concept, description, aspect, structure as map<scenario, fields> of each paper's concepts.

    {concept: fields} becomes {concept: {scenario: fields}}, so one call answers for all scenarios of the paper
    (pid, scenario_idx, scenario); flatten.by_scenario() undoes it. concepts are a configuration and broadcast.
    """
    names = F.transform(F.array_sort(F.collect_list(F.struct("scenario_idx", "scenario"))), lambda x: x["scenario"])
    listed = scenarios.groupBy("pid").agg(F.array_distinct(names).alias("_names"))
    few = _configuration(concepts.select(F.col("pos").alias("concept_pos"), F.col("name").alias("concept"), "description", "aspect", F.col("structure").alias("_fields")))
    nested = F.map_from_arrays("_names", F.transform("_names", lambda _: F.col("_fields")))
    return listed.crossJoin(few).select("pid", "concept_pos", "concept", "description", "aspect", nested.alias("structure"))


def outside_scenarios(values: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Rows of values (pid, scenario, ...) whose scenario the paper does not have: what a constrained schema rejects."""
    return values.join(scenarios.select("pid", "scenario").distinct(), ["pid", "scenario"], "left_anti")


def has_every_scenario(found: Column, scenarios: Column) -> Column:
    """Whether a list names each scenario once and nothing else."""
    return (F.size(found) == F.size(scenarios)) & (F.size(F.array_except(scenarios, found)) == 0)


def step_tokens(calls: DataFrame, count: Callable[[Column], Column] = token_count) -> DataFrame:
    """pid, step, tokens: the tokens of all that a step's calls said (pid, step, call), counted again from the call log.

    A step without calls has no row; a null call has no tokens. Each step counts its own calls, so nothing is reset.
    """
    return calls.groupBy("pid", "step").agg(F.sum(F.coalesce(count(F.col("call")), F.lit(0))).cast("long").alias("tokens"))


def token_usage(calls: DataFrame) -> DataFrame:
    """pid, scope, prompt_tokens, completion_tokens, total_tokens: sums of a paper's calls by scenario.

    calls: pid, scenario (null: asked once, scope `aspect_tokens`), prompt_tokens, completion_tokens. A failed call
    has null usage, which counts as 0. The scope `total` has everything; one pass gives both levels.
    """
    parts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("prompt_tokens", "completion_tokens")}
    rows = calls.select("pid", F.coalesce("scenario", F.lit("aspect_tokens")).alias("scope"), *[v.alias(c) for c, v in parts.items()])
    sums = rows.groupingSets([["pid", "scope"], ["pid"]], "pid", "scope").agg(*[F.sum(c).alias(c) for c in parts], F.grouping("scope").alias("_all"))
    return sums.select("pid", F.when(F.col("_all") == 1, "total").otherwise(F.col("scope")).alias("scope"), *parts, (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))
