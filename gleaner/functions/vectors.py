"""Vectors as arrays: products, cosines, and a text embedding made of built-in functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64
EMBEDDING_TYPE = "array<double>"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body uses it within a loop."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), F.lit(1))


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A unit vector of signed, hashed three-letter grams of the lower-cased text; the zero vector for no text.

    The offline stand-in for an encoder model: it stays in the JVM, and equal texts have equal vectors everywhere.
    """
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.xxhash64(F.substr(low, i, F.lit(3))))
    # grams are dealt into groups of dimensions first: each is looked at twice the root of dimensions times, not dimensions times
    wide = math.isqrt(dimensions - 1) + 1
    own = lambda g: F.transform(g, lambda h: (F.pmod(h, F.lit(dimensions)) + 1) * F.signum(h).cast("int"))  # noqa: E731, a place from 1 and a sign
    some = lambda g, b: F.filter(g, lambda x: (F.abs(x) > b * wide) & (F.abs(x) <= (b + 1) * wide))
    each = lambda xs, b: F.transform(F.sequence(b * wide + 1, F.least((b + 1) * wide, F.lit(dimensions))), lambda d: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.when(F.abs(x) == d, F.signum(x)).otherwise(0.0)))
    counts = lambda g: let(own(g), lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.lit((dimensions - 1) // wide)), lambda b: let(some(c, b), lambda xs: each(xs, b)))))
    unit = lambda raw: let(norm(raw), lambda n: F.transform(raw, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))
    return F.when(F.length(low) > 2, let(grams, lambda g: let(counts(g), unit))).otherwise(F.array_repeat(F.lit(0.0), dimensions))


# English words that carry no meaning of their own, and the ampersand.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't
mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't &
"""


def stop_words() -> tuple[str, ...]:
    return tuple(STOP_WORDS.split())


def text_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def variants(text: Column) -> Column:
    """The whole text, then its distinct words without stop words."""
    return F.concat(F.array(text), F.array_except(text_words(text), F.array(*map(F.lit, stop_words()))))


def fuzzy_of(whole: Column, a: Column, b: Column) -> Column:
    """The mean of the cosine of the whole texts and the best one of all variants' vectors a and b."""
    best = let(b, lambda ys: F.array_max(F.flatten(F.transform(a, lambda x: F.transform(ys, lambda y: cosine(x, y))))))
    return (best + whole) / 2


def text_similarity(a: Column, b: Column, embed: Callable[[Column], Column] = hashed_embedding, fuzzy: bool = False) -> Column:
    """The cosine of two texts, or with `fuzzy` their fuzzy cosine, and the plain one where that is null; 0 without vectors."""
    plain = F.coalesce(cosine(embed(a), embed(b)), F.lit(0.0))
    return F.coalesce(fuzzy_cosine(a, b, embed), plain) if fuzzy else plain


def both_single(a: Column, b: Column) -> Column:
    return (F.size(text_words(a)) == 1) & (F.size(text_words(b)) == 1)


def fuzzy_cosine(a: Column, b: Column, embed: Callable[[Column], Column] = hashed_embedding) -> Column:
    """How alike two texts are by their closest parts and as a whole; null for two single words."""
    return F.when(~both_single(a, b), fuzzy_of(cosine(embed(a), embed(b)), F.transform(variants(a), lambda w: embed(w)), F.transform(variants(b), lambda w: embed(w))))
