"""Texts measured and cut by the tokens of an encoding (a tokenizer's .json file), in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.prose import MOST_TOKENS


@cache
def _encoding(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def encoded_count(text: Column, path: str) -> Column:
    """The tokens of a text, without special ones; null for a null text. The file must be there on every executor."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if t is None else len(_encoding(path).encode(t, add_special_tokens=False).ids) for t in part], dtype="Int64")

    return count(text)


def first_encoded(text: Column, path: str, most: int = MOST_TOKENS) -> Column:
    """The text up to the end of its `most`-th token; a text of so many tokens or fewer stays as it is."""

    @F.pandas_udf("string")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for t in part:
                ends = [] if t is None or len(t.encode()) <= most else _encoding(path).encode(t, add_special_tokens=False).offsets
                out.append(t if len(ends) <= most else t[: ends[most - 1][1]] if most else "")
            yield pd.Series(out, dtype="object")

    return cut(text)
