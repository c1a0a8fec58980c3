"""Token counts of whole texts with a public tokenizer, huge texts in overlapping chunks that are spliced again.

A text over `chunk` characters is encoded in chunks that overlap. The next chunk takes over at a position where both
encodings begin a unit, where white space meets other characters, and where a run of units on both sides agrees: from
such a place on, pre-tokenisation (a regular expression that keeps no memory) and merges within pre-tokens run alike
in both, so counts before it from the one chunk and after it from the other are the whole text's. If an overlap holds
no such place it is doubled, at last to the whole rest.

When the tokenizer drops white space and no pre-token holds any (read from its own description), a unit is a word
between ASCII white space: words are encoded once per task and looked up again, and a text's count is the sum.
Otherwise a unit is a token.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, AGREE = 32_768, 512, 4
#: Words that a task remembers at once.
MEMORY = 300_000
#: Characters next to a cut that a splice keeps away from.
MARGIN = 64
LIMIT = 2048
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_CLOSED = "[^\\s\\p{L}\\p{N}]+"


def splits_at_space(spec: dict) -> bool:
    """Whether white space is dropped and never part of a pre-token."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    parts = first.get("pattern", {}).get("Regex", "").split("|")
    plain = all(p == _CLOSED or p in ("[\\p{L}]+", "[\\p{N}]", "[\\p{N}]+") or re.fullmatch(r"'[a-z]+", p) for p in parts)
    return plain and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))


Units = list[tuple[int, int, int]]  # start, end, tokens


class Encoder:
    """Counts tokens with a tokenizer of the `tokenizers` library, given as its JSON description."""

    def __init__(self, description: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = splits_at_space(json.loads(description))
        self.known: dict[bytes, int] = {}

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > MEMORY:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.known.update(zip(part, map(len, found), strict=True))

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.by_word:
            return [len(x) for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        split = [t.split() for t in texts]
        words: set[bytes] = set()
        words.update(*split)
        self._learn(words)
        get = self.known.__getitem__
        return [sum(map(get, s)) for s in split]

    def units(self, text: str) -> Units:
        if not self.by_word:
            found = self.tokenizer.encode(text, add_special_tokens=False)
            return [(a, b, 1) for a, b in found.offsets]
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].encode() for a, b in spans]
        self._learn(set(words))
        return [(a, b, self.known[w]) for (a, b), w in zip(spans, words, strict=True)]


def _splice(text: str, one: Units, two: Units, low: int, high: int, agree: int) -> int | None:
    """A position in low..high where the whole text's encoding, known from `one`, is taken over by `two`."""
    at = {u[0]: i for i, u in enumerate(two)}
    for i, (start, _, _) in enumerate(one):
        if not low <= start <= high or start == 0:
            continue
        j = at.get(start)
        if j is None or text[start - 1].isspace() == text[start].isspace():
            continue
        a, b = one[max(0, i - agree) : i + agree], two[max(0, j - agree) : j + agree]
        if i >= agree and j >= agree and len(a) == 2 * agree and a == b and a[0][0] >= low - MARGIN and a[-1][1] <= high + MARGIN:
            return start
    return None


def spliced_count(units: Callable[[str], Units], text: str, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE) -> int:
    """The number of tokens of a whole text, from overlapping chunks."""
    total, begin, taken = 0, 0, 0  # a chunk's start, and from where on its units count
    size = chunk
    while True:
        end = min(len(text), begin + size)
        one = [(a + begin, b + begin, w) for a, b, w in units(text[begin:end])]
        if end == len(text):
            return total + sum(w for a, _, w in one if a >= taken)
        wide, cut = overlap, None
        while cut is None and wide < end - max(begin, taken):
            two = [(a + end - wide, b + end - wide, w) for a, b, w in units(text[end - wide : min(len(text), end + wide)])]
            cut = _splice(text, one, two, max(taken + 1, end - wide + MARGIN), end - MARGIN, agree)
            wide *= 2
        if cut is None:
            size *= 2  # nothing in this chunk aligns: a larger one
            continue
        total += sum(w for a, _, w in one if taken <= a < cut)
        begin, taken, size = end - wide // 2, cut, chunk


def _count(description, limit: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(description.value)
        for batch in batches:
            sizes: list[int] = []
            counts: list[int] = []
            texts = batch.column(1)
            for i in range(0, len(texts), 256):
                part = [(t or "").encode() for t in texts.slice(i, 256).to_pylist()]
                sizes += map(len, part)
                short = [j for j, t in enumerate(part) if len(t) <= chunk]
                found = dict(zip(short, encoder.counts([part[j] for j in short]), strict=True))
                counts += [found[j] if j in found else spliced_count(encoder.units, t.decode(), chunk) for j, t in enumerate(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row of docs.

    docs: doc_id, text; other columns are ignored; tokenizer: path of a description for the `tokenizers` library. A
    null text counts as empty: no tokens. Repeated rows and null ids are counted like any other row.
    """
    with open(tokenizer, encoding="utf-8") as f:
        description = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(description, limit, chunk), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
