import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm.tokens import Encoder, spliced_count, token_counts

SCHEMA = "doc_id long, text string, n_tokens string"
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts(seed=7):
    rng = random.Random(seed)
    chars = "abcdefghijklmnop   \n\t.,!'’éÉßΣςñ́ẛ̣漢字🙂0123456789<|>\x00\x1c\x85\xa0 "
    made = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 400))) for _ in range(200)]
    made += ["don't they'll <|endoftext|>a<|startoftext|> x", "A" * 3000, " " * 500, "ab" * 40_000, "word " * 20_000, "", "́ ́"]
    made += ["".join(rng.choice(["the ", "Of", " and", "é", ".\n", "12", "'s ", "<|endoftext|>"]) for _ in range(30_000))]
    return made


@pytest.mark.parametrize("name", NAMES)
def test_counts_as_the_library_does(spark, name):
    path = public_tokenizers.path(name)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, None), (3, "again", ""), (3, "again", "")]
    t = Tokenizer.from_file(path)
    want = sorted(((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 2048) for d, x, _ in rows), key=repr)
    got = token_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert token_counts(spark.createDataFrame([], SCHEMA), path).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_small_chunks_splice_exactly(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        encoder = Encoder(f.read())
    assert encoder.by_word == (name == NAMES[0])
    for text in [x for x in texts(8) if len(x) < 9000]:
        whole = sum(w for *_, w in encoder.units(text))
        for chunk, overlap in ((300, 130), (700, 200)):
            assert spliced_count(encoder.units, text * 3, chunk, overlap, 2) == sum(w for *_, w in encoder.units(text * 3)), (text[:50], whole)
