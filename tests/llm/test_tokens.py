import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_runs_and_odd_texts(public):
    encode = tokens.encoder(tokens.VOCABULARY).encode
    texts = ["a" * n for n in range(1, 70)] + ["=" * n for n in range(1, 70)] + [" " * n + "x" for n in range(40)]
    texts += ["<|endoftext|>", "\x00\n\t ​", "日本語 éß 𝒳", "don't we'LL", "x" * 20_000, "ab" * 20_000]
    for t in texts:
        assert encode(t) == public(t), t[:50]
    assert encode(None) == encode("") == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(public, text):
    assert tokens.encoder(tokens.VOCABULARY).encode(text) == public(text)


def test_joined_tokens(public):
    rng = random.Random(5)
    words = ["the", "ing", "Ġ", " a", "tion", "ss", "s", "er", "eeee", "000", "lll"]
    for _ in range(2000):
        t = "".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        assert tokens.encoder(tokens.VOCABULARY).encode(t) == public(t)


def test_table(spark, public):
    df = spark.createDataFrame([(1, "some text", 5), (1, "some text", 5), (2, None, 5), (3, "", 5), (4, "word " * 50_000, 5)], "doc_id long, text string, ids int")
    rows = tokens.encode_column(df, "text", ["doc_id"]).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in rows) == sorted([(1, 2), (1, 2), (2, 0), (3, 0), (4, len(public("word " * 50_000)))])
    assert tokens.encode_column(df.limit(0), "text", ["doc_id"]).count() == 0
