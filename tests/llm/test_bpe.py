import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraloom.llm.bpe import TOKENIZER, Encoder, encode_texts, load_merges

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file here")
TEXTS = ["", "  ", "Hello world, it's 2024!", "a" * 3000, "ab" * 500, "<|endoftext|> is text", "Grüße aus Köln — 100 µL\r\n\t x", "日本語 👩🏽‍🔬", "aaaabaaa aaa", "\n\n\n  end  "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load_merges())


def test_same_ids_as_the_library(encoder, library):
    ids, sizes = encoder.encode([None, *TEXTS])
    assert sizes[0] == 0
    at = 0
    for text, n in zip(TEXTS, sizes[1:]):
        assert ids[at : at + n].tolist() == library(text), text
        at += n


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode([text])[0].tolist() == library(text)


def test_table(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, *TEXTS, TEXTS[2]])], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_texts(df, "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == [] and got[3] == library(TEXTS[2]) == got[len(TEXTS) + 1]
    counts = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in encode_texts(df, "doc_id", "text", counts_only=True, keep=("ids",)).collect()}
    assert counts[4] == (len(library(TEXTS[3])), "x") and counts[0][0] == 0
    assert encode_texts(df.where("false"), "doc_id", "text").count() == 0
