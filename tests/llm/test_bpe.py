import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexaspan.llm import bpe

if not os.path.exists(bpe.VOCABULARY):
    pytest.skip("no vocabulary", allow_module_level=True)

from tokenizers import Tokenizer

GIVEN = Tokenizer.from_file(bpe.VOCABULARY)
GIVEN.encode_special_tokens = True
CODER = bpe.TextEncoder()
ODD = ["", None, "a  b", "\x1c a \x1f", "   ", "x \x85 y\xa0z", "<|endoftext|> hi", " 'tis I'LL we'll", "aaaaaaaaaaaa", "\n\n\t x", "日本語テキスト 123½²", "👩‍👧", "　a", "a ", " a", "​x", "tab\tx  \n  y", "ab" * 40_000, " " * 30_000, "é" * 3000]


def ids(texts):
    return [np.frombuffer(b, np.int32).tolist() for b in CODER.encode(texts)]


def given_ids(texts):
    return [e.ids for e in GIVEN.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_odd_texts():
    assert ids(ODD) == given_ids(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab '\n\tétheTHE.,1  "), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), max_size=4))
def test_any_text(texts):
    assert ids(texts) == given_ids(texts)


def test_full_tables_are_dropped():
    small = bpe.TextEncoder(keep=3)
    for t in ODD * 2:
        assert np.frombuffer(small.encode([t])[0], np.int32).tolist() == given_ids([t])[0]


def test_operator(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "a b", "x"), (3, "twice", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_texts(df, "doc_id", "text", block_chars=50).collect()
    want = list(zip([r[0] for r in rows], given_ids([r[1] for r in rows])))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0
