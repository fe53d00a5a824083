import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.llm.tokens import VOCABULARY, Encoder, encode_texts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def enc():
    return Encoder(VOCABULARY, piece_chars=16)


_pieces = st.lists(st.sampled_from(["a", "b", "'", "'s", "'re", " ", "  ", "\n", "\t", "1", "23", "!", "!!'", "é", "ß", "日本", "🚀", "the", " thing", "aaaa", "﷽", " ", "I'll"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(text=_pieces)
def test_tree_concatenation_is_exact(enc, text):
    assert enc(text).tolist() == enc._enc.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text(enc, text):
    assert enc(text).tolist() == enc._enc.encode_ordinary(text)


def test_unsplit_run(enc):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdehilnorst"), 5000))
    assert enc(text).tolist() == enc._enc.encode_ordinary(text)


def test_rows(spark, enc):
    long = "Tree " * 30 + "x" * 90
    rows = [(1, None), (2, ""), (3, "a b"), (4, long), (4, long), (None, "<|endoftext|>"), (5, " \n ")]
    df = spark.createDataFrame([(i, t, "other", 7) for i, t in rows], "doc_id long, text string, ids string, id int")
    got = encode_texts(df, piece_chars=16, spread_chars=64).collect()
    want = [(i, enc._enc.encode_ordinary(t or "")) for i, t in rows]
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(want, key=key)
    assert encode_texts(df.limit(0)).count() == 0
