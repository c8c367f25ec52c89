import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm.bpe import bpe_encode, digests, tokenizer
from tonelake.llm.queries import word_bpe_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_bpe_path())


HARD = [
    "", " ", "Hello WORLD's it'll", "<|endoftext|>x <|startoftext|>", "ΑΣ Σ' İ é ẛ̣ ﬁ", "日本語 ١٢3 😀😀", "a" * 3000, "ab" * 2000, "\x00a\x85b​ c", "x<|endoftext|", "'S 'LL I'VE don't",
    "1234567 ### $$$ &&& a_b", "hahahahahahahahaha", "﻿  z",
]


def check(library, texts):
    bpe = tokenizer(word_bpe_path())
    ends, flat, decoded = bpe.encode_batch(texts)
    for i, text in enumerate(texts):
        ids = flat[ends[i] : ends[i + 1]].tolist()
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected
        assert decoded[i] == library.decode(expected, skip_special_tokens=False) == bpe.decode(ids)


def test_hard_texts(library):
    check(library, HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(library, texts):
    check(library, texts)


def test_pairs_merge_lowest_rank_first(library):
    check(library, ["".join(p) for p in zip("thethethe" * 40, "inganderr" * 40)] + ["th" * k + "e" for k in range(1, 30)])


def test_frame(spark, clashing):
    docs = clashing([(1, "The cat"), (2, None), (3, ""), (None, "The cat"), (1, "The cat"), (4, "z" * 20_000)])
    got = {(r.doc_id, r.n_tokens) for r in digests(bpe_encode(docs, word_bpe_path())).collect()}
    assert (2, 0) in got and (3, 0) in got and (1, 2) in got and (None, 2) in got
    assert bpe_encode(docs, word_bpe_path()).count() == 6
    assert bpe_encode(docs.limit(0), word_bpe_path()).count() == 0
