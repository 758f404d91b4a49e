import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from promptloom.llm import tokens

from .cases import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNT = tokens.text_counter(tokens.load_bpe(PATH))


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "the", " a", "'s", "\n", "  ", "é", "漢", "1", "\x85", "\x1c", "　"]), max_size=15).map("".join)))
def test_counts_are_the_librarys(text):
    assert COUNT(text) == library(text)


def test_rows(spark):
    rows = documents()
    got = tokens.count_tokens(frame(spark).withColumnRenamed("n", "n_tokens"), PATH).collect()
    want = sorted((str(d), len((t or "").encode()), library(t or ""), library(t or "") > 1024) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tokens.count_tokens(frame(spark, []), PATH).collect() == []


def test_count_is_symbols_less_merges():
    model = tokens.load_bpe(PATH)
    assert tokens.merged_size(b"", model["start"], model["merges"]) == 0
    assert tokens.merged_size(b"a", model["start"], model["merges"]) == 1
    assert tokens.merged_size(b"abab", model["start"], {}) == 4


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        tokens.load_bpe(public_tokenizers.path("word_bpe_49k.json"))
