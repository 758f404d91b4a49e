import hashlib
import json
import zlib

import pytest
from promptloom.functions import arrow as P, text as T
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "role", "kind"), [
    ('{"city": "Oslo", "rows": [3, 5]}', "user", "STRUCTURED_DATA"), ('[{"id": 7}, {}]', "user", "STRUCTURED_DATA"), ("~~~ sql\nSELECT 1\n~~~", "user", "CODE_BLOCK"), ("## Document\n" + "the river has two banks. " * 20, "user", "RETRIEVED_DOC"),
    ("Input: a\nOutput: b\nInput: c\nOutput: d\nInput: e\nOutput: f", "user", "FEW_SHOT_EXAMPLE"), ("You must answer", "system", "SYSTEM_INSTRUCTION"), ("fine", "assistant", "ASSISTANT_TURN"), ("what?", "user", "USER_QUERY"), ("{not json", "user", "USER_QUERY"), ("word " * 300, "assistant", "ASSISTANT_TURN"),
])
def test_segment_types(spark, text, role, kind):
    assert one(spark, T.segment_type(F.col("t"), F.col("r")), t=text, r=role) == kind


def test_token_estimate(spark):
    rows = spark.createDataFrame([("a" * 100,), ("",), (None,), ("a",), ("abcdef",)], "t string").select(T.token_estimate(F.col("t"), 10).alias("ten"), T.token_estimate(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [(10, 26), (0, 0), (0, 0), (1, 1), (1, 2)]


def test_sentences(spark):
    cut = lambda t: one(spark, T.sentences(F.col("t")), t=t)
    assert cut("One. Two! Three? four.") == ["One.", "Two!", "Three? four."]
    assert cut("A.\n\nB. C") == ["A.", "B.", "C"]
    assert cut("First. Seen by Dr. Smith. Last.") == ["First. Seen by Dr.", "Smith.", "Last."]
    assert cut("") == [] and cut("  ") == ["  "] and cut("no end") == ["no end"]


def test_polarity_guard(spark):
    guard = lambda t: one(spark, T.polarity_guard(F.col("t")), t=t)
    assert guard("It is NOT subject to change") == hashlib.sha256(b"not|subject to").hexdigest()
    assert guard("nothing") == hashlib.sha256(b"").hexdigest() == guard("")


def test_normative_tokens_and_query_terms(spark):
    assert one(spark, T.normative_tokens(F.col("t")), t="You MUST do  not, must Only mustard") == ["do not", "must", "only"]
    assert one(spark, T.query_terms(F.col("t")), t="What is the Refund policy for refund ab policies?") == ["Refund", "policy", "policies"]


def test_title_and_tables(spark):
    assert one(spark, T.title_guess(F.col("t")), t="A Title\nbody") == "A Title"
    assert one(spark, T.title_guess(F.col("t")), t="A sentence.\nand more words here now") == "A sentence. and more words..."
    assert one(spark, T.depad_tables(F.col("t")), t="| a  |  b |\nx | y\n  |c| ") == "|a|b|\nx | y\n|c|"
    assert one(spark, T.tidy(F.col("t")), t="a  \n\n\n\n b\t\tc \n") == "a\n\n b c"


def plain_signature(text):
    low = text.lower()
    grams = {int.from_bytes(hashlib.md5(low[i : i + 5].encode()).digest()[:4], "little") for i in range(len(low) - 4)} if len(low) >= 5 else {int.from_bytes(hashlib.md5(low.encode()).digest()[:4], "little")}
    state, drawn = 0x49544F4C, []
    for _ in range(256):
        state = (state * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)
        drawn.append(state >> 33)
    return [min(((a | 1) * s + b) % 2**32 for s in grams) for a, b in zip(drawn[::2], drawn[1::2], strict=True)]


def test_minhash():
    text = "The quick brown fox jumps over the lazy dog"
    assert P.signature(text) == plain_signature(text)
    assert P.signature("abc") == plain_signature("abc") and P.signature(None) == P.signature("")
    long = " ".join(f"word{i}" for i in range(3000))
    assert P.signature(long) == plain_signature(long)
    same = lambda a, b: sum(x == y for x, y in zip(P.signature(a), P.signature(b), strict=True)) / 128
    assert same(text, text) == 1 and same(text, "completely other letters 123456789") < 0.15


def test_density():
    assert P.density("") == 1.0 and P.density(None) == 1.0
    text = "word " * 200
    assert P.density(text) == pytest.approx(0.7 * len(zlib.compress(text.encode(), 6)) / 1000 + 0.3 / 200)


@pytest.mark.parametrize("text", ['{ "city" : "Oslo",   "rows": [ 3 ] }', "{no json here", '{"a": 1', "[1,2]", '{"b": 1, "a": [1.5, null, "é"]}', "", None])
def test_json_minify(text):
    out = P.minify(text)
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        assert out == text
    else:
        assert json.loads(out) == value and len(out) <= len(text)


def test_rouge_and_cosine():
    def table(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for a, b in (("a b c d", "b d a c"), ("x y x y x", "y x x"), ("q", "r"), ("a b", "a b")):
        assert P.lcs(a.split(), b.split()) == table(a.split(), b.split())
    assert P.rouge("", "") == 1 and P.rouge("a", "") == 0
    assert P.bag_cosine("a b", "A  b") == pytest.approx(1) and P.bag_cosine("a", "1") == 0
