import random

import pytest
from promptloom.operators import benchmarks as B, cache as C, classify as L, segments as S, telemetry as A, vectors as V
from promptloom.sources import dimensions as D
from pyspark.sql import functions as F


def key(spark, params, messages="m", provider="p"):
    return spark.createDataFrame([(params, messages)], "params map<string,string>, m string").select(C.exact_key(F.lit(provider), F.lit("x"), F.col("params"), F.col("m")).alias("k")).first().k


def test_exact_key(spark):
    assert key(spark, {"temperature": "0.21", "n": "1", "stream": "true"}) == key(spark, {"n": "1", "temperature": "0.2", "stream": "false"})
    assert key(spark, {"temperature": "0.6"}) is None and key(spark, {}) is not None
    assert key(spark, {}, "other") != key(spark, {}) != key(spark, {}, provider="q")


def test_replay(spark):
    rows = [(k, "t", "a", k * 10, 25) for k in range(8)] + [(100, "t", "b", 5, 25), (101, "u", "a", 11, 25)]
    got = {r.request_id: r.hit for r in C.replay(spark.createDataFrame(rows, "request_id long, tenant_id string, key string, at long, ttl long")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 6: 0, 7: 1, 100: 0, 101: 0}


@pytest.mark.parametrize(("reason", "error", "ok"), [("stop", None, True), (None, None, True), ("length", None, False), ("stop", "boom", False), ("tool_use", None, True)])
def test_only_whole_answers_are_cached(spark, reason, error, ok):
    df = spark.createDataFrame([(reason, error)], "r string, e string")
    assert df.select(C.cacheable(F.col("r"), F.col("e")).alias("x")).first().x is ok


def test_namespaces_need_every_field(spark):
    lit = lambda *v: spark.range(1).select(C.namespace(*map(F.lit, v)).alias("x")).first().x
    base = ("t", "p", "m", "s", "h")
    assert len({lit(*base), *(lit(*base[:k], "other", *base[k + 1 :]) for k in range(5))}) == 6


def test_accept_needs_the_cached_numbers(spark):
    df = spark.createDataFrame([(0.96, 0.9, ["1", "2"], ["1"]), (0.96, 0.9, ["1"], ["1", "3"]), (0.94, 0.9, ["1"], []), (0.96, 0.8, ["1"], [])], "c double, x double, a array<string>, b array<string>")
    assert [r.ok for r in df.select(C.accept(F.col("c"), F.lit(0.95), F.col("x"), F.col("a"), F.col("b")).alias("ok")).collect()] == [True, False, False, False]


def test_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(k, str(k % 3), rng.normal(size=5).tolist()) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, namespace string, embedding array<double>").repartition(4)
    for block in (4096, 1):
        got = {}
        for r in V.neighbours(df, df.where("vec_id % 50 = 0"), k=4, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        for q in (0, 50, 100):
            u = lambda v: np.array(v) / np.linalg.norm(v)
            want = sorted(((-float(u(rows[q][2]) @ u(v)), k) for k, s, v in rows if s == rows[q][1] and k != q))[:4]
            assert [k for _, k in sorted(got[q])] == [k for _, k in want]


def test_eviction_and_invalidation(spark):
    entries = spark.createDataFrame([(k, "n", k % 5, 100 * k) for k in range(10)], "entry_id long, namespace string, last_access_1 long, tokens_saved long")
    assert sorted(r.entry_id for r in C.evict(entries, 3).collect()) == [4, 8, 9]
    plans = spark.createDataFrame([("a", ["d1", "d2"]), ("b", ["d3"]), ("c", [])], "key string, depends_on array<string>")
    assert sorted(r.key for r in C.invalidate(plans, spark.createDataFrame([("d2",), ("d9",)], "doc string")).collect()) == ["b", "c"]


def test_cache_levels(spark):
    df = spark.createDataFrame([('{"level":"L0"}',), ('{"cache":"l1"}',), ('{"level":"x"}',), ("broken",), (None,)], "c string")
    assert [r.x for r in df.select(A.cache_level(F.col("c")).alias("x")).collect()] == ["l0", "l1", "miss", "miss", None]


def test_routes(spark):
    table = {(r.request_class, r.strategy): r for r in D.routing(spark).collect()}
    for c in ("EXTRACTION", "REASONING"):
        assert table[c, "S7"].status == "DISABLED" and table[c, "S3"].floor == 0.97 and table[c, "S1"].l1_tau == 0.97
    both = {(r.request_class_a, r.request_class_b, r.strategy): r for r in L.ambiguous_routes(D.routing(spark)).collect()}
    row = both["EXTRACTION", "SUMMARIZATION", "S3"]
    assert (row.status, row.floor, row.l1_tau) == ("RESTRICTED", 0.97, 0.97)
    assert both["CHAT_OPEN", "EXTRACTION", "S7"].status == "DISABLED" and both["CHAT_OPEN", "EXTRACTION", "S1"].l1_allowed == 0


def test_scores(spark):
    df = spark.createDataFrame([("The cat sat.", "a cat sat"), ("x", "y"), ("", ""), ("one two", "two one")], "a string, b string")
    got = [(r.em, round(r.f1, 4)) for r in df.select(B.exact_match(F.col("a"), F.col("b")).alias("em"), B.token_f1(F.col("a"), F.col("b")).alias("f1")).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 1.0)]


def test_bootstrap_holds_the_mean(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("k", i, rng.random()) for i in range(300)], "k string, id long, value double")
    row = B.bootstrap(df, ["k"], 200).first()
    assert row.lo < row.mean < row.hi and row.hi - row.lo < 0.12
    assert row == B.bootstrap(df.repartition(7), ["k"], 200).first() or abs(row.lo - B.bootstrap(df.repartition(7), ["k"], 200).first().lo) < 1e-9


def test_template_signature(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "a"), (2, 0, "system", "be kind"), (2, 1, "user", "b"), (3, 0, "system", "be rude"), (3, 1, "user", "a")]
    got = {r.request_id: r.template_signature for r in S.template_signature(S.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) == 64


def test_content_segments(spark):
    block = "struct<type:string,text:string,tool_use_id:string,tool_name:string,tool_input:string,tool_result_for_id:string,is_error:boolean,image_url:string>"
    text = lambda t, kind="text", **k: {"type": kind, "text": t, "tool_use_id": None, "tool_name": None, "tool_input": None, "tool_result_for_id": None, "is_error": None, "image_url": None} | k
    row = (1, [text("be kind")], [{"role": "user", "content": [text("hi"), text(None, "image_url", image_url="u")]}, {"role": "assistant", "content": [text(None, "tool_use", tool_name="f", tool_input="{}")]}, {"role": "tool", "content": [text("42", "tool_result")]}], [{"name": "f", "description": "d", "parameters": "{}"}])
    df = spark.createDataFrame([row], f"request_id long, system array<{block}>, messages array<struct<role:string,content:array<{block}>>>, tools array<struct<name:string,description:string,parameters:string>>")
    got = [r.segment_type for r in S.content_segments(df).orderBy("part", "m", "i").collect()]
    assert got == ["SYSTEM_INSTRUCTION", "USER_QUERY", "UNKNOWN", "TOOL_SCHEMA", "TOOL_RESULT", "TOOL_SCHEMA"]


def test_vectors_that_cannot_be_compared_take_no_part(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "a", [1.0, 1.0]), (2, "a", [1.0, 1.0, 1.0]), (3, "a", [None, 1.0]), (4, "a", [float("nan"), 1.0]), (5, "a", None), (6, "b", [1.0, 0.0]), (50, "a", [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, namespace string, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in V.neighbours(df, df.where("vec_id % 50 = 0 OR vec_id = 3"), k=4).collect()}
    assert got == {(0, 1), (50, 2)}
