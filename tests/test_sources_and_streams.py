import json

import pytest
from promptloom.operators import sequential as Q
from promptloom.sources import dialects as D, files, generators, tables
from promptloom.streaming import windows as W
from pyspark.sql import functions as F

from .conftest import SMALL


@pytest.mark.parametrize(("sink", "source"), [(D.chat_sink, D.chat_source), (D.block_sink, D.block_source), (D.history_sink, D.history_source)])
def test_dialects_round_trip(spark, sink, source):
    rows = [(1, 0, "system", "s1"), (1, 1, "user", "q \"x\" é"), (1, 2, "assistant", "a\n"), (1, 3, "user", "more"), (2, 0, "user", "only"), (3, 0, "user", "u"), (3, 1, "assistant", "v")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.request_id, r.idx, r.role, r.text) for r in source(sink(D.messages(conv))).collect()}
    assert got == {(1, -1, "system", "s1"), (1, 0, "user", "q \"x\" é"), (1, 1, "assistant", "a\n"), (1, 2, "user", "more"), (2, 0, "user", "only"), (3, 0, "user", "u"), (3, 1, "assistant", "v")}


def test_responses(spark):
    bodies = {
        "chat": {"choices": [{"message": {"content": "t"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}},
        "block": {"content": [{"text": "t"}], "usage": {"input_tokens": 3, "output_tokens": 4}, "stop_reason": "stop"},
        "history": {"text": "t", "meta": {"tokens": {"input_tokens": 3, "output_tokens": 4}}, "finish_reason": "stop"},
    }
    for dialect, body in bodies.items():
        row = D.responses(spark.createDataFrame([(1, json.dumps(body)), (2, "broken")], "request_id long, body string"), dialect).orderBy("request_id").collect()
        assert tuple(row[0]) == (1, "t", 3, 4, "stop") and row[1].text is None


def test_parameters(spark):
    body = json.dumps({"model": "m", "temperature": 0.2, "top_k": 4, "messages": [{"role": "user"}], "stop": ["a"]})
    df = spark.createDataFrame([(1, body)], "request_id long, body string")
    assert D.parameters(df, "chat").first().params == {"temperature": "0.2", "stop": '["a"]'}
    assert D.parameters(df, "block").first().params == {"temperature": "0.2"}


def test_samples(spark):
    call = f"array<{D.CALL}>"
    row = (1, [("system", "be kind", []), ("user", "hi", None), ("assistant", None, [("f", "{}")]), ("tool", "42", []), ("assistant", "", []), ("system", "late", [])])
    df = spark.createDataFrame([row], f"request_id long, messages array<struct<role:string,content:string,tool_calls:{call}>>")
    assert [tuple(r) for r in D.sample_source(df).orderBy("idx").collect()] == [(1, -1, "system", "be kind"), (1, 0, "user", "hi"), (1, 1, "assistant", "[tool call] f({})"), (1, 2, "user", "[tool result] 42")]


def test_files(spark, tmp_path):
    (tmp_path / "run_a.jsonl").write_text('{"sample_id": "1", "tokens_in": 5}\nnot json\n{"sample_id": "2"}\n')
    (tmp_path / "other.jsonl").write_text('{"sample_id": "3"}\n')
    assert sorted(r.sample_id for r in files.read_results(spark, str(tmp_path)).collect()) == ["1", "2", "3"]
    assert sorted(r.sample_id for r in files.read_results(spark, str(tmp_path), "run_").collect()) == ["1", "2"]
    out = str(tmp_path / "out")
    for _ in range(2):
        files.append_lines(spark.createDataFrame([(1, "x")], "a int, b string"), out)
    assert spark.read.json(out).count() == 2
    (tmp_path / "qa.txt").write_text('{"_meta": "head"}\n{"id": "q1", "question": "?", "answer": "yes"}\n')
    assert [r.id for r in files.read_questions(spark, str(tmp_path / "qa.txt")).collect()] == ["q1"]
    (tmp_path / "pairs.txt").write_text(json.dumps([{"request_class": "A", "input": "i"}]))
    assert files.read_pairs(spark, str(tmp_path / "pairs.txt")).first().input == "i"
    (tmp_path / "rows.csv").write_text("text,label\nhello,A\n")
    assert tuple(files.read_labelled(spark, str(tmp_path / "rows.csv")).first()) == ("hello", "A")


def test_tenants(spark):
    text = json.dumps({"tenants": {"acme": {"quotas": {"requests_per_day": 5}, "no_store": True, "api_keys": ["k1"]}, "plain": None}})
    rows = {r.tenant_id: r for r in files.read_tenants(spark, text).collect()}
    assert rows["acme"].requests_per_day == 5 and rows["acme"].no_store and rows["acme"].api_keys == ["k1"]
    assert rows["plain"].tokens_per_day is None and not rows["plain"].no_store


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, ts int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w"), ("b", 0, "late")], "k string, ts int, v string")
    assert {tuple(r) for r in files.upsert(old, new, ["k"], "ts").collect()} == {("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")}


def test_generators(spark):
    for kind, (low, high) in generators.TURNS.items():
        rows = generators.workload(spark, kind, 20)
        assert rows.collect() == generators.workload(spark, kind, 20).collect()
        assert all(low <= r["count"] <= high for r in rows.groupBy("sample_id").count().collect())
    asked = generators.faq(spark, 10, 30)
    assert asked.count() == 40 and asked.where("paraphrase_of IS NULL").count() == 10
    assert generators.calibration_pairs(spark, 50, ["A", "B"]).where("length(compressed) >= length(input)").count() == 0


def test_literals_are_the_same_in_both_engines(spark):
    import duckdb

    sql = tables.literal([(1, "it's\na \"line\"", None), (2, "", 1.5)], ["a", "b", "c"])
    assert [tuple(r) for r in spark.sql(f"SELECT a, b, CAST(c AS DOUBLE) AS c FROM {sql} ORDER BY a").collect()] == duckdb.sql(f"SELECT a, b, CAST(c AS DOUBLE) AS c FROM {sql} ORDER BY a").fetchall()


@pytest.fixture(scope="module")
def split_log(spark, tmp_path_factory):
    """The event table in four files, in order of time."""
    folder = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts").coalesce(1).cache()
    n = rows.count()
    for k in range(4):
        rows.withColumn("r", F.monotonically_increasing_id()).where(f"r DIV {n // 4 + 1} = {k}").drop("r").coalesce(1).write.mode("append").parquet(str(folder / "log"))
    return str(folder / "log")


def log_of(df):
    return df.selectExpr(*(f"{e} AS {n}" for n, e in tables.REQUEST_LOG.items()))


def test_micro_batches_equal_one_batch(spark, split_log):
    stream = log_of(W.event_stream(spark, split_log))
    got = W.drain(W.hourly(stream), "complete").collect()
    want = W.hourly(log_of(spark.read.parquet(split_log))).collect()
    assert sorted(got) == sorted(want) and len(want) > 10


def test_append_mode_closes_windows_behind_the_watermark(spark, split_log):
    done = {r.w.start: r.n for r in W.drain(W.hourly(log_of(W.event_stream(spark, split_log)))).collect()}
    every = {r.w.start: r.n for r in W.hourly(log_of(spark.read.parquet(split_log))).collect()}
    assert 0 < len(done) <= len(every) and set(done) <= set(every)


def test_streamed_breaker_equals_the_fold(spark, split_log):
    cells = lambda df: log_of(df).withColumn("cell", F.col("strategy_id")).withColumn("at", F.expr(tables.micros()) / 1e6)
    want = {r.request_id: r.state for r in Q.circuit_states(cells(spark.read.parquet(split_log))).collect()}
    stream = W.event_stream(spark, split_log, files_per_trigger=100)
    assert {r.request_id: r.state for r in W.drain(W.breaker(cells(stream))).collect()} == want


def test_first_seen(spark, split_log):
    got = W.drain(W.first_seen(log_of(W.event_stream(spark, split_log)).select("request_id", "tenant_id", "ts"), ["tenant_id"], "400 days"))
    assert got.count() == log_of(spark.read.parquet(split_log)).select("tenant_id").distinct().count()


BODY = {
    "model": "m", "temperature": 0.5, "stop": ["a", "b"], "seed": "5", "unknown": 1, "tools": [{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object", "properties": {"x": {"type": "string"}}}}}],
    "messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": [{"type": "text", "text": "look"}, {"type": "image_url", "image_url": {"url": "u"}}, {"type": "text", "text": "here"}]}, {"role": "assistant", "content": "[1, 2]"}],
}


def one(spark, body):
    return spark.createDataFrame([(1, json.dumps(body))], "request_id long, body string")


def test_contents_may_be_lists(spark):
    rows = {r.idx: (r.role, r.text) for r in D.chat_source(one(spark, BODY)).collect()}
    assert rows == {-1: ("system", "sys"), 0: ("user", "look\n[image]\nhere"), 1: ("assistant", "[1, 2]")}
    block = {"system": [{"type": "text", "text": "s1"}, {"type": "text", "text": "s2"}], "messages": [{"role": "user", "content": "plain"}, {"role": "user", "content": [{"type": "tool_use", "name": "f", "input": {"x": 1}}, {"type": "tool_result", "content": "done"}]}]}
    rows = {r.idx: (r.role, r.text) for r in D.block_source(one(spark, block)).collect()}
    assert rows == {-1: ("system", "s1\ns2"), 0: ("user", "plain"), 1: ("user", 'tool_use: f {"x":1}\ndone')}


def test_tools_and_parameters_both_ways(spark):
    bodies = one(spark, BODY)
    tool = D.tools(bodies).first().tools[0]
    assert (tool.name, tool.description, json.loads(tool.parameters)) == ("f", "d", BODY["tools"][0]["function"]["parameters"])
    bare = one(spark, {"model": "m", "messages": []})
    chat = json.loads(D.with_extras(bare, "chat", D.passed(bodies, "chat"), D.tools(bodies)).first().body)
    assert chat == {"model": "m", "messages": [], "temperature": 0.5, "stop": ["a", "b"], "seed": "5", "tools": BODY["tools"]}
    block = json.loads(D.with_extras(bare, "block", D.passed(bodies, "chat"), D.tools(bodies)).first().body)
    assert block["tools"] == [{"name": "f", "description": "d", "input_schema": BODY["tools"][0]["function"]["parameters"]}] and block["temperature"] == 0.5 and "seed" not in block
    again = D.tools(D.with_extras(bare, "block", None, D.tools(bodies))).first().tools[0]
    assert json.loads(again.parameters) == BODY["tools"][0]["function"]["parameters"]


def test_bodies_are_rebuilt_with_the_new_text(spark):
    texts = spark.createDataFrame([(1, 'new "text"\nof it')], "request_id long, full_text string")
    got = json.loads(D.rebuild(one(spark, BODY), texts).first().body)
    assert got == {**BODY, "messages": [*BODY["messages"][:-1], {"role": "assistant", "content": 'new "text"\nof it'}]}
    assert json.loads(D.rebuild(one(spark, {"messages": []}), texts).first().body) == {"messages": []}


def test_proxy_paths_choose_the_dialect(spark):
    rows = [(1, "/v1/chat/completions", json.dumps(BODY)), (2, "/v1/messages", json.dumps({"system": "s", "messages": [{"role": "user", "content": "q"}]})), (3, "/v1/chat", json.dumps({"message": "m", "chat_history": []})), (4, "/other", "{}")]
    got = {(r.request_id, r.idx): r.text for r in D.proxy_source(spark.createDataFrame(rows, "request_id long, path string, body string")).collect()}
    assert got[1, -1] == "sys" and got[2, -1] == "s" and got[2, 0] == "q" and got[3, 0] == "m" and not any(k == 4 for k, _ in got)


def test_responses_of_several_blocks(spark):
    body = {"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "f"}, {"type": "text", "text": "b"}], "usage": {"input_tokens": 3, "output_tokens": 4}, "stop_reason": "end"}
    r = D.responses(one(spark, body), "block").first()
    assert (r.text, r.tokens_in, r.tokens_out, r.finish_reason) == ("ab", 3, 4, "end")
