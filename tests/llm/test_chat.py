import hashlib
import json

from hypothesis import given, settings, strategies as st

from promptloom.llm import chat

PIECES = [*"ab<|>[]/\\nlb\n", "<|im_end|>", "<|im_start|>", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "é"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_round_trip(turns):
    formatted = "".join(chat.render(role, text)[0] for role, text in turns)
    assert chat.read_conversation(formatted) == turns
    for _, text in turns:
        body = chat.escape(text)
        assert chat.unescape(body) == text
        assert not any(c in body for c in ("<|", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>"))


def test_layouts_by_fingerprint():
    want = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7},
        {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a", "extra": {"deep": [1]}}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"},
    ]
    for record in records:
        assert chat.canonical_turns(record)[1] == want
    assert len({chat.canonical_turns(r)[0] for r in records}) == len(records)
    assert chat.canonical_turns({"instruction": "q", "input": "x", "output": "a", "system": "s"})[1] == [("system", "s"), ("user", "q\n\nx"), ("assistant", "a")]
    assert chat.canonical_turns({"unknown": 1}) == (None, []) and chat.canonical_turns(None) == (None, [])


def test_records(spark):
    good = json.dumps({"prompt": "p [INST]", "completion": "c</s>"})
    rows = [(1, good), (2, None), (3, "not json"), (4, "[1]"), (5, json.dumps({"messages": []})), (1, good), (None, good)]
    got = chat.format_records(spark.createDataFrame(rows, "id long, record string").selectExpr("*", "1 AS layout", "2 AS loss")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.layout == "prompt_completion":
            assert chat.read_conversation(r.formatted) == [("user", "p [INST]"), ("assistant", "c</s>")]
            assert [chat.unescape(r.formatted[a:b]) for a, b in r.loss] == ["c</s>"]
        else:
            assert r.formatted == "" and r.loss == []


def brute(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = []
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_digests_of_awkward_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", None), (2, 0, None, ""), (None, 0, "user", "x"), (None, None, "tool\nrole", "y <|im_end|>\n"),
        (3, 5, "system", "é\U0001f600"), (4, 0, "assistant", "long " * 50_000), (1, None, "user", "null turn"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS n_turns").repartition(3)
    got = chat.digests(chat.format_turns(df)).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=str) == brute(rows)
    assert chat.digests(chat.format_turns(df.limit(0))).collect() == []


def test_roles_of_a_table_are_kept(spark):
    roles = ["human", "gpt", "bot", "model", "Assistant", "assistant", None, "a\nb <|im_end|>"]
    rows = [(1, k, r, f"text {k}") for k, r in enumerate(roles)]
    got = chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()[0]
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (8, 6, hashlib.sha256(b"text 5").hexdigest())
