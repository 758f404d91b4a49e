"""Provider dialects: request bodies to and from one message table, and their responses.

A source reads a column of JSON bodies into (request_id, idx, role, text); a sink builds the bodies from that. System texts have the idx -1.
Contents may be a string or a list of blocks: text blocks are joined by line ends, an image is the text "[image]", a tool's call and result are
their texts. ``tools`` reads the tools of a body, ``passed`` its parameters with their types; ``with_extras`` writes both into bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Parameters that pass through by dialect, and role names of the chat-history dialect.
PARAMETERS = {
    "chat": ["temperature", "max_tokens", "stop", "top_p", "stream", "n", "presence_penalty", "frequency_penalty", "seed", "logprobs"],
    "block": ["temperature", "max_tokens", "stop_sequences", "top_p", "stream"],
    "history": ["temperature", "max_tokens", "p", "k", "stop_sequences"],
}
HISTORY_ROLES = {"user": "USER", "assistant": "CHATBOT", "system": "SYSTEM"}

# A nested value that is read as a string is its JSON text, so a content is read both as a string and as blocks.
CHAT_BODY = "model string, messages array<struct<role string, content string>>"
BLOCK = "struct<type string, text string, name string, input string, content string>"
BLOCK_LISTS = f"system array<{BLOCK}>, messages array<struct<role string, content array<{BLOCK}>>>"
BLOCK_BODY = "model string, system string, max_tokens int, messages array<struct<role string, content string>>"
TOOL = "struct<name string, description string, parameters string>"
TOOL_BODY = "tools array<struct<name string, description string, input_schema string, function struct<name string, description string, parameters string>>>"
#: Paths of requests, by dialect.
PATHS = {"chat": "/v1/chat/completions", "block": "/v1/messages", "history": "/v1/chat"}
HISTORY_BODY = "model string, preamble string, chat_history array<struct<role string, message string>>, message string"


def messages(conversations: DataFrame) -> DataFrame:
    """(request_id, system, turns): one row a conversation, system texts joined by line ends."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    packed = conversations.groupBy(F.col("conv_id").alias("request_id")).agg(rows.alias("r"))
    system = F.array_join(F.transform(F.filter("r", lambda x: x["role"] == "system"), lambda x: x["text"]), "\n")
    return packed.select("request_id", F.nullif(system, F.lit("")).alias("system"), F.filter("r", lambda x: x["role"] != "system").alias("turns"))


def chat_sink(packed: DataFrame, model: str = "m") -> DataFrame:
    """Bodies with the system text as first message."""
    first = F.when(F.col("system").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    rest = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return packed.select("request_id", F.to_json(F.struct(F.lit(model).alias("model"), F.concat(first, rest).alias("messages"))).alias("body"))


def block_sink(packed: DataFrame, model: str = "m") -> DataFrame:
    """Bodies with the system text apart and contents as typed blocks."""
    content = lambda t: F.array(F.struct(F.lit("text").alias("type"), t.alias("text")))
    rest = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), content(x["text"]).alias("content")))
    return packed.select("request_id", F.to_json(F.struct(F.lit(model).alias("model"), "system", F.lit(1024).alias("max_tokens"), rest.alias("messages"))).alias("body"))


def history_sink(packed: DataFrame, model: str = "m") -> DataFrame:
    """Bodies with preamble, history and the last message apart."""
    names = F.create_map(*(F.lit(x) for pair in HISTORY_ROLES.items() for x in pair))
    history = F.transform(F.slice("turns", 1, F.greatest(F.size("turns") - 1, F.lit(0))), lambda x: F.struct(names[x["role"]].alias("role"), x["text"].alias("message")))
    body = F.struct(F.lit(model).alias("model"), F.col("system").alias("preamble"), history.alias("chat_history"), F.try_element_at("turns", F.lit(-1))["text"].alias("message"))
    return packed.select("request_id", F.to_json(body).alias("body"))


def _rows(parsed: DataFrame, system: Column, turns: Column) -> DataFrame:
    head = F.filter(F.array(F.struct(F.lit(-1).alias("idx"), F.lit("system").alias("role"), system.alias("text"))), lambda x: x["text"].isNotNull())
    return parsed.select("request_id", F.explode(F.concat(head, turns)).alias("x")).select("request_id", "x.*")


def _joined(blocks: Column) -> Column:
    """The texts of a list of blocks."""
    text = lambda c: F.when(c["type"].startswith("image"), F.lit("[image]")).when(c["type"] == "tool_use", F.concat_ws(" ", F.lit("tool_use:"), c["name"], c["input"])).when(c["type"] == "tool_result", F.coalesce(c["content"], c["text"])).otherwise(c["text"])
    return F.array_join(F.filter(F.transform(blocks, text), lambda t: t.isNotNull()), "\n")


def _contents(bodies: DataFrame, schema: str) -> DataFrame:
    """request_id, b (contents as strings) and l (contents as lists, null where they are strings)."""
    return bodies.select("request_id", F.from_json("body", schema).alias("b"), F.from_json("body", BLOCK_LISTS).alias("l"))


def _content(m: Column, i: Column) -> Column:
    own = F.get(F.col("l.messages"), i)["content"]
    return F.when(own.isNotNull(), _joined(own)).otherwise(m["content"])


def chat_source(bodies: DataFrame) -> DataFrame:
    """System messages are taken out of the list and joined."""
    parsed = _contents(bodies, CHAT_BODY)
    every = F.transform("b.messages", lambda m, i: F.struct(m["role"].alias("role"), _content(m, i).alias("text")))
    texts = F.transform(F.filter(every, lambda m: m["role"] == "system"), lambda m: m["text"])
    turns = F.transform(F.filter(every, lambda m: m["role"] != "system"), lambda m, i: F.struct(i.alias("idx"), m["role"].alias("role"), m["text"].alias("text")))
    return _rows(parsed, F.when(F.size(texts) > 0, F.array_join(texts, "\n")), turns)


def block_source(bodies: DataFrame) -> DataFrame:
    parsed = _contents(bodies, BLOCK_BODY)
    system = F.when(F.col("l.system").isNotNull(), _joined(F.col("l.system"))).otherwise(F.col("b.system"))
    return _rows(parsed, system, F.transform("b.messages", lambda m, i: F.struct(i.alias("idx"), m["role"].alias("role"), _content(m, i).alias("text"))))


def history_source(bodies: DataFrame) -> DataFrame:
    """The roles of the history are mapped back; the last message has the role that its place in the turn order implies."""
    parsed = bodies.select("request_id", F.from_json("body", HISTORY_BODY).alias("b"))
    names = F.create_map(*(F.lit(x) for a, b in HISTORY_ROLES.items() for x in (b, a)))
    turns = F.transform("b.chat_history", lambda m, i: F.struct(i.alias("idx"), names[m["role"]].alias("role"), m["message"].alias("text")))
    last_role = F.when(F.try_element_at(F.col("b.chat_history"), F.lit(-1))["role"] == "USER", "assistant").otherwise("user")
    last = F.filter(F.array(F.struct(F.size("b.chat_history").alias("idx"), last_role.alias("role"), F.col("b.message").alias("text"))), lambda x: x["text"].isNotNull())
    return _rows(parsed, F.col("b.preamble"), F.concat(turns, last))


def responses(bodies: DataFrame, dialect: str) -> DataFrame:
    """(request_id, text, tokens_in, tokens_out, finish_reason) of response bodies."""
    if dialect == "block":  # a response may have several text blocks, between others
        blocks = F.from_json("body", f"content array<{BLOCK}>")["content"]
        whole = F.nullif(F.array_join(F.filter(F.transform(F.filter(blocks, lambda c: F.coalesce(c["type"], F.lit("text")) == "text"), lambda c: c["text"]), lambda t: t.isNotNull()), ""), F.lit(""))
    path = {
        "chat": ("$.choices[0].message.content", "$.usage.prompt_tokens", "$.usage.completion_tokens", "$.choices[0].finish_reason"),
        "block": ("$.content[0].text", "$.usage.input_tokens", "$.usage.output_tokens", "$.stop_reason"),
        "history": ("$.text", "$.meta.tokens.input_tokens", "$.meta.tokens.output_tokens", "$.finish_reason"),
    }[dialect]
    text, tokens_in, tokens_out, reason = (F.get_json_object("body", p) for p in path)
    text = whole if dialect == "block" else text
    return bodies.select("request_id", text.alias("text"), tokens_in.cast("long").alias("tokens_in"), tokens_out.cast("long").alias("tokens_out"), reason.alias("finish_reason"))


def parameters(bodies: DataFrame, dialect: str) -> DataFrame:
    """(request_id, params): the body's parameters that the dialect passes through, as a map of strings."""
    every = F.from_json("body", "map<string,string>")
    return bodies.select("request_id", F.map_filter(every, lambda k, v: k.isin(PARAMETERS[dialect])).alias("params"))


def passed(bodies: DataFrame, dialect: str) -> DataFrame:
    """(request_id, params): the same with the values' types, as a map of variants."""
    every = F.from_json("body", "map<string,variant>")
    return bodies.select("request_id", F.map_filter(every, lambda k, v: k.isin(PARAMETERS[dialect])).alias("params"))


def tools(bodies: DataFrame) -> DataFrame:
    """(request_id, tools array<TOOL>): of either form; parameters are JSON text."""
    found = F.from_json("body", TOOL_BODY)["tools"]
    one = lambda t: F.struct(F.coalesce(t["function"]["name"], t["name"]).alias("name"), F.coalesce(t["function"]["description"], t["description"]).alias("description"), F.coalesce(t["function"]["parameters"], t["input_schema"]).alias("parameters"))
    return bodies.select("request_id", F.transform(found, one).alias("tools"))


def with_extras(bodies: DataFrame, dialect: str, params: DataFrame | None = None, tooled: DataFrame | None = None) -> DataFrame:
    """Bodies with the parameters (request_id, params) that the dialect passes through and the tools (request_id, tools) in its form."""
    out = bodies.select("request_id", F.from_json("body", "map<string,variant>").alias("m"))
    if params is not None:
        out = out.join(params.select("request_id", "params"), "request_id", "left")
        own = F.map_filter(F.coalesce("params", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, v: k.isin(PARAMETERS[dialect]))
        out = out.select("request_id", F.map_concat(F.map_filter("m", lambda k, v: ~F.map_contains_key(own, k)), own).alias("m"))
    if tooled is not None:
        schema = lambda t: F.try_parse_json(t["parameters"])
        chat = lambda t: F.struct(F.lit("function").alias("type"), F.struct(t["name"].alias("name"), t["description"].alias("description"), schema(t).alias("parameters")).alias("function"))
        block = lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"), schema(t).alias("input_schema"))
        out = out.join(tooled.select("request_id", "tools"), "request_id", "left")
        made = F.create_map(F.lit("tools"), F.parse_json(F.to_json(F.transform("tools", chat if dialect == "chat" else block))))
        rest = F.map_filter("m", lambda k, v: k != "tools")
        out = out.select("request_id", F.when(F.size("tools") > 0, F.map_concat(rest, made)).otherwise(F.col("m")).alias("m"))
    return out.select("request_id", F.to_json("m").alias("body"))


def rebuild(bodies: DataFrame, texts: DataFrame) -> DataFrame:
    """Bodies whose last message has the rewritten text (request_id, full_text) as its content; all else is as it was, as is a body without
    messages or without a new text."""
    rows = bodies.select("request_id", "body", F.from_json("body", "map<string,variant>").alias("m"), F.from_json("body", "messages array<map<string,variant>>")["messages"].alias("old")).join(texts.select("request_id", "full_text"), "request_id", "left")
    last = F.element_at("old", -1)
    fresh = F.map_concat(F.map_filter(last, lambda k, v: k != "content"), F.create_map(F.lit("content"), F.col("full_text").cast("variant")))
    made = F.concat(F.slice("old", 1, F.size("old") - 1), F.array(fresh))
    messages = F.parse_json(F.regexp_replace(F.to_json(F.struct(made.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1"))
    whole = F.to_json(F.map_concat(F.map_filter("m", lambda k, v: k != "messages"), F.create_map(F.lit("messages"), messages)))
    return rows.select("request_id", F.when((F.size("old") > 0) & F.col("full_text").isNotNull(), whole).otherwise(F.col("body")).alias("body"))


def proxy_source(requests: DataFrame) -> DataFrame:
    """Rows of the requests (request_id, path, body) of a proxy, each by the dialect of its path; other paths have none."""
    sources = {"chat": chat_source, "block": block_source, "history": history_source}
    rows = [sources[d](requests.where(F.col("path") == p).select("request_id", "body")) for d, p in PATHS.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


CALL = "struct<name:string,arguments:string>"


def sample_source(samples: DataFrame) -> DataFrame:
    """Benchmark samples (request_id, messages array<struct<role, content, tool_calls array<struct<name, arguments>>>>) as rows: the first system
    text has the idx -1, tool calls and results become text (results of the user), messages without text go."""
    first = F.element_at(F.filter("messages", lambda m: m["role"] == "system"), 1)
    calls = lambda m: F.array_join(F.transform(m["tool_calls"], lambda c: F.concat(F.lit("[tool call] "), c["name"], F.lit("("), c["arguments"], F.lit(")"))), "\n")
    content = lambda m: F.nullif(F.coalesce(m["content"], F.lit("")), F.lit(""))
    text = lambda m: F.when(m["role"] == "tool", F.concat(F.lit("[tool result] "), F.coalesce(m["content"], F.lit("null")))).when((m["role"] == "assistant") & (F.size(m["tool_calls"]) > 0), F.concat_ws("\n", content(m), calls(m))).otherwise(content(m))
    kept = F.filter(F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.struct(F.when(m["role"] == "tool", "user").otherwise(m["role"]).alias("role"), text(m).alias("text"))), lambda x: x["text"].isNotNull())
    rows = F.transform(kept, lambda x, i: F.struct(i.alias("idx"), x["role"].alias("role"), x["text"].alias("text")))
    has_system = F.exists("messages", lambda m: m["role"] == "system")
    return _rows(samples, F.when(has_system, first["content"]), rows)
