"""Chat formatting with schema fingerprints.

A record's layout is known by its fingerprint: the XXH64 of its sorted nested field paths (``messages[].role``), of
those that some mapping names. The fingerprint selects a declarative mapping to canonical turns (role, text). Turns are
rendered as ``<|im_start|>role\\n text <|im_end|>\\n``; control strings inside texts are escaped reversibly, so the
output can be read back exactly. The loss mask covers each assistant text, as escaped, without its markers.

``format_turns`` streams a table of turns (conv_id, turn, role, text), sorted within its partition, so that a conversation of
any length needs no more memory than a turn; ``format_records`` formats JSON records of mixed layouts, one at a time.

Cases: null texts and roles are empty; ``format_turns`` keeps any role as it is, ``format_records`` gives ROLES their usual names; turns that tie are ordered by role, then text; repeated rows
repeat their turn; rows with a null conv_id form one conversation; a record that is null, not an object or of an unknown layout
has no turns and the layout null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._common import partitions

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, escaped wherever a text holds them.
CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
UNESCAPE = re.compile(r"\\(.)", re.S)
MARKS = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}

#: Name, required paths, optional paths, and turns: ("each", list, role field, text field) goes through a list,
#: (role, fields) is one turn of the fields that are there, joined by an empty line.
LAYOUTS = [
    ("turn", ["role", "text"], [], [("each", "", "role", "text")]),
    ("messages", ["messages[].role", "messages[].content"], ["system"], [("system", ["system"]), ("each", "messages", "role", "content")]),
    ("from_value", ["conversations[].from", "conversations[].value"], ["system"], [("system", ["system"]), ("each", "conversations", "from", "value")]),
    ("instruction", ["instruction", "output"], ["input", "system"], [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]),
    ("prompt_completion", ["prompt", "completion"], ["system"], [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]),
    ("prompt_response", ["prompt", "response"], ["system"], [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]),
    ("question_answer", ["question", "answer"], ["context", "system"], [("system", ["system"]), ("user", ["context", "question"]), ("assistant", ["answer"])]),
]
#: Other names of roles, in records.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN = {p for _, need, may, _ in LAYOUTS for p in need + may}


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a record; a list's items share one path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(found: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(found & KNOWN)))


BY_FINGERPRINT = {fingerprint({*need, *some}): (name, steps) for name, need, may, steps in LAYOUTS for some in chain.from_iterable(combinations(may, n) for n in range(len(may) + 1))}


def as_text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: object) -> tuple[str | None, list[tuple[str, str]]]:
    """(layout, turns) of one record."""
    layout, steps = BY_FINGERPRINT.get(fingerprint(paths(record)), (None, [])) if isinstance(record, dict) else (None, [])
    turns = []
    for step in steps:
        if step[0] == "each":
            for item in record[step[1]] if step[1] else [record]:
                if isinstance(item, dict):
                    role = as_text(item.get(step[2]))
                    # Within a list of messages roles go by several names; a table's roles are what they are.
                    turns.append((ROLES.get(role, role) if step[1] else role, as_text(item.get(step[3]))))
        elif had := [as_text(record[f]) for f in step[1] if record.get(f)]:
            turns.append((step[0], "\n\n".join(had)))
    return layout, turns


def escape(text: str, line: bool = False) -> str:
    """``text`` without control strings; with ``line`` without line ends too."""
    text = CONTROL.sub(lambda m: ("\\\\" if m[0] == "\\" else "\\l" + m[0][1:] if m[0][0] == "<" else "\\b" + m[0][1:]), text)
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: MARKS[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn and the bounds of its loss mask in it (equal if there is none)."""
    head = f"{BEGIN}{escape(role, line=True)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + (len(body) if role == "assistant" else 0)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    role, _, rest = formatted.removeprefix(BEGIN).partition("\n")
    body, mark, tail = rest.partition(END)
    if not formatted.startswith(BEGIN) or not mark or tail != "\n":
        raise ValueError("not one formatted turn")
    return unescape(role), unescape(body)


def read_conversation(formatted: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    return [read_turn(BEGIN + part) for part in formatted.split(BEGIN)[1:]]


SEGMENTS = "conv_id long, turn long, formatted string, loss_from int, loss_to int"


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One formatted turn a row, the rows of a conversation together and in order within a partition."""
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = rows.repartition(partitions(df), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                _, turns = canonical_turns({"role": r, "text": t})
                out.append(render(*turns[0]))
            if out:
                formatted, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["conv_id", "turn", "formatted", "loss_from", "loss_to"])

    return rows.mapInArrow(run, SEGMENTS)


def digests(segments: DataFrame) -> DataFrame:
    """What reading ``format_turns``' output back gives, one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        held = None  # conv_id, turns, digest, loss characters, digest, formatted characters

        def row() -> tuple:
            return held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5]

        for batch in batches:
            out = []
            for conv, formatted, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        out.append(row())
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(formatted)
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(formatted[a:b])
                held[3] += len(loss)
                held[4].update(loss.encode())
                held[5] += len(formatted)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), kinds, strict=True)], names=names)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_records(df: DataFrame, record: str = "record", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """JSON records of mixed layouts: ``keep``, layout, formatted, loss (array of [from, to) in code points)."""
    rows = df.select(*keep, F.col(record).cast("string").alias("__record"))
    out = rows.select(*keep).schema.add("layout", "string").add("formatted", "string")

    def parsed(value: str | None) -> object:
        try:
            return json.loads(value) if value else None
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts, texts, masks = [], [], []
            for value in batch.column(len(keep)).to_pylist():
                layout, turns = canonical_turns(parsed(value))
                text, mask = "", []
                for formatted, a, b in (render(*t) for t in turns):
                    if b > a:
                        mask.append([len(text) + a, len(text) + b])
                    text += formatted
                layouts.append(layout)
                texts.append(text)
                masks.append(mask)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.list_(pa.int32())))], names=[*keep, "layout", "formatted", "loss"])

    from pyspark.sql.types import ArrayType, IntegerType

    return rows.mapInArrow(run, out.add("loss", ArrayType(ArrayType(IntegerType()))))
