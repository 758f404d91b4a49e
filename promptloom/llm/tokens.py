"""Token counts by heap-and-linked-list byte-pair merging.

``count_tokens(df, model)`` counts the tokens of each whole text under a byte-level BPE without making
identifiers: each pre-token starts as its bytes in a doubly linked list, a heap gives the lowest-rank adjacent
pair again and again, and the count is the initial symbols less the merges made.

Cases: null and empty texts have 0 bytes and 0 tokens; null identifiers, repeated rows and extra columns pass
through as they are (one row out per row in); an empty table gives an empty result; a very long text or one
very long pre-token costs n log n. Added tokens of the file (special strings) inside a text count one each,
which is the library's default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import as_bytes, steps

#: Pre-tokens whose counts a worker remembers.
PIECES = 1_000_000
#: Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands
    for itself, the other bytes take code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load_bpe(path: str) -> dict:
    """Merge ranks of a ``tokenizers`` JSON file: {"start": id of each byte, "merges": {(a, b): (rank, id)},
    "added": special strings}. Bounded by the vocabulary."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
    return {"start": [vocab[s] for s in byte_symbols()], "merges": merges, "added": [t["content"] for t in spec.get("added_tokens", [])]}


def merged_size(piece: bytes, start: list[int], merges: dict) -> int:
    """Symbols left of ``piece`` when no merge applies any more."""
    ids = [start[b] for b in piece]
    n = size = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*merges[pair], i, *pair) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in merges]
    heapify(heap)
    while heap:
        _, made, i, a, b = heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of the two has been merged meanwhile
        ids[i], ids[j] = made, -1
        size -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (pair := (made, ids[k])) in merges:
                heappush(heap, (*merges[pair], i, *pair))
        h = before[i]
        if h >= 0 and (pair := (ids[h], made)) in merges:
            heappush(heap, (*merges[pair], h, *pair))
    return size


class PieceSizes(dict):
    """Memo from pre-token to its token count, emptied when full."""

    def __init__(self, model: dict):
        super().__init__()
        self.start, self.merges = model["start"], model["merges"]

    def __missing__(self, piece: str) -> int:
        if len(self) >= PIECES:
            self.clear()
        size = merged_size(piece.encode(), self.start, self.merges)
        if len(piece) <= 64:
            self[piece] = size
        return size


def text_counter(model: dict):
    """A function from text to its number of tokens."""
    import regex

    pieces, sizes = regex.compile(BYTE_LEVEL).findall, PieceSizes(model).__getitem__
    added = regex.compile("|".join(regex.escape(x) for x in sorted(model["added"], key=len, reverse=True))) if model["added"] else None

    def count(text: str) -> int:
        if added is None or not (cuts := added.findall(text)):
            return sum(map(sizes, pieces(text)))
        return len(cuts) + sum(sum(map(sizes, pieces(part))) for part in added.split(text))

    return count


def count_tokens(df: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """The ``keep`` columns with n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's text."""
    model = df.sparkSession.sparkContext.broadcast(load_bpe(model_path))
    rows = df.select(*(F.col(k) for k in keep), F.col(text).cast("string").alias("__text"))
    out = rows.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = text_counter(model.value)
        for batch in steps(batches, "__text"):
            texts = as_bytes(batch.column(len(keep)))
            n = [count(x.decode("utf-8", "replace")) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([len(x) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, out)
