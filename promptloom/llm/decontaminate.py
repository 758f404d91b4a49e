"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask hashes the words at its ones and ignores those at its zeros, so a substituted word under a zero
does not hide an overlap. A run of ones, as long as the run of equal words that any overlap which counts must have, makes the seeds
complete: 4 words for most items, 3 for items of 10 or 11 words. Training hashes that are also benchmark hashes are hits; around each hit (document,
item, alignment) the words are compared one by one, and the overlap counts if a window of ``window`` words (the whole item, if
that is shorter) has at least ``share`` of its words equal. Words are lower-cased, ASCII punctuation is white space.

The benchmark is taken in blocks of BLOCK_WORDS words at most (one item at least), each one broadcast of bounded size and one scan
of the documents, so a benchmark of any size is met exactly and no document is ever shuffled.

Cases: null and empty texts have no overlaps; an item of fewer than MIN_ITEM words counts only where all of them are equal; an
empty or null item is no evidence; repeated
documents and items are reported each; with an empty benchmark nothing is contaminated; columns pass through.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ._common import U64, WordHashes, ranges, rolling, steps

SPACED = ("11101011", "1100101011", "110100100111")
#: With the runs that WINDOW and SHARE need; an item is hashed by the spaced masks and by its own run.
MASKS = (*SPACED, "1111", "111")
WINDOW, SHARE, MIN_ITEM, BLOCK_WORDS = 13, 0.8, 8, 500_000
#: Hits whose alignments are made distinct at a time; a seed with more is marked on a map of its item's alignments.
HITS_HELD = 1 << 18
#: Bits of the table that keeps most words away from the exact lookup.
FILTER_BITS = 20
HITS = "array<struct<item_id:bigint,start:int,n_words:int,n_equal:int>>"
PLAIN = bytes(32 if chr(b) in string.punctuation else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(PLAIN).split()


def offsets(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def rule(n: int, window: int = WINDOW, share: float = SHARE) -> tuple[int, int]:
    """(words, equal words) of the smallest overlap that counts for an item of ``n`` words."""
    size = min(window, n)
    return size, size if n < MIN_ITEM else max(1, int(np.ceil(share * size - 1e-9)))


def run_length(n: int, window: int = WINDOW, share: float = SHARE) -> int:
    """The longest run of equal words that every overlap which counts has: unequal words part the equal ones."""
    size, need = rule(n, window, share)
    return -(-need // (size - need + 1))


class Seeds:
    """Spaced-seed hashes of one block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], masks: tuple[str, ...] = SPACED, window: int = WINDOW, share: float = SHARE):
        memo = WordHashes()
        self.names = [name for name, _ in items]
        self.words = [memo.of(w) for _, w in items]
        runs = [run_length(len(w), window, share) for w in self.words]
        lengths = [None] * len(masks) + sorted(set(runs))
        self.masks, self.tables = [offsets(m) for m in masks] + [list(range(n)) for n in sorted(set(runs))], []
        for k, (at, length) in enumerate(zip(self.masks, lengths, strict=True)):
            got = [rolling(w if length in (None, n) else w[:0], at, k) for w, n in zip(self.words, runs, strict=True)]
            hashes = np.concatenate([np.zeros(0, dtype=U64), *got])
            sizes = np.array([len(g) for g in got], dtype=np.int64)
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, dtype=bool)
            seen[hashes >> U64(64 - FILTER_BITS)] = True
            self.tables.append((hashes[order], np.repeat(np.arange(len(got)), sizes)[order], ranges(np.zeros(len(got), dtype=np.int64), sizes)[order], seen))

    def alignments(self, hashes: np.ndarray) -> np.ndarray:
        """Distinct (item, place of the item's first word) rows over concatenated documents' word hashes."""
        shift = max((len(w) for w in self.words), default=0)
        span = len(hashes) + 2 * shift
        found = np.zeros(0, dtype=np.int64)  # item * span + place + shift
        for k, (at, (keys, item, place, seen)) in enumerate(zip(self.masks, self.tables, strict=True)):
            got = rolling(hashes, at, k)
            near = np.flatnonzero(seen[got >> U64(64 - FILTER_BITS)])
            a, b = np.searchsorted(keys, got[near], side="left"), np.searchsorted(keys, got[near], side="right")
            # A seed that repeats in the text and in an item has many hits on few diagonals: these are marked, not listed.
            first, back, times = np.unique(a, return_inverse=True, return_counts=True)
            often = (times * np.diff(np.append(first, len(keys))) > HITS_HELD) if len(first) else np.zeros(0, dtype=bool)
            for f in np.flatnonzero(often).tolist():
                own = back == f
                places, to = near[own], int(b[own][0])
                for i in np.unique(item[first[f] : to]).tolist():
                    marked = np.zeros(span, dtype=bool)
                    for q in place[first[f] : to][item[first[f] : to] == i].tolist():
                        marked[places - q + shift] = True
                    found = np.concatenate([found, i * span + np.flatnonzero(marked)])
            rest = ~often[back] if len(first) else np.zeros(0, dtype=bool)
            near, a, n = near[rest], a[rest], (b - a)[rest]
            total = np.concatenate([[0], np.cumsum(n)])
            at = 0
            while at < len(near):
                to = max(at + 1, int(np.searchsorted(total, total[at] + HITS_HELD, side="right")) - 1)
                entry = ranges(a[at:to], n[at:to])
                found = np.unique(np.concatenate([found, item[entry] * span + np.repeat(near[at:to], n[at:to]) - place[entry] + shift]))
                at = to
        found = np.unique(found)
        return np.stack([found // max(1, span), found % max(1, span) - shift], axis=1)


def overlap(doc: np.ndarray, item: np.ndarray, at: int, window: int = WINDOW, share: float = SHARE) -> tuple[int, int, int] | None:
    """(start in the document, words, equal words) of the overlap with the item's first word at place ``at``."""
    a, b = max(0, at), min(len(doc), at + len(item))
    size, need = rule(len(item), window, share)
    if b - a < size:
        return None
    equal = doc[a:b] == item[a - at : b - at]
    total = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(total[size:] - total[:-size] >= need)
    if not len(good):
        return None
    edges = np.zeros(len(equal) + 1, dtype=np.int64)
    edges[good] = 1
    edges[good + size] -= 1
    where = np.flatnonzero((np.cumsum(edges[:-1]) > 0) & equal)
    return a + int(where[0]), int(where[-1] - where[0]) + 1, len(where)


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        words = words_of(row.t)
        if not words:
            continue
        if held and size + len(words) > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append((row.i, words))
        size += len(words)
    if held:
        yield held


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", hits: str = "contamination", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``docs`` with the column ``hits``: for each item that a text overlaps, item_id, start word, words and equal words of
    the alignment with the most equal words (the first of these). A column that is called like ``hits`` is replaced."""
    out = docs.withColumn(hits, F.array().cast(HITS))
    for block in blocks(benchmark, item_id, item_text):
        out = scan(out, docs.sparkSession.sparkContext.broadcast(block), text, hits, window, share)
    return out


def scan(docs: DataFrame, block, text: str, hits: str, window: int, share: float) -> DataFrame:
    at, own = docs.columns.index(text), docs.columns.index(hits)
    schema: StructType = docs.schema
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("n_equal", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, memo = Seeds(block.value, window=window, share=share), WordHashes()
        for batch in steps(batches, text):
            words = [words_of(t) for t in batch.column(at).to_pylist()]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            ends = np.cumsum(lengths)
            hashes = memo.of([w for ws in words for w in ws])
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for item, place in seeds.alignments(hashes).tolist():
                # The hit lies in the document of some word of the item; an alignment may touch two documents.
                a, b = np.searchsorted(ends, [max(0, place), min(len(hashes), place + len(seeds.words[item])) - 1], side="right")
                for d in range(a, b + 1):
                    first = int(ends[d] - lengths[d])
                    if (d, item) in best and best[d, item][2] == len(seeds.words[item]):
                        continue  # places ascend, so nothing better comes
                    got = overlap(hashes[first : ends[d]], seeds.words[item], place - first, window, share)
                    if got and (-got[2], got[0]) < (lambda g: (-g[2], g[0]))(best.get((d, item), (1 << 60, 0, -1))):
                        best[d, item] = got
            found = batch.column(own).to_pylist()
            for (d, item), (start, n, equal) in sorted(best.items()):
                found[d] = [*(found[d] or []), {"item_id": seeds.names[item], "start": start, "n_words": n, "n_equal": equal}]
            columns = batch.columns
            columns[own] = pa.array(found, kind)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item."""
    mark = "__contamination"
    while mark in docs.columns:
        mark += "_"
    return find_overlaps(docs, benchmark, text, hits=mark, **options).where(F.size(mark) == 0).drop(mark)
