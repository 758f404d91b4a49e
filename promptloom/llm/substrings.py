"""Substring dedup by relative Lempel-Ziv parsing against an index of every document's blocks.

A window is ``WINDOW`` consecutive words of one document. A word goes if it lies in a window whose word
sequence also starts in a document with a smaller doc_id.

1. Blocks. The least-hashed ``SEED``-word seed of a window is its anchor; equal windows have equal anchors at
   equal places, and neighbouring windows mostly share theirs. A reference block is the run of windows of one
   document with one anchor. ``block_index`` sends each block, as 48 anchor bits and 40 bits of each window
   (88 bits and the seed's order, so that equal keys are equal windows), to the index shard of its anchor.
   Windows already seen under a smaller doc_id in one step of a map task, or again and again in earlier steps of it, are settled
   there and not sent, so a passage in a third of all documents costs a shard one window a task, not one a document.
2. Factors. Each shard sorts its windows by key, doc_id and place, and points every window to its first
   occurrence under the smallest doc_id. Runs that advance in step in the document and in that reference
   become factors (reference doc_id, place in it, length).
3. ``parse`` factors a document greedily: at each place the longest factor that starts there; then, as a factor
   may end inside a window that another reference covers, the factors that start within the last WINDOW - 1 words
   are checked at the boundary. Factors are WINDOW words long at least and are the duplicate spans.

Scale: two shuffles, about 7 bytes a word and the text once; nothing grows with the square of a group.
Decisions stream into the rows of their document, sorted, so no task holds more than a document at once.

Cases: null and empty texts have no words; rows with a null doc_id are judged against all others and are nobody's
reference, as are rows with an equal doc_id among each other (they are told apart by 64 bits of their texts); repeated rows get equal results, one each; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ._common import U64, WordHashes, as_bytes, mix, partitions, ranges, rolling, steps, trim

WINDOW, SEED = 13, 5
#: Stands for a null doc_id: larger than all others.
NONE = np.iinfo(np.int64).max
#: Index shards a shuffle partition; bounds what one shard's sort holds.
SHARDS = 8
#: Windows that a map task remembers because they came more than once in a step.
OFTEN = 200_000


def tag(text: bytes) -> int:
    """64 bits of a text, as a signed number, to tell rows with one doc_id (or none) apart."""
    return xxhash.xxh64_intdigest(text, 11) - (1 << 63)


def anchored(hashes: np.ndarray, lengths: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(document, start within it, anchor hash, window hash) of every window of the concatenated documents."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    first = np.cumsum(lengths) - lengths
    full = rolling(hashes, list(range(window)), 2)
    seeds = rolling(hashes, list(range(seed)), 1)
    m = len(full)
    best, at = seeds[:m].copy(), np.arange(m, dtype=np.int32)
    for k in range(1, window - seed + 1):
        other = seeds[k : k + m]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    within = np.flatnonzero(doc[:m] == doc[window - 1 : n]) if m else np.zeros(0, dtype=np.int64)
    return doc[within], within - first[doc[within]], best[within], full[within], at[within]


def first_occurrences(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows whose key also has a smaller doc, and the doc and start of the key's first occurrence."""
    order = np.lexsort((start, doc, k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = doc[order] > doc[head]
    return order[later], doc[head[later]], start[head[later]]


class Often:
    """Windows that came more than once in a step of this task, with their first occurrence under the smallest doc_id so far.

    A later window of the same words under a larger doc_id is settled by it and need not be sent, so that a passage which all
    documents share costs a shard one window a task. What is remembered is bounded; forgetting costs data, no result.
    """

    def __init__(self, most: int = OFTEN):
        self.most = most
        self.k1 = self.k2 = np.zeros(0, dtype=U64)
        self.doc = self.start = np.zeros(0, dtype=np.int64)

    def settled(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose window is remembered under a smaller doc_id, and that doc_id and its start."""
        if not len(self.k1):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        at = np.minimum(np.searchsorted(self.k2, k2), len(self.k2) - 1)
        hit = np.flatnonzero((self.k2[at] == k2) & (self.k1[at] == k1) & (self.doc[at] < doc))
        return hit, self.doc[at[hit]], self.start[at[hit]]

    def learn(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        """First occurrences of windows that came again."""
        if len(self.k1) + len(k1) > self.most:
            self.__init__(self.most)
        k1, k2, doc, start = (np.concatenate(v)[: self.most] for v in ((self.k1, k1), (self.k2, k2), (self.doc, doc), (self.start, start)))
        # One window for each k2; another one of the same k2 is just not remembered.
        order = np.lexsort((start, doc, k1, k2))
        order = order[np.flatnonzero(np.diff(k2[order], prepend=~k2[order][:1]) != 0)]
        self.k1, self.k2, self.doc, self.start = k1[order], k2[order], doc[order], start[order]


def factor_runs(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, ref: np.ndarray, ref_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows joined to runs that advance in step: (doc, mark, start, windows, reference, its start)."""
    order = np.lexsort((start, mark, doc))
    doc, mark, start, ref, ref_start = (v[order] for v in (doc, mark, start, ref, ref_start))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(mark) != 0) | (np.diff(start) != 1) | (np.diff(ref) != 0) | (np.diff(ref_start) != 1)
    at = np.flatnonzero(new)
    return doc[at], mark[at], start[at], np.diff(np.append(at, len(order))), ref[at], ref_start[at]


def pack(parts: dict[str, np.ndarray]) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(v) for v in parts.values()], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(v.tobytes() for v in parts.values()))


def unpack(value: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, dtype=np.int64, count=len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += out[-1].nbytes
    return out


#: Of blocks: doc_id steps, tags, starts, windows each. Of settled factors: the six arrays of factor_runs.
BLOCK_KINDS, FACTOR_KINDS = ["<i8", "<i8", "<i4", "<u2"], ["<i8", "<i8", "<i4", "<i4", "<i8", "<i4"]


def low_bytes(values: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(raw: bytes, n: int) -> np.ndarray:
    wide = np.zeros((len(raw) // n, 8), dtype=np.uint8)
    wide[:, :n] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
    return wide.reshape(-1).view("<u8")


def block_rows(ids: np.ndarray, tags: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, shards: int, window: int, seed: int, often: Often) -> list[tuple]:
    """(shard, anchors, windows, blocks, factors) rows of one step; ids ascend."""
    doc, start, anchor, full, place = anchored(hashes, lengths, window, seed)
    if not len(doc):
        return []
    k1, k2 = anchor & U64((1 << 48) - 1), full & U64((1 << 40) - 1)
    rows = []
    at, ref, ref_start = often.settled(k1, k2, ids[doc])
    rest = np.ones(len(doc), dtype=bool)
    rest[at] = False
    rest = np.flatnonzero(rest)
    again, first, first_start = first_occurrences(k1[rest], k2[rest], ids[doc[rest]], start[rest])
    again = rest[again]
    often.learn(k1[again], k2[again], first, first_start)
    at, ref, ref_start = np.concatenate([at, again]), np.concatenate([ref, first]), np.concatenate([ref_start, first_start])
    if len(at):
        got = factor_runs(ids[doc[at]], tags[doc[at]], start[at], ref, ref_start)
        shard = int(got[2][0] + got[0][0]) % shards
        rows.append((shard, None, None, None, pack({str(k): v.astype(t) for k, (v, t) in enumerate(zip(got, FACTOR_KINDS, strict=True))})))
    keep = np.ones(len(doc), dtype=bool)
    keep[at] = False
    doc, start, k1, k2, place = doc[keep], start[keep], k1[keep], k2[keep], place[keep]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(doc) != 0) | (np.diff(start) != 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(doc)))
    shard = (mix(k1[head]) % U64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    head, count, shard = head[order], count[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
        h, c = head[a:b], count[a:b]
        who = ids[doc[h]]
        parts = {"doc": np.diff(who, prepend=0), "tag": tags[doc[h]], "start": start[h].astype("<i4"), "n": c.astype("<u2")}
        rows.append((int(shard[a]), low_bytes(k1[h], 6), low_bytes(k2[ranges(h, c)], 5), pack(parts), None))
    return rows


INDEX = "shard int, anchors binary, windows binary, blocks binary, factors binary"
FACTORS = "doc_id long, mark long, start int, n int, ref_doc long, ref_start int"


def block_index(docs: DataFrame, shards: int, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Reference blocks of (doc_id, __text), packed by step and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, often = WordHashes(), Often()
        for batch in steps(batches, "__text"):
            ids = np.array([NONE if x is None else x for x in batch.column(0).to_pylist()], dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            texts = as_bytes(batch.column(1))
            texts = [texts[k] for k in order]
            words = [x.split() for x in texts]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            hashes = memo.of([w for ws in words for w in ws])
            rows = block_rows(ids[order], np.array([tag(x) for x in texts], dtype="<i8"), hashes, lengths, shards, window, seed, often)
            kinds = [pa.int32(), *[pa.binary()] * 4]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])

    return docs.mapInArrow(run, INDEX)


def index_factors(index: DataFrame, parts: int) -> DataFrame:
    """Factors of all documents against the whole index: one task's shards one after the other."""

    def emit(got: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        doc, mark, start, n, ref, ref_start = got
        arrays = [pa.array(doc, pa.int64()), pa.array(mark.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ref, pa.int64()), pa.array(ref_start.astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in FACTORS.split(", ")])

    def shard_factors(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        k1, k2, doc, mark, start = [], [], [], [], []
        for anchors, windows, blocks in rows:
            steps_, tags, starts, n = unpack(blocks, BLOCK_KINDS)
            n = n.astype(np.int64)
            k1.append(np.repeat(from_low_bytes(anchors, 6), n))
            k2.append(from_low_bytes(windows, 5))
            doc.append(np.repeat(np.cumsum(steps_), n))
            mark.append(np.repeat(tags, n))
            start.append(ranges(starts.astype(np.int64), n))
        k1, k2, doc, mark, start = map(np.concatenate, (k1, k2, doc, mark, start))
        at, ref, ref_start = first_occurrences(k1, k2, doc, start)
        if len(at):
            got = factor_runs(doc[at], mark[at], start[at], ref, ref_start)
            del k1, k2, doc, mark, start, at, ref, ref_start
            yield emit(got)
        trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for s, anchors, windows, blocks, factors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if factors is not None:
                    yield emit(tuple(unpack(factors, FACTOR_KINDS)))
                    continue
                if s != shard:
                    yield from shard_factors(rows)
                    shard, rows = s, []
                rows.append((anchors, windows, blocks))
        yield from shard_factors(rows)

    return index.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, FACTORS)


def parse(factors: list[tuple[int, int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy parse of one document: (start, words, reference, its start), starts ascending.

    ``factors``: (start, windows, reference, its start). Those that advance in step with the one before them are
    joined; those that end before the parse has come to are left out.
    """
    out: list[tuple[int, int, int, int]] = []
    for start, n, ref, ref_start in sorted(factors, key=lambda f: (f[0], -f[1], f[2], f[3])):
        size = n + window - 1
        if out:
            s, had, r, rs = out[-1]
            if r == ref and start - s == ref_start - rs and start <= s + had:
                out[-1] = (s, max(had, start + size - s), r, rs)
                continue
            if start + size <= s + had:
                continue
        out.append((start, size, ref, ref_start))
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space),
    kept_text, and spans: the parse's factors as arrays (start word, words, reference doc_id, its start word)."""
    parts = partitions(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    factors = index_factors(block_index(rows, parts * SHARDS, window, seed), parts)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = pa.array([tag(x) for x in as_bytes(batch.column(1))], pa.int64())
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids.fill_null(NONE), tags, ids.is_null(), batch.column(1)], names=["doc_id", "mark", "none", "__text"])

    texts = rows.mapInArrow(mark, "doc_id long, mark long, none boolean, __text string")
    none = F.lit(None)
    both = texts.select(F.lit(1).alias("kind"), "doc_id", "mark", "none", "__text", *(none.cast(t).alias(c) for c, t in (("start", "int"), ("n", "int"), ("ref_doc", "long"), ("ref_start", "int"))))
    both = both.union(factors.select(F.lit(0), "doc_id", "mark", none.cast("boolean"), none.cast("string"), "start", "n", "ref_doc", "ref_start"))
    both = both.repartition(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "kind", "start")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            kind, doc, mark_ = (batch.column(k).to_pylist() for k in range(3))
            none_, texts_ = batch.column(3).to_pylist(), as_bytes(batch.column(4))
            found = list(zip(*(batch.column(k).to_pylist() for k in range(5, 9)), strict=True))
            out = []
            for k in range(batch.num_rows):
                if (doc[k], mark_[k]) != key:
                    key, held = (doc[k], mark_[k]), []
                if kind[k] == 0:
                    held.append(found[k])
                    continue
                words = texts_[k].split()
                spans = parse(held, window)
                keep = np.ones(len(words), dtype=bool)
                for start, size, _, _ in spans:
                    keep[start : start + size] = False
                kept = b" ".join(compress(words, keep.tolist()))
                out.append((None if none_[k] else doc[k], len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), [list(s) for s in spans]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"])
            del batch, kind, doc, mark_, none_, texts_, found, out
            trim()

    return both.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<array<long>>")
