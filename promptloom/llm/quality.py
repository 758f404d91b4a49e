"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Every feature of a word (the lower-cased word, its last three bytes, its shape) has a fixed sparse ternary index vector,
made from its hash; a word's index vector is their sum. The context vector of a word is the sum of the index vectors of its
neighbours, over the labelled sample, for the VOCABULARY most frequent words there. A document is the mean of its words' index and
context vectors, with the index vector of a mark for each word that repeats the one before it; then come a tanh layer and a logistic
output, whose temperature is set on a fifth of the sample that the weights have not seen.

Only the fit is bounded: FIT_ROWS labelled rows, those with the smallest hashes of doc_id, whose crc32(doc_id as text) mod 5 is not 0
("held out" otherwise), and of these, in that order, as many as have FIT_BYTES bytes of text. Every document is scored over its whole text, from its words alone.

Cases: null and empty texts have zero vectors and a score like any other; a null doc_id is not held out and never in the sample; rows with
a null label are none; with no labels, or one class only, the score is that class's smoothed share; repeated rows repeat; an empty
table gives an empty result; columns pass through.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._common import U64, as_bytes, steps, trim

DIMS, NONZERO, VOCABULARY, REACH = 64, 8, 20_000, 2
#: Words whose features a worker remembers.
WORDS = 250_000
FIT_ROWS, HIDDEN, ROUNDS, DECAY, THRESHOLD = 3000, 16, 400, 1e-3, 0.3
#: UTF-8 bytes of the sample's texts at most.
FIT_BYTES = 32 << 20
RUNS = re.compile(rb"(.)\1+", re.S)
SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def shape(word: bytes) -> bytes:
    """Kinds of characters with runs made one: upper A, lower a, digit 0, else the character."""
    return RUNS.sub(rb"\1", word.translate(SHAPES))


def vectors(hashes: np.ndarray) -> np.ndarray:
    """Index vectors of feature hashes: NONZERO entries of plus or minus one each."""
    out = np.zeros((len(hashes), DIMS), dtype=np.float32)
    rows = np.arange(len(hashes))
    for at, sign in entries(hashes):
        np.add.at(out, (rows, at), sign)
    return out


def entries(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k in range(NONZERO):
        at = ((hashes >> U64(6 * k)) & U64(DIMS - 1)).astype(np.int64)
        yield at, 1.0 - 2.0 * ((hashes >> U64(48 + k)) & U64(1)).astype(np.float64)


AGAIN = vectors(np.array([xxhash.xxh64_intdigest(b"again", 3)], dtype=U64))[0]


class Words(dict):
    """Memo from word to a row of feature hashes (and its row in the vocabulary); emptied when full."""

    def __init__(self, vocabulary: dict[bytes, int] | None = None, limit: int = WORDS):
        super().__init__()
        self.vocabulary, self.limit = vocabulary or {}, limit
        self.columns = [array("Q"), array("Q"), array("Q"), array("q")]

    def __missing__(self, word: bytes) -> int:
        digest = xxhash.xxh64_intdigest
        value = self[word] = len(self.columns[0])
        for column, x in zip(self.columns, (digest(word.lower(), 3), digest(word[-3:], 4), digest(shape(word), 5), self.vocabulary.get(word.lower(), -1)), strict=True):
            column.append(x)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
            self.columns = [array("Q"), array("Q"), array("Q"), array("q")]
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def pooled(texts: list[bytes], memo: Words, context: np.ndarray) -> np.ndarray:
    """Mean index and context vectors of each text."""
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    ids = memo.of([w for ws in words for w in ws])
    doc = np.repeat(np.arange(len(texts)), lengths)
    out = np.zeros((len(texts), 2 * DIMS))
    if not len(ids):
        return out
    *features, vocabulary = (np.array(c) for c in memo.columns)
    # A word that comes often in a text counts once, with its number.
    pair, count = np.unique(doc * len(vocabulary) + ids, return_counts=True)
    who, what = np.divmod(pair, len(vocabulary))
    for k in range(3):
        for at, sign in entries(features[k][what]):
            out[:, :DIMS] += np.bincount(who * DIMS + at, weights=sign * count, minlength=len(texts) * DIMS).reshape(-1, DIMS)
    again = np.bincount(doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
    out[:, :DIMS] += again[:, None] * AGAIN
    row = vocabulary[what]
    known = np.flatnonzero(row >= 0)
    for at in range(0, len(known), 1 << 14):
        part = known[at : at + (1 << 14)]
        heads = np.flatnonzero(np.diff(who[part], prepend=-1))
        out[who[part][heads], DIMS:] += np.add.reduceat(context[row[part]] * count[part, None].astype(np.float32), heads, axis=0)
    return out / np.maximum(1, lengths)[:, None]


def learn_context(texts: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """Vocabulary and unit context vectors of the labelled sample. Texts become numbers one by one, so only these are held at once."""
    memo = Words(limit=len(texts) and sum(map(len, texts)))
    parts = [memo.of(t.lower().split()).astype(np.int32) for t in texts]
    if not sum(map(len, parts)):
        return {}, np.zeros((0, DIMS), dtype=np.float32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in parts])
    ids, names = np.concatenate(parts), list(memo)
    counts = np.bincount(ids, minlength=len(names))
    chosen = np.lexsort((np.arange(len(names)), -counts))[:VOCABULARY]
    row = np.full(len(names), -1)
    row[chosen] = np.arange(len(chosen))
    hashes = [np.array(c) for c in memo.columns[:3]]
    index = np.concatenate([sum(vectors(h[k : k + 8192]) for h in hashes).astype(np.int8) for k in range(0, len(names), 8192)])
    context = np.zeros((len(chosen), DIMS))
    for reach in range(1, REACH + 1):
        for a, b in ((slice(reach, None), slice(None, -reach)), (slice(None, -reach), slice(reach, None))):
            same = (doc[a] == doc[b]) & (row[ids[a]] >= 0)
            pair, n = np.unique(row[ids[a][same]] * len(names) + ids[b][same], return_counts=True)
            for at in range(0, len(pair), 1 << 14):
                centre, near = np.divmod(pair[at : at + (1 << 14)], len(names))
                heads = np.flatnonzero(np.diff(centre, prepend=-1))
                context[centre[heads]] += np.add.reduceat(index[near] * n[at : at + (1 << 14), None], heads, axis=0)
    context /= np.maximum(1e-9, np.linalg.norm(context, axis=1))[:, None]
    return {names[i]: k for k, i in enumerate(chosen.tolist())}, context.astype(np.float32)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: list[int]) -> dict:
    """The classifier, a dictionary of arrays."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return {"constant": float(share)}
    vocabulary, context = learn_context(texts)
    memo = Words(vocabulary)
    x = np.concatenate([pooled(texts[k : k + 200], memo, context) for k in range(0, len(texts), 200)])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - mean) / scale, -8, 8)
    aside = np.arange(len(y)) % 5 == 4
    tx, ty = x[~aside], y[~aside]
    rng = np.random.default_rng(5)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for turn in range(1, ROUNDS + 1):
        h = np.tanh(tx @ p[0] + p[1])
        d = (logistic(h @ p[2] + p[3]) - ty) / len(ty)
        back = d[:, None] * p[2] * (1 - h * h)
        grads = [tx.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)
    z = np.tanh(x[aside] @ p[0] + p[1]) @ p[2] + p[3]
    loss = lambda t: -np.mean(np.log(np.where(y[aside] == 1, logistic(z / t), 1 - logistic(z / t)) + 1e-12))
    temperature = min(np.geomspace(0.25, 8, 41), key=loss) if aside.any() else 1.0
    return {"vocabulary": vocabulary, "context": context, "mean": mean, "scale": scale, "weights": p, "temperature": float(temperature)}


def scores(model: dict, texts: list[bytes], memo: Words) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    x = np.clip((pooled(texts, memo, model["context"]) - model["mean"]) / model["scale"], -8, 8)
    p = model["weights"]
    # Sums depend on the order of a batch's words in their last digits, so scores are given to six places.
    return np.round(logistic((np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]) / model["temperature"]), 6)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> dict:
    """Fits on the bounded sample: ``rows`` labelled rows that are not held out, ``size`` bytes at most."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__q_id")).agg(F.max(label).alias("__q_label"))
    chosen = chosen.orderBy(F.xxhash64("__q_id"), "__q_id").limit(rows)  # rows * 2 numbers, so it may be broadcast
    found = docs.select(F.col(id_col).alias("__q_doc"), F.col(text).cast("string").alias("__q_text")).join(F.broadcast(chosen), F.col("__q_doc") == F.col("__q_id"))
    found = found.groupBy("__q_id").agg(F.max("__q_label").alias("y"), F.min("__q_text").alias("t"))
    # A window over the sample alone, ``rows`` rows at most.
    so_far = Window.orderBy(F.xxhash64("__q_id"), "__q_id").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("__q_sum", F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).over(so_far)).where(F.col("__q_sum") <= size)
    texts, labels_ = [], []
    for r in sorted(found.select("__q_id", "y", "t").collect(), key=lambda r: xxhash.xxh64_intdigest(str(r[0]))):
        texts.append((r.t or "").encode())
        labels_.append(int(r.y))
    model = fit(texts, labels_)
    trim()
    return model


def score_quality(docs: DataFrame, model: dict, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the column ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words(held.value.get("vocabulary"))
        for batch in steps(batches, text):
            got = scores(held.value, as_bytes(batch.column(at)), memo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, score])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    scored = score_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")), fit_on(docs, labels, id_col, text))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
