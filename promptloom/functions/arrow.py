"""The few functions that need Python, as vectorised Arrow UDFs."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

PERMUTATIONS, MODULUS = 128, (1 << 32)
SHINGLE = 5
#: Shingles that one step compares with all permutations.
STEP = 4096
#: Shingles whose hashes a worker remembers.
GRAMS = 500_000


# Seed, multiplier and increment of the generator of the hash family.
HASH_SEED, LCG_FACTOR, LCG_STEP = 0x49544F4C, 6364136223846793005, 1442695040888963407


def permutations(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets below 2**31: the high bits of a 64-bit linear congruential generator, in turns."""
    state, drawn = HASH_SEED, []
    for _ in range(2 * n):
        state = (LCG_FACTOR * state + LCG_STEP) % (1 << 64)
        drawn.append(state >> 33)
    return np.array(drawn[::2], dtype=np.uint64) | np.uint64(1), np.array(drawn[1::2], dtype=np.uint64)


A, B = permutations()


class Grams(dict):
    """Memo from a shingle to its 32-bit hash; emptied when full, so its memory is bounded."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= GRAMS:
            self.clear()
        value = self[gram] = int.from_bytes(hashlib.md5(gram.encode()).digest()[:4], "little")
        return value


GRAM_HASHES = Grams()


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct 32-bit hashes of the lower-case character 5-grams; a shorter text is one shingle."""
    low = (text or "").lower()
    grams = {low[i : i + SHINGLE] for i in range(len(low) - SHINGLE + 1)} or {low}
    return np.fromiter(map(GRAM_HASHES.__getitem__, grams), dtype=np.uint64, count=len(grams))


def signature(text: str | None) -> list[int]:
    """MinHash signature in bounded steps, so that a very long text needs no more memory."""
    hashes, best = shingle_hashes(text), np.full(PERMUTATIONS, MODULUS, dtype=np.uint64)
    for at in range(0, len(hashes), STEP):
        part = (A[:, None] * hashes[None, at : at + STEP] + B[:, None]) & np.uint64(MODULUS - 1)
        best = np.minimum(best, part.min(axis=1))
    return best.astype(np.int64).tolist()


@F.pandas_udf(ArrayType(LongType()))
def minhash(text: pd.Series) -> pd.Series:
    return text.map(signature)


@F.pandas_udf(LongType())
def shingle_count(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(shingle_hashes(t)))


WORDS = re.compile(r"\w+")


def density(text: str | None) -> float:
    """0.7 of the compression ratio (1 at most) and 0.3 of the share of different words; 1 if empty."""
    if not text:
        return 1.0
    raw = text.encode()
    found = WORDS.findall(text.lower())
    unique = len(set(found)) / len(found) if found else 1.0
    return 0.7 * min(len(zlib.compress(raw, 6)) / len(raw), 1.0) + 0.3 * unique


@F.pandas_udf(DoubleType())
def semantic_density(text: pd.Series) -> pd.Series:
    return text.map(density)


def minify(text: str | None) -> str | None:
    """Compact JSON if it parses, reads back equal and is shorter; else the text."""
    try:
        value = json.loads(text)
        short = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        return short if len(short) < len(text) and json.loads(short) == value else text
    except (TypeError, ValueError):
        return text


@F.pandas_udf(StringType())
def json_minify(text: pd.Series) -> pd.Series:
    return text.map(minify)


#: ASCII words, and the white space that the JVM's Unicode patterns know.
LETTERS, BLANKS = re.compile("[a-z]+"), re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split_words(text: str) -> list[str]:
    """White-space separated words, as ``text.words`` gives them."""
    return [w for w in BLANKS.split(text) if w]


def counts_cosine(x: Counter, y: Counter) -> float:
    if not x or not y:
        return 0.0
    inner = sum(n * y[w] for w, n in x.items() if w in y)
    return inner / (sum(n * n for n in x.values()) ** 0.5 * sum(n * n for n in y.values()) ** 0.5)


def bag_cosine(a: str | None, b: str | None) -> float:
    """Cosine of the numbers of lower-case ASCII words: a bag of words that needs no vocabulary; 0 if either has none."""
    return counts_cosine(*(Counter(LETTERS.findall((t or "").lower())) for t in (a, b)))


@F.pandas_udf(DoubleType())
def text_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bag_cosine(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one row of memory."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    names = np.array(b, dtype=object)
    for x in a:
        step = np.where(names == x, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


def rouge(a: str | None, b: str | None) -> float:
    x, y = (a or "").lower().split(), (b or "").lower().split()
    if not x or not y:
        return float(not x and not y)
    common = lcs(x, y)
    return 2 * common / (len(x) + len(y)) if common else 0.0


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(LongType())
def common_prefix_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(commonprefix([(x or "").encode(), (y or "").encode()])) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def beta_draw(alpha: pd.Series, beta: pd.Series, seed: pd.Series) -> pd.Series:
    """A posterior draw for Thompson sampling, fixed by its seed."""
    return pd.Series([np.random.default_rng(int(s) & (1 << 63) - 1).beta(a, b) for a, b, s in zip(alpha, beta, seed, strict=True)])


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; stays in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(PERMUTATIONS))
