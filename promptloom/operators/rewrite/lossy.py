"""S7: bounded dropping of rare words that no constraint protects."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ...functions import arrow as P

MAX_DENSITY, RATIO, MAX_RATIO = 0.45, 1.5, 2.0
#: Punctuation that is no part of a word at its ends.
EDGES = ".,;:!?\"'()"


def applies(opted_in: Column, status: Column, tokens: Column, budget: Column, density: Column) -> Column:
    return opted_in & (status != "DISABLED") & (tokens > budget) & (density < MAX_DENSITY)


def protected(word: Column, values: Column) -> Column:
    """Whether the word, without punctuation at its ends, is part of a value or a value is part of it, in any case."""
    low = F.regexp_replace(F.lower(word), r"""^[.,;:!?"'()]+|[.,;:!?"'()]+$""", "")
    return F.exists(values, lambda v: F.contains(F.lower(v), low) | F.contains(low, F.lower(v)))


def drop_rare(texts: DataFrame, values: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(id, text, n_words, n_dropped): whole words of texts (id, text) are dropped, rarest first (then by first place), until at least
    n - floor(n / ratio) words are gone; if none would be left, all stay; values (id, values array) protect.

    A text is one row, so its words are counted and dropped there: only ids meet. Texts without words are left out. A ratio over MAX_RATIO
    counts as that.
    """
    ratio = min(ratio, MAX_RATIO)
    rows = texts.select("id", "text").join(values.select("id", "values"), "id", "left")

    def cut(text: str | None, keep: list[str]) -> tuple[str, int, int] | None:
        words = P.split_words(text or "")
        if not words:
            return None
        keep = [v.lower() for v in keep if v is not None]
        bare = {w: w.lower().strip(EDGES) for w in words}
        loose = Counter(w for w in words if not any(bare[w] in v or v in bare[w] for v in keep))
        target, gone, went = len(words) - max(1, floor(len(words) / ratio)), set(), 0
        for w in sorted(loose, key=loose.__getitem__):  # stable, so by first place
            if went >= target:
                break
            gone.add(w)
            went += loose[w]
        if went >= len(words):
            gone, went = set(), 0
        return " ".join(w for w in words if w not in gone), len(words), went

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [cut(t, v or []) for t, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            there = pa.array([g is not None for g in got], pa.bool_())
            parts = list(zip(*(g for g in got if g is not None), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(there), pa.array(parts[0], pa.string()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.int64())], names=["id", "text", "n_words", "n_dropped"])

    out = StructType([StructField("id", texts.schema["id"].dataType), StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_dropped", LongType())])
    return rows.mapInArrow(run, out)
