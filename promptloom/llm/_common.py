"""Shared pieces of the corpus operators: checkpoints, ASCII-white-space words, word hashes, batching.

All operators select the columns they need by name first, so extra columns, whatever they are called, cannot
clash with internal ones. Words are maximal runs of anything but the six ASCII white-space bytes, which is
what ``bytes.split()`` gives for UTF-8.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step of a vectorised operator works on at a time.
STEP_BYTES = 2 << 20
#: Entries after which a worker's memo of words is emptied.
MEMO_LIMIT = 300_000
U64 = np.uint64
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_folder(session: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and driver and executors are one process, a temporary folder
    is made.
    """
    sc = session.sparkContext
    if sc.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def remove(session: SparkSession, folder: str) -> None:
    """Deletes a folder that this library wrote, in whichever store it is."""
    path = session._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on after a task, and an executor's share is small."""
    if TRIM is not None:
        TRIM(0)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about STEP_BYTES of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.schema.get_field_index(text)
        sizes = pc.fill_null(pc.binary_length(batch.column(at).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(sizes, dtype=np.int64) // STEP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
                trim()


class WordHashes(dict):
    """Memo from a word's bytes to its 64-bit hash; emptied when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants for order-sensitive sums of word hashes."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def rolling(hashes: np.ndarray, offsets: list[int], seed: int) -> np.ndarray:
    """For each i the mixed hash of the words at i + offsets; as many as fit."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    for at, factor in zip(offsets, multipliers(len(offsets), seed), strict=True):
        total += hashes[at : at + n] * factor
    return mix(total)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
