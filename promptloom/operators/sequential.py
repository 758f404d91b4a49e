"""Operators whose next step depends on their last decision: one pass over sorted rows with bounded state.

Rows go to the partition of their key and are sorted there (the sort spills), and a Python generator goes through them once. It holds the
state of one key only, so a key of any number of rows needs no more memory than another.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, LEAST, MEAN_FLOOR, TAIL_FLOOR, TAIL_RATE, DAY = 200, 10, 0.95, 0.85, 0.02, 86_400


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple], out: str) -> DataFrame:
    """For each row, in the order of its key, what ``step(state, row)`` returns; ``start()`` makes a key's state."""
    columns = df.columns
    names = [c.split()[0] for c in out.split(", ")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(columns, values, strict=True))
                own = tuple(row[k] for k in keys)
                if own != key or state is None:
                    key, state = own, start()
                rows.append(step(state, row))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in out.split(", ")]
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


class Breaker:
    """Rolling parity of one cell. Every evaluation while open is a violation; the second within a day disables the cell for good."""

    def __init__(self):
        self.samples: deque[int] = deque(maxlen=WINDOW)
        self.violations, self.last, self.state = 0, None, "CLOSED"

    def add(self, at: float, parity_bp: int) -> str:
        if self.state == "DISABLED":
            return self.state
        self.samples.append(parity_bp)
        n = len(self.samples)
        opened = n >= LEAST and (sum(self.samples) < round(MEAN_FLOOR * 10_000) * n or sum(p < TAIL_FLOOR * 10_000 for p in self.samples) > TAIL_RATE * n)
        if not opened:
            self.state = "CLOSED"
            return self.state
        self.violations = self.violations + 1 if self.last is not None and at - self.last < DAY else 1
        self.last = at
        self.state = "DISABLED" if self.violations >= 2 else "OPEN"
        return self.state


def circuit_states(log: DataFrame) -> DataFrame:
    """(request_id, state) after each parity sample of log (request_id, cell, at seconds, parity_bp)."""
    return fold(log.select("request_id", "cell", "at", "parity_bp"), ["cell"], ["at", "request_id"], Breaker, lambda s, r: (r["request_id"], s.add(r["at"], r["parity_bp"])), "request_id long, state string")


class Quota:
    def __init__(self):
        self.requests = self.tokens = 0

    def check(self, tokens: int, most_requests: int | None, most_tokens: int | None) -> int:
        if (most_requests is not None and self.requests >= most_requests) or (most_tokens is not None and self.tokens + tokens > most_tokens):
            return 0
        self.requests += 1
        self.tokens += tokens
        return 1


def quota_decisions(log: DataFrame, most_requests: int | None, most_tokens: int | None) -> DataFrame:
    """(request_id, optimised) of log (request_id, tenant_id, day, at, tokens); refused requests do not count."""
    step = lambda s, r: (r["request_id"], s.check(r["tokens"], most_requests, most_tokens))
    return fold(log.select("request_id", "tenant_id", "day", "at", "tokens"), ["tenant_id", "day"], ["at", "request_id"], Quota, step, "request_id long, optimised int")
