"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in the order of a hash of doc_id and text, form blocks of ``block`` rows. Block j of a source with weight w is released at
slot floor(j / w) and due at slot ceil((j + 1) / w); the earliest deadline among released blocks gets each slot, so at every slot
a source is less than one block away from its share. Weights are taken exactly, in whole numbers, and all blocks are scheduled. With a ``quantum``
weights are whole shares of so many slots instead, and one period of them repeats. When a source runs
out, the rest go on with their weights scaled up (a new phase); no row is dropped or repeated.

Every source is scheduled by its own weight. Of more than MAX_SOURCES sources, the smaller ones that have equally many rows and equal
weights form one entry of the schedule, with the sum of their weights, in which they take turns row by row, in the order of a hash of their names:
that is Pfair for equal weights, and as they run out together the phases are those of each source on its own.

Scale: the driver holds one number for each of MAX_SOURCES sources and for each different size and weight among the smaller ones (of n rows
in all, fewer than the root of 2n sizes); which of these a row belongs to is joined from a table of sources. One task makes the slots as a stream (one a block; with a ``quantum`` the
driver makes one period a phase), and they are joined by source and run of CHUNK blocks, broadcast only up to SLOTS_SENT. Row numbers within a source
come from the counts of its hash ranges plus a row number in each range, so a source that holds a third of all rows is still
spread over all tasks; the rows are shuffled once.

Cases: a null source counts as the source named ''; a null doc_id or text takes part; repeated rows are told apart
only by order; without given weights a source weighs its number of rows to the power of 0.5; sources without a given weight take the
least weight given; those of weight zero come last; an empty table gives an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import ceil, floor, lcm, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._common import partitions

BLOCK, MAX_SOURCES, POWER = 64, 2000, 0.5
#: Blocks of a source whose slots are one row of the plan; slots (8 bytes each) that may be broadcast, beyond which the plan is joined by a shuffle.
CHUNK, SLOTS_SENT = 4096, 1 << 21


def apportion(weights: list[float], quantum: int) -> list[int]:
    """Whole shares of ``quantum``, at least one each, by largest remainder."""
    spare, total = quantum - len(weights), sum(weights)
    exact = [spare * w / total for w in weights]
    shares = [1 + floor(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (floor(exact[i]) - exact[i], i))[: quantum - sum(shares)]:
        shares[i] += 1
    return shares


def period(shares: list[int]) -> list[int]:
    """Source of each slot of one period, earliest deadline first among released blocks."""
    slots = sum(shares)
    window = lambda i, j: (j * slots // shares[i], -(-(j + 1) * slots // shares[i]))
    waiting = [(*window(i, 0), i, 0) for i in range(len(shares))]
    heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, due, i, j = heappop(waiting)
            heappush(ready, (due, i, j))
        _, i, j = heappop(ready)
        out.append(i)
        if j + 1 < shares[i]:
            heappush(waiting, (*window(i, j + 1), i, j + 1))
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float], quantum: int) -> list[tuple[str, int, int, int, int, list[int]]]:
    """(source, phase, first block, block after the last, first slot, slots of one period) for each phase and source."""
    left, done, base, phase, pieces = dict(blocks), dict.fromkeys(blocks, 0), 0, 0, []
    while active := sorted(s for s in left if left[s]):
        shares = apportion([weights[s] for s in active], quantum)
        order = period(shares)
        slots: list[list[int]] = [[] for _ in active]
        for slot, i in enumerate(order):
            slots[i].append(slot)
        whole = min(left[s] // n for s, n in zip(active, shares, strict=True))
        taken = [whole * n for n in shares]
        tail = 0
        for i in order:
            if taken[i] == left[active[i]]:
                break
            taken[i] += 1
            tail += 1
        for i, s in enumerate(active):
            if taken[i]:
                pieces.append((s, phase, done[s], done[s] + taken[i], base, slots[i]))
            done[s] += taken[i]
            left[s] -= taken[i]
        base += whole * quantum + tail
        phase += 1
    return pieces


def exact_schedule(blocks: dict[str, int], weights: dict[str, float | Fraction], chunk: int = CHUNK, members: dict[str, int] | None = None) -> Iterator[tuple[str, int, list[int], list[int]]]:
    """(source, run, slots of the run's blocks, first block of each phase of the source so far), ``chunk`` blocks a run, by the exact
    weights; among those of weight zero each counts as its number of ``members``, one if there is none. Runs come when they are full or
    their source is done, so that no more than a run a source is held."""
    done = dict.fromkeys(blocks, 0)
    first: dict[str, list[int]] = {s: [] for s in blocks}
    held: dict[str, list[int]] = {s: [] for s in blocks}
    exact = {s: Fraction(weights[s]) for s in blocks}
    scale = lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    base, rest = 0, sorted(blocks)
    while rest := [s for s in rest if done[s] < blocks[s]]:
        for s in rest:
            first[s].append(done[s])
        active = [s for s in rest if whole[s] > 0]
        shares = [whole[s] for s in active] or [(members or {}).get(s, 1) for s in rest]
        active = active or rest
        total = sum(shares)
        left = [blocks[s] - done[s] for s in active]
        waiting = [(0, -(-total // w), i, 0) for i, w in enumerate(shares)]
        ready: list[tuple[int, int, int]] = []
        slot = 0
        while True:
            while waiting and waiting[0][0] <= slot:
                _, due, i, j = heappop(waiting)
                heappush(ready, (due, i, j))
            _, i, j = heappop(ready)
            if j == left[i]:
                break
            s = active[i]
            held[s].append(base + slot)
            done[s] += 1
            if len(held[s]) == chunk or done[s] == blocks[s]:
                yield s, (done[s] - 1) // chunk, held[s], first[s]
                held[s] = []
            heappush(waiting, ((j + 1) * total // shares[i], -(-(j + 2) * total // shares[i]), i, j + 1))
            slot += 1
        base += slot


def slot_plan(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float | Fraction], chunk: int = CHUNK, members: dict[str, int] | None = None) -> DataFrame:
    """``exact_schedule``'s rows, made by one task as a stream: the driver holds none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            for s, n, slots, first in exact_schedule(blocks, weights, chunk, members):
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([n], pa.int64()), pa.array([slots], pa.list_(pa.int64())), pa.array([first], pa.list_(pa.int64()))], names=["__mix_s", "__mix_run", "__mix_slots", "__mix_first"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "__mix_s string, __mix_run long, __mix_slots array<long>, __mix_first array<long>")


def numbered(rows: DataFrame, keys: list[str], hash_: Column, order: list[str], bits: int, name: str, extra: DataFrame | None = None) -> DataFrame:
    """``rows`` with their number (from 0) among those of equal ``keys``, by hash and ``order``: the counts of the hash ranges before a row's
    plus its number in its range, so that no key's rows are in one task. ``extra`` (columns ``keys`` and others) is joined to the counts."""
    keyed = rows.withColumn("__mix_key", hash_).withColumn("__mix_range", F.shiftright("__mix_key", 64 - bits))
    sizes = keyed.groupBy(*keys, "__mix_range").agg(F.count("*").alias("__mix_n"))
    before = Window.partitionBy(*keys).orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__mix_before", F.coalesce(F.sum("__mix_n").over(before), F.lit(0))).drop("__mix_n")
    if extra is not None:
        sizes = sizes.join(extra, keys, "left")
    on = [*keys, "__mix_range"]
    sizes = sizes.withColumnsRenamed({c: f"{c}_2" for c in on})
    within = Window.partitionBy(*on).orderBy("__mix_key", *order)
    ranked = keyed.withColumn(name, F.row_number().over(within))
    ranked = ranked.join(sizes, [F.col(c) == F.col(f"{c}_2") for c in on])
    return ranked.withColumn(name, F.col("__mix_before") + F.col(name) - 1).drop("__mix_key", "__mix_range", "__mix_before", *(f"{c}_2" for c in on))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", id_col: str = "doc_id", text: str = "text", block: int = BLOCK, quantum: int | None = None) -> DataFrame:
    """``docs`` with mix_phase, mix_slot (the block's place in the mix) and mix_position (the row's; increasing with
    slot, with gaps only behind the last block of a source)."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("mix_phase", "mix_slot", "mix_position")]
    name: Column = F.coalesce(F.col(source).cast("string"), F.lit(""))
    every = docs.groupBy(name.alias("__mix_source")).agg(F.count("*").alias("n"))
    largest = [(r[0], r.n) for r in every.orderBy(F.desc("n"), "__mix_source").limit(MAX_SOURCES + 1).collect()]
    counts, bits, turns = dict(largest[:MAX_SOURCES]), ceil(log2(4 * max(2, partitions(docs)))), None
    least = min(weights.values(), default=1.0) if weights is not None else None
    target: dict[str, float | Fraction] = {s: n**POWER if weights is None else weights.get(s, least) for s, n in counts.items()}
    members = dict.fromkeys(counts, 1)
    if len(largest) > MAX_SOURCES:
        last, n_last = largest[MAX_SOURCES - 1]
        small = every.where((F.col("n") < n_last) | ((F.col("n") == n_last) & (F.col("__mix_source") > F.lit(last))))
        if weights is None:
            small = small.withColumn("__mix_w", F.lit(0.0))  # follows from n
        else:
            given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "__mix_source string, __mix_w double")
            small = small.join(given, "__mix_source", "left").withColumn("__mix_w", F.coalesce("__mix_w", F.lit(float(least))))
        mark = "\0"
        while any(s.startswith(mark) for s in counts):
            mark += "\0"
        small = small.withColumn("__mix_entry", F.concat_ws("\0", F.lit(mark + "alike"), F.col("n").cast("string"), F.col("__mix_w").cast("string")))
        for r in small.groupBy("__mix_entry", "n", "__mix_w").agg(F.count("*").alias("m")).toLocalIterator():
            entry, n, w, m = r
            counts[entry], members[entry] = n * m, m
            target[entry] = m * Fraction(n**POWER if weights is None else w)
        # Sources that are alike take turns: the j-th row of the i-th of m is the entry's row j m + i.
        turns = small.select("__mix_source", "__mix_entry")
        turns = numbered(turns, ["__mix_entry"], F.xxhash64("__mix_source"), ["__mix_source"], bits, "__mix_turn")
    blocks = {s: -(-n // block) for s, n in counts.items()}
    keyed = docs.select(*kept, name.alias("__mix_source"))
    ranked = numbered(keyed, ["__mix_source"], F.xxhash64(F.col(id_col), F.col(text)), [id_col, text], bits, "__mix_row", turns)
    if turns is not None:
        sizes = spark.createDataFrame(list(members.items()), "__mix_e string, __mix_members long")
        ranked = ranked.withColumn("__mix_source", F.coalesce("__mix_entry", "__mix_source")).join(sizes, F.col("__mix_source") == F.col("__mix_e"))
        ranked = ranked.withColumn("__mix_row", F.col("__mix_row") * F.col("__mix_members") + F.coalesce("__mix_turn", F.lit(0)))
    ranked = ranked.withColumn("__mix_block", F.floor(F.col("__mix_row") / block))
    if quantum is None:
        plan = slot_plan(spark, blocks, target, CHUNK, members)
        if sum(blocks.values()) <= SLOTS_SENT:
            plan = F.broadcast(plan)
        placed = ranked.join(plan, (F.col("__mix_source") == F.col("__mix_s")) & (F.floor(F.col("__mix_block") / CHUNK) == F.col("__mix_run")))
        slot = F.element_at("__mix_slots", (F.col("__mix_block") % CHUNK + 1).cast("int"))
        phase = F.size(F.filter("__mix_first", lambda x: x <= F.col("__mix_block"))) - 1
        placed = placed.withColumn("mix_phase", phase.cast("int"))
    else:
        quantum = max(quantum, len(counts))
        plan = spark.createDataFrame(schedule(blocks, target, quantum), "__mix_s string, mix_phase int, __mix_from long, __mix_to long, __mix_base long, __mix_slots array<int>")
        placed = ranked.join(F.broadcast(plan), (F.col("__mix_source") == F.col("__mix_s")) & (F.col("__mix_block") >= F.col("__mix_from")) & (F.col("__mix_block") < F.col("__mix_to")))
        share, step = F.size("__mix_slots"), F.col("__mix_block") - F.col("__mix_from")
        slot = F.col("__mix_base") + F.floor(step / share) * quantum + F.element_at("__mix_slots", (step % share + 1).cast("int"))
    return placed.select(*kept, "mix_phase", slot.cast("long").alias("mix_slot"), (slot * block + F.col("__mix_row") % block).cast("long").alias("mix_position"))
