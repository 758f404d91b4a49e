"""Near copies by SimHash with an exact check: texts whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

The fingerprints of ``simhash`` have 64 bits, as their contract says, which is too few to find a given similarity surely. Here a
fingerprint has BITS bits, from the set of the 5-word shingles of a whole text (lower-cased, A-Z only):

1. ``near_groups``: tiled exact comparison by exclusive-or and bit counts. Sets that are ``share`` alike have sizes within that
   share, so only tiles of one band of sizes and of the next one meet; tile pairs whose population counts differ by more than the radius are
   skipped. The first 64 bits sort out nearly all pairs, the others decide on the rest. What a task finds connected
   becomes a group, and only the groups' members leave it. At the radius taken, two sets that are exactly 0.8 alike are found with a probability of over 0.999 (measured by simulation).
2. ``alike_links``: the texts of a group meet, and all their pairs of sets are compared exactly, by a product of 0-1 matrices; a large
   group is cut into blocks that meet in pairs. Only a spanning forest of the pairs that are alike leaves a task.
3. ``representatives``: one document of each component of those links.

Scale: moved data is linear but for the blocks (a fingerprint visits each block of its band and of the two beside it, of BLOCK sets each);
comparisons are quadratic in the different sets of a band, some nanoseconds each: the named method.

Cases: null, empty and blank texts have the empty set and are copies of each other; texts of one to four words are their whole
sequence; a null doc_id takes part; rows that repeat a doc_id and its text are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ._common import U64, WordHashes, as_bytes, checkpoint, mix, partitions, remove, rolling, shared_folder, steps, trim
from .components import components

SHINGLE, SHARE, BITS = 5, 0.8, 256
#: Bits that may differ, of all and of the first 64; sets of under SMALL shingles have more chance in their bits.
RADIUS, FIRST, SMALL, SMALL_RADIUS, SMALL_FIRST = 64, 22, 16, 76, 27
#: Sets of a block of fingerprints; rows and columns of a tile; shingles of a block of texts; sets of a product.
BLOCK, TILE_ROWS, TILE_COLUMNS, SHINGLES, PRODUCT = 16_384, 128, 4096, 1 << 19, 256
#: Columns of a 0-1 matrix held at once.
WIDTH = 1 << 15
SALTS = [U64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in range(1, BITS // 64 + 1)]


def shingles(text: bytes, memo: WordHashes) -> np.ndarray:
    """The distinct shingle hashes of one text, ascending."""
    words = memo.of(text.lower().split())
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    return np.unique(rolling(words, list(range(size)), size))


def fingerprint(found: np.ndarray) -> bytes:
    """BITS bits of a set: a bit is 1 if set in over half of the members' hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(found), 1 << 14):
        part = found[at : at + (1 << 14)]
        wide = np.stack([mix(part + salt) for salt in SALTS], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(found), bitorder="little").tobytes()


def band(sizes: np.ndarray, share: float) -> np.ndarray:
    """Bands of set sizes: sets that may be alike are of one band or of neighbouring ones."""
    return np.floor(np.log(np.maximum(1, sizes)) / -np.log(share)).astype(np.int32)


def prints(docs: DataFrame, id_col: str, text: str, share: float) -> DataFrame:
    """(doc_id, th, rk, node, n, band, fp) of each row: hashes of its text, of all its columns and of its set; size, band and
    fingerprint of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in steps(batches, "__text"):
            sets = [shingles(x, memo) for x in as_bytes(batch.column(3))]
            sizes = np.array([len(s) for s in sets], dtype=np.int32)
            nodes, fps = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [fingerprint(s) for s in sets]
            columns = [pa.array(nodes, pa.binary()), pa.array(sizes), pa.array(band(sizes, share)), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "th", "rk", "node", "n", "band", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("th"), F.xxhash64(*docs.columns).alias("rk"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, "doc_id long, th binary, rk long, node binary, n int, band int, fp binary")


def text_hash(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


class Labels:
    """Connected groups of numbered things."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.root[a], self.root[b]
        apart = a != b
        if not apart.any():
            return
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y in np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0).tolist():
            x, y = sorted((top(x), top(y)))
            if x != y:
                up[y] = x
        moved = np.arange(len(self.root))
        for y in up:
            moved[y] = top(y)
        self.root = moved[self.root]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Each thing that is not its group's first, and that first one."""
        away = np.flatnonzero(self.root != np.arange(len(self.root)))
        return away, self.root[away]


def near(x: np.ndarray, y: np.ndarray, small: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of x, row of y) of fingerprints within the radius; both sorted by population count."""
    radius, first = (SMALL_RADIUS, SMALL_FIRST) if small else (RADIUS, FIRST)
    ones_x, ones_y = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    head = np.ascontiguousarray(y[:, 0])
    # Buffers are used again and again, and hits are looked for eight at a time: both halve the time.
    bits, counts, hits = (np.zeros((TILE_ROWS, TILE_COLUMNS), dtype=t) for t in (U64, np.uint8, np.bool_))
    for a in range(0, len(x), TILE_ROWS):
        low, high = np.searchsorted(ones_y, [ones_x[a] - radius, ones_x[min(a + TILE_ROWS, len(x)) - 1] + radius + 1])
        rows = x[a : a + TILE_ROWS, 0][:, None]
        for b in range(low, high, TILE_COLUMNS):
            part = head[b : min(b + TILE_COLUMNS, high)]
            n, m = len(rows), len(part)
            np.bitwise_xor(rows, part[None, :], out=bits[:n, :m])
            np.bitwise_count(bits[:n, :m], out=counts[:n, :m])
            np.less_equal(counts[:n, :m], first, out=hits[:n, :m])
            hits[n:] = False
            hits[:, m:] = False
            eights = np.flatnonzero(hits.view(U64))
            if len(eights):
                found = (eights[:, None] * 8 + np.arange(8)).ravel()
                i, j = np.divmod(found[hits.ravel()[found]], TILE_COLUMNS)
                i, j = i + a, j + b
                keep = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int64) <= radius
                yield i[keep], j[keep]


def pairs_of(names: list[bytes], labels: Labels) -> pa.RecordBatch:
    a, b = labels.forest()
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in a.tolist()], pa.binary()), pa.array([names[k] for k in b.tolist()], pa.binary())], names=["node_a", "node_b"])


def cut(members: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """``members``, by size, in blocks of about ``most`` shingles, one member at least."""
    members = members[np.argsort(sizes[members], kind="stable")]
    step = np.cumsum(sizes[members]) // most
    return np.split(members, np.flatnonzero(np.diff(step)) + 1)


def meetings(labels: Labels, side: np.ndarray, sizes: np.ndarray, share: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each group: the blocks of its members that meet (the second is None where a block meets itself)."""
    order = np.argsort(labels.root, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(labels.root[order])) + 1):
        if len(group) < 2:
            continue
        two = side[group].any()
        left = cut(group[side[group] == 0], sizes, most)
        right = cut(group[side[group] == 1], sizes, most) if two else left
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                if (two or i <= j) and sizes[x[-1]] >= share * sizes[y[0]] - 1e-9 and sizes[y[-1]] >= share * sizes[x[0]] - 1e-9:
                    yield x, y if two or i < j else None


def near_groups(nodes: DataFrame, share: float, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """(meeting, side, node): each two of ``nodes`` (node, n, band, fp) within the radius and with sizes within ``share`` are in one meeting,
    on its two sides or both on side 0. A meeting's side has ``most`` shingles, or one node."""
    nodes = nodes.where("n > 0").select("node", "n", "band", "fp")
    # A band is a power of 1 / share, so these are a few dozen rows at any size of the table.
    counts = {r.band: -(-r["count"] // block) for r in nodes.groupBy("band").count().collect()}
    if not counts:
        return nodes.select(F.col("node").alias("meeting"), F.lit(0).alias("side"), "node").limit(0)
    blocks = F.element_at(F.create_map(*(F.lit(v) for item in counts.items() for v in item)), F.col("band"))
    nodes = nodes.withColumn("part", F.pmod(F.xxhash64("node"), blocks).cast("int")).repartition(partitions(nodes), "band", "part").sortWithinPartitions("band", "part")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each pair of blocks that a block takes part in."""

        def rows(at: tuple[int, int], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, p = at
            whole = pa.Table.from_batches(held)
            names, fps = (b"".join(whole.column(c).to_pylist()) for c in ("node", "fp"))
            sizes = whole.column("n").to_numpy().astype("<i4").tobytes()
            keys = [(b, min(p, q), b, max(p, q), int(p > q)) for q in range(counts[b])]
            keys += [(b, p, b + 1, q, 0) for q in range(counts.get(b + 1, 0))] + [(b - 1, q, b, p, 1) for q in range(counts.get(b - 1, 0))]
            for *key, side in keys:
                yield pa.RecordBatch.from_arrays([pa.array(["-".join(map(str, key))]), pa.array([side], pa.int32()), pa.array([names], pa.binary()), pa.array([fps], pa.binary()), pa.array([sizes], pa.binary())], names=["key", "side", "names", "fps", "sizes"])

        at, held = None, []
        for batch in batches:
            bands, parts = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            cuts = np.flatnonzero((np.diff(bands, prepend=-1) != 0) | (np.diff(parts, prepend=-1) != 0)) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if (bands[a], parts[a]) != at:
                    if held:
                        yield from rows(at, held)
                    at, held = (int(bands[a]), int(parts[a])), []
                held.append(batch.slice(a, b - a))
        if held:
            yield from rows(at, held)

    dealt = nodes.mapInArrow(deal, "key string, side int, names binary, fps binary, sizes binary")
    dealt = dealt.repartition(partitions(nodes), "key").sortWithinPartitions("key", "side")

    def compared(key: str, sides: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = []
        for names, fps, sizes in sides:
            fp = np.frombuffer(fps, dtype=U64).reshape(-1, BITS // 64)
            order = np.argsort(np.bitwise_count(fp).sum(axis=1, dtype=np.int64), kind="stable")
            parts.append(([names[16 * k : 16 * k + 16] for k in order.tolist()], fp[order], np.frombuffer(sizes, dtype="<i4")[order].astype(np.int64)))
        (names, x, n_x), (names_y, y, n_y) = parts[0], parts[-1]
        alone, shift = len(parts) == 1, 0
        sizes, side = n_x, np.zeros(len(n_x), dtype=np.int64)
        if not alone:
            names, sizes, side, shift = names + names_y, np.concatenate([n_x, n_y]), np.repeat([0, 1], [len(n_x), len(n_y)]), len(n_x)
        labels = Labels(len(names))
        for i, j in near(x, y, small=bool(n_x.min() < SMALL)):
            fits = (n_x[i] >= share * n_y[j] - 1e-9) & (n_y[j] >= share * n_x[i] - 1e-9)
            fits &= (i < j) if alone else True
            labels.join(i[fits], j[fits] + shift)
        for k, (left, right) in enumerate(meetings(labels, side, sizes, share, most)):
            both = left if right is None else np.concatenate([left, right])
            name = xxhash.xxh3_128_digest(f"{key}-{k}")
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(both), pa.binary()), pa.array(np.repeat([0, 1], [len(left), len(both) - len(left)]), pa.int32()), pa.array([names[m] for m in both.tolist()], pa.binary())], names=["meeting", "side", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, []
        for batch in batches:
            for key, _, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    if sides:
                        yield from compared(at, sides)
                        trim()
                    at, sides = key, []
                sides.append(values)
        if sides:
            yield from compared(at, sides)

    return dealt.mapInArrow(run, "meeting binary, side int, node binary")


def matrix(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), dtype=np.float32)
    for k, s in enumerate(sets):
        at = np.searchsorted(columns, s)
        at[at == len(columns)] = 0
        out[k, at[columns[at] == s]] = 1
    return out


def shared(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Numbers of common members of each of xs with each of ys."""
    common = np.intersect1d(np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys)), assume_unique=True)
    out = np.zeros((len(xs), len(ys)), dtype=np.int64)
    for at in range(0, len(common), WIDTH):
        part = common[at : at + WIDTH]
        out += (matrix(xs, part) @ matrix(ys, part).T).astype(np.int64)
    return out


def alike(sets: list[np.ndarray], sides: list[int], share: float) -> Labels:
    """Groups of the sets that are ``share`` alike; with two sides only pairs of different sides are compared."""
    sizes, side = np.array([len(s) for s in sets]), np.array(sides)
    labels, both = Labels(len(sets)), len(set(sides)) > 1
    order = np.argsort(sizes, kind="stable")
    left, right = (order[side[order] == 0], order[side[order] == 1]) if both else (order, order)
    for a in range(0, len(left), PRODUCT):
        x = left[a : a + PRODUCT]
        for b in range(0 if both else a, len(right), PRODUCT):
            y = right[b : b + PRODUCT]
            if sizes[x[-1]] < share * sizes[y[0]] - 1e-9 or sizes[y[-1]] < share * sizes[x[0]] - 1e-9:
                continue
            n = shared([sets[k] for k in x], [sets[k] for k in y])
            i, j = np.nonzero(n >= share * (sizes[x][:, None] + sizes[y][None, :] - n) - 1e-9)
            labels.join(x[i], y[j])
    return labels


def alike_links(nodes: DataFrame, groups: DataFrame, docs: DataFrame, text: str, share: float) -> DataFrame:
    """(node_a, node_b): pairs whose graph has the same components as all pairs at least ``share`` alike that meet in ``groups``."""
    members = checkpoint(groups.join(nodes.select("node", F.col("best.th").alias("th"), F.col("best.rk").alias("rk")), "node"))
    texts = docs.select(text_hash(text).alias("th"), F.xxhash64(*docs.columns).alias("rk"), F.col(text).cast("string").alias("__text"))
    texts = texts.join(members.select("th", "rk"), ["th", "rk"], "left_semi").groupBy("th", "rk").agg(F.min("__text").alias("__text"))
    rows = texts.join(members, ["th", "rk"]).select("meeting", "side", "node", "__text")
    rows = rows.repartition(partitions(docs), "meeting").sortWithinPartitions("meeting")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, at = WordHashes(), None
        sets, sides, held = [], [], []
        for batch in batches:
            for key, side, node, value in zip(*(batch.column(k).to_pylist() for k in range(3)), as_bytes(batch.column(3)), strict=True):
                if key != at:
                    if len(held) > 1:
                        yield pairs_of(held, alike(sets, sides, share))
                        trim()
                    at, sets, sides, held = key, [], [], []
                sets.append(shingles(value, memo))
                sides.append(side)
                held.append(node)
        if len(held) > 1:
            yield pairs_of(held, alike(sets, sides, share))

    return rows.mapInArrow(run, "node_a binary, node_b binary")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = SHARE, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the one with the smallest doc_id.

    Of rows that repeat a doc_id and its text, and of a component without any doc_id, one row stays: that with the smallest hash of all
    its columns. The rows' columns are unchanged.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/prints-{uuid.uuid4().hex}"
    prints(docs, id_col, text, share).write.parquet(folder)
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th", "rk", "n", "band", "fp")).alias("best")
    nodes = checkpoint(spark.read.parquet(folder).groupBy("node").agg(best).select("node", "best.n", "best.band", "best.fp", "best"))
    remove(spark, folder)
    groups = near_groups(nodes, share, block, most)
    roots = components(alike_links(nodes, groups, docs, text, share), "node_a", "node_b")
    joined = nodes.select("node", "best").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    stay = checkpoint(joined.select(F.col("best.th").alias("__near_text"), F.col("best.rk").alias("__near_key")))
    rows = docs.withColumns({"__near_text": text_hash(text), "__near_key": F.xxhash64(*docs.columns)}).join(stay, ["__near_text", "__near_key"], "left_semi")
    # Rows that are alike in all their columns are left: which of them stays makes no difference.
    order = Window.partitionBy("__near_text", "__near_key").orderBy("__near_key")
    return rows.withColumn("__near_row", F.row_number().over(order)).where("__near_row = 1").select(*docs.columns)
