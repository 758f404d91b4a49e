import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from promptloom.llm import components, simhash

from .cases import documents, frame, prose


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Sorted (doc_id, fingerprint, component)."""
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    label = [label[j] if x == label[i] else x for x in label]
                    changed = True
    least = defaultdict(lambda: None)
    for (d, _), c in zip(rows, label, strict=True):
        if d is not None and (least[c] is None or d < least[c]):
            least[c] = d
    return sorted(((d, p, least[c]) for (d, _), p, c in zip(rows, prints, label, strict=True)), key=str)


def result(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)


def test_awkward_documents(spark):
    assert result(frame(spark)) == brute(documents())


def test_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for k in range(12):
        words = prose(rng.randrange(4, 200), 100 + k).split()
        for _ in range(10):
            copy = words[:]
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            rows.append((rng.randrange(10_000), " ".join(copy)))
    assert result(frame(spark, rows)) == brute(rows)


def test_links_reach_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 20, dtype=np.int64).astype(np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(15):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps |= {0, 1, 2**64 - 1, 2**64 - 2}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for tile in (2048, 3):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, tile=tile).collect()]
        assert all(0 < (a ^ b).bit_count() <= 4 for a, b in edges)
        root = {f: f for f in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        assert all(find(a) == find(b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4)


def test_forest_is_small():
    near = np.ones((300, 200), dtype=bool)
    assert len(simhash.forest(near.copy())) == 499


def test_representatives(spark):
    df = frame(spark)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in brute(documents()) if c is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 0
    lone = frame(spark, [(None, "some text that has no id at all"), (None, "some text that has no id at all"), (1, "another text that has an id")])
    assert sorted(str(r.doc_id) for r in simhash.representatives(lone).collect()) == ["1", "None"]
    assert simhash.representatives(frame(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6)]
    got = components.components(spark.createDataFrame(chain, "a long, b long")).groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("m")).collect()
    assert sorted((r.m, r.n) for r in got) == [(0, 201), (1000, 300)]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
