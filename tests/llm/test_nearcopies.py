import random

import corpus_pipeline
import numpy as np
import pytest
from promptloom.llm import nearcopies

from .cases import documents, frame, prose


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_ids of the components' smallest documents, by comparing all pairs."""
    sets, label = [plain(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if label[i] != label[j] and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                label = [label[j] if k == label[i] else k for k in label]
    least = {}
    for (d, _), c in zip(rows, label, strict=True):
        least[c] = min(d if d is not None else 1 << 60, least.get(c, 1 << 60))
    return sorted(d if d < 1 << 60 else -1 for d in least.values())


def near_copies():
    """Groups of texts with some words changed, on both sides of the threshold, all with one passage in common."""
    rng, rows, passage = random.Random(9), [], prose(12, 99)
    for k in range(25):
        words = prose(rng.randrange(8, 200), 500 + k).split()
        for _ in range(rng.randrange(2, 12)):
            copy = words[:]
            for _ in range(rng.randrange(0, max(2, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(copy) + " " + passage))
    rng.shuffle(rows)
    return rows


def test_stage_against_brute_force(spark):
    rows = near_copies()
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == brute(rows)


@pytest.mark.parametrize(("block", "most"), [(7, 200), (30, 3000)])
def test_blocks_lose_no_link(spark, block, most):
    rows = near_copies()
    got = nearcopies.representatives(spark.createDataFrame(rows, "doc_id long, text string"), block=block, most=most)
    assert sorted(r.doc_id for r in got.collect()) == brute(rows)


def test_sets_that_are_just_alike_are_near():
    """Pairs of sets of all sizes that are 0.8 alike: nearly all are within the radius."""
    rng = random.Random(4)
    for size in (5, 9, 10, 18, 27, 45, 90, 900):
        near = 0
        for _ in range(200):
            spare = size // 9 if size % 9 == 0 else 0
            a = np.array(sorted(rng.sample(range(1 << 62), size)), dtype=np.uint64)
            b = np.unique(np.concatenate([a[: size - (spare or size // 5)], np.array(rng.sample(range(1 << 62), spare), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            assert shared >= 0.8 * (len(a) + len(b) - shared)
            x, y = (np.frombuffer(nearcopies.fingerprint(s), dtype=np.uint64).reshape(1, -1) for s in (a, b))
            near += sum(len(i) for i, _ in nearcopies.near(x, y, min(len(a), len(b)) < nearcopies.SMALL))
        assert near >= 198, size


def test_tiles_find_every_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (300, 4), dtype=np.int64).astype(np.uint64)
    flips = np.where(rng.random((4600, 4, 64)) < 0.2, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)).sum(axis=2, dtype=np.uint64)
    y = np.concatenate([base, base[rng.integers(0, 300, 4600)] ^ flips])
    y = y[np.argsort(np.bitwise_count(y).sum(axis=1, dtype=np.int64), kind="stable")]
    x = y[::17]
    got = {(i, j) for a, b in nearcopies.near(x, y, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    whole = np.bitwise_count(x[:, None] ^ y[None])
    want = (whole.sum(axis=2, dtype=np.int64) <= nearcopies.RADIUS) & (whole[:, :, 0] <= nearcopies.FIRST)
    assert got == set(zip(*(v.tolist() for v in np.nonzero(want)), strict=True)) and len(got) > 500


def test_rows_that_repeat_leave_one(spark):
    rows = [(1, "a text of some words that is there again", k % 3) for k in range(9)] + [(None, "no id " * 9, k) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    first = [tuple(r) for r in nearcopies.representatives(df).collect()]
    assert len(first) == 2
    assert sorted(first, key=str) == sorted((tuple(r) for r in nearcopies.representatives(df.repartition(5)).collect()), key=str)


def test_one_changed_word_in_a_short_text(spark):
    words = prose(60, 3).split()
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], "changed", *words[31:]])), (3, prose(60, 4))]
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_awkward_documents(spark):
    got = nearcopies.representatives(frame(spark))
    assert got.columns == frame(spark).columns and sorted(r.doc_id for r in got.collect()) == brute(documents())
    lone = frame(spark, [(None, "some text that has no id at all"), (None, "some text that has no id at all"), (1, "another text that has an id")])
    assert sorted(str(r.doc_id) for r in nearcopies.representatives(lone).collect()) == ["1", "None"]
    assert nearcopies.representatives(frame(spark, [])).count() == 0
