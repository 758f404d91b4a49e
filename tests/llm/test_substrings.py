import hashlib
import random

import numpy as np

from promptloom.llm import substrings as S

from .cases import documents, frame


def brute(rows, window=S.WINDOW):
    """Sorted (doc_id, n_words, n_removed, sha256)."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            smallest = first.get(tuple(w[i : i + window]))
            if smallest is not None and (d is None or smallest < d):
                keep[i : i + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((d, len(w), keep.count(False), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.dedup_substrings(df).collect()), key=str)


def test_awkward_documents(spark):
    assert result(frame(spark)) == brute(documents())


def test_random_overlaps(spark):
    rng = random.Random(3)
    pool = [[rng.choice("abcdefg") + rng.choice("xyz") for _ in range(rng.randrange(8, 40))] for _ in range(12)]
    rows = [(rng.randrange(60), " ".join(w for _ in range(rng.randrange(1, 6)) for w in rng.choice(pool))) for _ in range(150)]
    assert result(frame(spark, rows)) == brute(rows)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_spans_are_factors_of_smaller_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = {r.doc_id: (r.text or "").split() for r in df.collect()}
    spans = [(r.doc_id, *s) for r in S.dedup_substrings(df).collect() for s in r.spans]
    assert spans
    for doc, start, n, ref, ref_start in spans:
        assert n >= S.WINDOW and ref < doc and words[doc][start : start + n] == words[ref][ref_start : ref_start + n]


def test_empty_table(spark):
    assert result(frame(spark, [])) == []


def test_parse_checks_boundaries():
    # A factor of another reference that begins inside the one before it is kept; what is covered is not.
    assert S.parse([(0, 3, 1, 0), (5, 4, 2, 50), (1, 1, 3, 9)]) == [(0, 15, 1, 0), (5, 16, 2, 50)]
    # Factors that go on in step are one.
    assert S.parse([(0, 3, 1, 10), (3, 2, 1, 13)]) == [(0, 17, 1, 10)]


def test_one_document_needs_no_reference(spark):
    text = " ".join(["same words again and again"] * 20)
    assert result(frame(spark, [(1, text)])) == brute([(1, text)])


def test_rows_without_an_id_or_with_one_id_do_not_mix(spark):
    rng, passage = random.Random(8), " ".join(f"p{k}" for k in range(30))
    rows = [(1, passage)]
    for doc in (None, 7):
        for k in range(2000):
            own = " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(14, 20)))
            rows.append((doc, f"{passage} {own}" if k % 5 == 0 else own))
    assert result(frame(spark, rows)) == brute(rows)


def test_windows_that_come_often_are_settled_early(spark, monkeypatch):
    from promptloom.llm import _common

    monkeypatch.setattr(_common, "STEP_BYTES", 2000)
    rng, passage = random.Random(9), " ".join(f"p{k}" for k in range(40))
    rows = [(d, " ".join([f"a{rng.randrange(10**6)}" for _ in range(15)] + ([passage] if d % 3 else [passage.replace("p7", "q")]))) for d in rng.sample(range(500), 300)]
    df = spark.createDataFrame(rows, "doc_id long, __text string").coalesce(1)
    assert result(df.withColumnRenamed("__text", "text")) == brute(rows)

    def sent(most):
        often, k = S.Often(most), 0
        memo = S.WordHashes()
        for at in range(0, len(rows), 10):
            some = sorted(rows[at : at + 10])
            words = [t.encode().split() for _, t in some]
            got = S.block_rows(np.array([d for d, _ in some]), np.zeros(10, dtype="<i8"), memo.of([w for x in words for w in x]), np.array(list(map(len, words))), 4, S.WINDOW, S.SEED, often)
            k += sum(len(r[2]) // 5 for r in got if r[2] is not None)
        return k

    assert sent(S.OFTEN) < sent(0) - 500
