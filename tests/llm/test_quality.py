import zlib

import numpy as np
import pytest

from promptloom.llm import quality as Q

from .cases import documents, frame


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    return read("documents"), read("labels")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for d, r in got.items())
    held = [(got[d].score, q) for d, q in truth.items() if got[d].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_scores_depend_on_words_alone(spark, tables):
    docs, labels = tables
    model = Q.fit_on(docs, labels)
    score = lambda df: {r.doc_id: r.s for r in Q.score_quality(df, model, score="s").collect()}
    some = docs.limit(30)
    assert score(some) == pytest.approx(score(some.selectExpr("doc_id", "text", "'zz' AS lang", "'other' AS source").repartition(5)), abs=2e-6)


def test_awkward_documents(spark, tables):
    _, labels = tables
    got = Q.classify(frame(spark).withColumnRenamed("n", "quality"), labels).collect()
    assert len(got) == len(documents()) and all(0 <= r.score <= 1 for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert Q.classify(frame(spark, []), labels).collect() == []


def test_without_labels_or_with_one_class(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.classify(frame(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 0), (7, None)], "doc_id long, quality int")
    assert len({r.score for r in Q.classify(frame(spark), one).collect()}) == 1


def test_vectors_are_sparse_and_fixed():
    hashes = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    made = Q.vectors(hashes)
    assert (made == Q.vectors(hashes)).all() and (np.abs(made).sum(axis=1) <= Q.NONZERO).all()
    assert Q.shape(b"Hello%%% 42") == b"Aa% 0"
    assert Q.shape(b"a" * 5000 + b"7!") == b"a0!"


def test_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(50)], "doc_id long, text string")
    labels, seen = docs.selectExpr("doc_id", "int(doc_id % 2) AS quality"), []
    monkeypatch.setattr(Q, "fit", lambda texts, y: seen.append(texts))
    Q.fit_on(docs, labels, rows=20)
    Q.fit_on(docs, labels, rows=20, size=1050)
    Q.fit_on(docs, labels, rows=20, size=10)
    assert list(map(len, seen)) == [20, 10, 0]


def test_pooled_mean_of_words():
    vocabulary, context = Q.learn_context([b"a b c a b", b"b c d"])
    memo = Q.Words(vocabulary)
    got = Q.pooled([b"a b", b"", b"a a"], memo, context)
    index = lambda w: sum(Q.vectors(np.array([h], dtype=np.uint64))[0] for h in (int(memo.columns[k][memo[w]]) for k in range(3)))
    assert np.allclose(got[0, : Q.DIMS], (index(b"a") + index(b"b")) / 2)
    assert np.allclose(got[2, : Q.DIMS], (2 * index(b"a") + Q.AGAIN) / 2)
    assert np.allclose(got[0, Q.DIMS :], (context[vocabulary[b"a"]] + context[vocabulary[b"b"]]) / 2, atol=1e-6)
    assert (got[1] == 0).all()
