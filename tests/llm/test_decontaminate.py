import random
from collections import Counter

from promptloom.llm import decontaminate as D

from .cases import documents, frame, prose


def brute(docs, items, window=D.WINDOW, share=D.SHARE):
    """Every alignment by the rule, by comparing words; no seed is asked for."""
    out = set()
    for k, (doc, text) in enumerate(docs):
        d = D.words_of(text)
        for item, body in items:
            w = D.words_of(body)
            if not w:
                continue
            size, need = D.rule(len(w), window, share)
            best = None
            places = {x: [q for q, y in enumerate(w) if x == y] for x in set(w)}
            shared = Counter(p - q for p, x in enumerate(d) for q in places.get(x, ()))
            for at in sorted(a for a, n in shared.items() if n >= need):
                span = range(max(0, at), min(len(d), at + len(w)))
                equal = {p: d[p] == w[p - at] for p in span}
                good = [p for p in span if p + size - 1 in equal and sum(equal[q] for q in range(p, p + size)) >= need]
                if good:
                    inside = {q for p in good for q in range(p, p + size) if equal[q]}
                    got = (len(inside), -min(inside), max(inside) - min(inside) + 1)
                    best = max(best, got, key=lambda g: g[:2]) if best else got
            if best:
                out.add((k, item, -best[1], best[2], best[0]))
    return out


def planted():
    rng = random.Random(5)
    items = [(i, prose(rng.randrange(8, 45), 1000 + i)) for i in range(25)] + [(None, prose(20, 77)), (90, "too short"), (91, None)]
    docs = [(k, prose(50, 2000 + k)) for k in range(30)]
    for k in range(20):
        words = items[k][1].split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "changed"
        docs.append((100 + k, prose(20, 3000 + k) + " " + " ".join(words).upper() + ", " + prose(10, 4000 + k)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_overlaps(frame(spark, [(k, d, t) for k, (d, t) in enumerate(docs)], "k long, doc_id long, text string"), bench)
    got = {(r.k, h.item_id, h.start, h.n_words, h.n_equal) for r in found.collect() for h in r.contamination}
    assert got == brute(docs, items)
    hit = {docs[k][0] for k, *_ in got}
    assert not any(d < 100 for d in hit) and {100, 104, 108} <= hit


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = planted()
    bench, df = spark.createDataFrame(items, "item_id long, text string"), frame(spark, docs)
    rows = lambda: sorted(str((r.doc_id, sorted(str(h) for h in r.contamination))) for r in D.find_overlaps(df, bench).collect())
    whole = rows()
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    assert rows() == whole


def test_awkward_documents(spark):
    base = documents()[0][1]
    bench = spark.createDataFrame([(1, " ".join(base.split()[10:30])), (1, " ".join(base.split()[10:30])), (2, ""), (None, None)], "item_id long, text string")
    found = D.find_overlaps(frame(spark), bench)
    hit = sorted((str(r.doc_id), len(r.contamination)) for r in found.collect() if r.contamination)
    assert [d for d, _ in hit] == sorted(["1", "2", "2", "None", "13"])
    kept = D.decontaminate(frame(spark), bench)
    assert kept.columns == frame(spark).columns and kept.count() == len(documents()) - 5


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(frame(spark), bench).count() == len(documents())
    assert D.decontaminate(frame(spark, []), bench).count() == 0


def complete(docs, items):
    """(k, item_id) of every overlap by the rule alone: no seed is asked for."""
    out = set()
    for k, (_, text) in enumerate(docs):
        d = D.words_of(text)
        for item, body in items:
            w = D.words_of(body)
            size = min(D.WINDOW, len(w))
            need = size if len(w) < D.MIN_ITEM else -(-size * 4 // 5)
            starts = ((i, j) for i in range(len(d) - size + 1) for j in range(len(w) - size + 1)) if w else ()
            if any(sum(x == y for x, y in zip(d[i : i + size], w[j : j + size], strict=True)) >= need for i, j in starts):
                out.add((k, item))
    return out


def test_every_overlap_that_counts_is_found(spark):
    rng, items, docs = random.Random(12), [], []
    for n in (1, 3, 5, 7, 8, 8, 9, 10, 10, 11, 11, 12, 13, 13, 20):
        items.append((len(items), " ".join(f"i{len(items)}w{q}" for q in range(n))))
        for _ in range(20):
            words = items[-1][1].split()
            for q in rng.sample(range(n), min(n, rng.randrange(4))):
                words[q] = "changed"
            docs.append((len(docs), prose(6, len(docs)) + " " + " ".join(words) + " " + prose(6, 9000 + len(docs))))
    words = items[12][1].split()
    docs.append((len(docs), " ".join([*words[:6], "x", "y", *words[8:]])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = {(r.doc_id, h.item_id) for r in found for h in r.contamination}
    want = complete(docs, items)
    assert got == want and (len(docs) - 1, 12) in got and len(want) > 100


def test_patterns_of_all_small_items(spark):
    """Each way to change words that the rule still counts, for items of 8 to 13 words: recall 1."""
    from itertools import combinations

    items, docs = [], []
    for n in range(8, 14):
        words = [f"i{n}w{q}" for q in range(n)]
        items.append((n, " ".join(words)))
        for changed in range(n - D.rule(n)[1] + 1):
            docs += [(n, " ".join(["lead", *("x" if q in at else w for q, w in enumerate(words)), "tail"])) for at in combinations(range(n), changed)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert len(found) > 250 and all([h.item_id for h in r.contamination] == [r.doc_id] for r in found)


def test_text_of_one_word_stays_bounded(spark):
    import resource
    import time

    bench = spark.createDataFrame([(1, "same " * 400), (2, "same " * 20 + "other")], "item_id long, text string")
    began = time.time()
    block = D.Seeds([(1, [b"same"] * 400), (2, [b"same"] * 20 + [b"other"])])
    hashes = D.WordHashes().of([b"same"] * 100_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(block.alignments(hashes)) > 100_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB
    df = spark.createDataFrame([(1, "same " * 5_000)], "doc_id long, text string")
    got = D.find_overlaps(df, bench).collect()[0].contamination
    assert sorted((h.item_id, h.n_equal) for h in got) == [(1, 400), (2, 20)]
    assert time.time() - began < 120


def test_column_that_is_called_like_the_hits(spark):
    df = spark.createDataFrame([("old", 1, "no overlap", 5)], "contamination string, doc_id long, text string, last int")
    bench = spark.createDataFrame([(1, "some words of an item that is not there")], "item_id long, text string")
    got = D.find_overlaps(df, bench).collect()[0]
    assert got.last == 5 and got.contamination == []
    marked = df.withColumnRenamed("contamination", "__contamination")
    assert D.decontaminate(marked, bench).collect() == marked.collect()
