import random
from collections import Counter

from pyspark.sql import functions as F

from promptloom.llm import mixing

from .cases import documents, frame


def test_period_is_pfair():
    rng = random.Random(1)
    for _ in range(40):
        shares = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))]
        order = mixing.period(shares)
        assert Counter(order) == dict(enumerate(shares))
        seen, total = [0] * len(shares), sum(shares)
        for slot, i in enumerate(order):
            seen[i] += 1
            assert all(abs(seen[k] - (slot + 1) * shares[k] / total) < 1 for k in range(len(shares)))


def plain_schedule(blocks, weights, quantum):
    """Source of every slot, by the rule itself."""
    left, out = dict(blocks), []
    while any(left.values()):
        active = sorted(s for s in left if left[s])
        shares = mixing.apportion([weights[s] for s in active], quantum)
        done, start, total = dict.fromkeys(active, 0), len(out), sum(shares)
        share = dict(zip(active, shares, strict=True))
        while True:
            slot = len(out) - start
            ready = [(-(-(done[s] + 1) * total // share[s]), active.index(s), s) for s in active if done[s] * total // share[s] <= slot]
            s = min(ready)[2]
            if not left[s]:
                break
            done[s] += 1
            left[s] -= 1
            out.append(s)
            if not any(left.values()):
                break
    return out


def test_schedule_against_the_rule():
    rng = random.Random(2)
    for _ in range(30):
        names = [f"s{k}" for k in range(rng.randrange(1, 7))]
        blocks = {s: rng.randrange(0, 60) for s in names}
        weights = {s: rng.random() + 0.01 for s in names}
        got = {}
        for s, _, a, b, base, slots in mixing.schedule(blocks, weights, 20):
            for k in range(a, b):
                got[base + (k - a) // len(slots) * 20 + slots[(k - a) % len(slots)]] = s
        assert [got[k] for k in range(len(got))] == plain_schedule(blocks, weights, 20)


def test_rows_against_a_plain_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    got = mixing.mix_sources(df, block=4, quantum=64).withColumn("key", F.xxhash64("doc_id", "text")).collect()
    assert len(got) == df.count()
    by = {}
    for r in sorted(got, key=lambda r: (r.source, r.key, r.doc_id)):
        by.setdefault(r.source, []).append(r)
    order = plain_schedule({s: -(-len(v) // 4) for s, v in by.items()}, {s: len(v) ** 0.5 for s, v in by.items()}, 64)
    used = Counter()
    for slot, s in enumerate(order):
        for place, r in enumerate(by[s][4 * used[s] : 4 * used[s] + 4]):
            assert (r.mix_slot, r.mix_position) == (slot, 4 * slot + place)
        used[s] += 1
    assert len({r.mix_position for r in got}) == len(got)


def test_awkward_documents(spark):
    df = frame(spark).withColumn("source", F.when(F.col("doc_id") > 3, F.lit("a"))).withColumn("mix_slot", F.lit("old"))
    got = mixing.mix_sources(df, block=2, quantum=8).collect()
    assert len(got) == len(documents()) and len({r.mix_position for r in got}) == len(got)
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_given_weights(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "IF(id % 2 = 0, 'a', 'b') AS source")
    rows = mixing.mix_sources(df, {"a": 3.0, "b": 1.0}, block=10, quantum=100).where("mix_phase = 0 AND mix_slot < 100").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in rows} == {"a": 750, "b": 250}


def test_many_sources_share_a_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    rows = [(k, "t", s) for k, s in enumerate(["a"] * 60 + ["b"] * 40 + ["c"] * 30 + [f"d{k % 15}" for k in range(30)])]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=5).collect()
    assert len(got) == 160 and len({r.mix_position for r in got}) == 160
    rest = sorted(r.mix_slot for r in got if r.source.startswith("d"))
    weights = {"a": 60**0.5, "b": 40**0.5, "c": 30**0.5, "rest": 15 * 2**0.5}
    want = merged(mixing.exact_schedule({"a": 12, "b": 8, "c": 6, "rest": 6}, {("\0rest" if k == "rest" else k): v for k, v in weights.items()} | weights))
    assert Counter(rest).keys() <= set(range(32)) and set(Counter(rest).values()) == {5} and len(want) == 4


def merged(runs):
    """Slots and first blocks of phases by source, of the schedule's runs."""
    out = {}
    for s, _, slots, first in runs:
        out.setdefault(s, ([], []))
        out[s][0].extend(slots)
        out[s][1][:] = first
    return out


def test_lag_against_the_target_weights_over_many_periods():
    weights = {f"s{k}": float(n) ** 0.5 for k, n in enumerate((4_700_000, 1_900_000, 800_000, 90_000, 40_000, 9_000, 3_000, 900, 300, 100))}
    slots = {s: at for s, (at, _) in merged(mixing.exact_schedule({s: 100_000 if s == "s0" else 90_000 for s in weights}, weights)).items()}
    total = sum(weights.values())
    first = min(at[-1] for at in slots.values())
    assert first > 20 * 4096
    for s, at in slots.items():
        for j, slot in enumerate(at):
            if slot > first:
                break
            share = weights[s] / total
            assert j - share * slot < 1 and share * slot - j < 1 + 1e-6 and (j + 1) - share * (slot + 1) < 1 + 1e-6


def test_exact_schedule_gives_each_slot_once():
    rng = random.Random(8)
    for _ in range(30):
        blocks = {f"s{k}": rng.randrange(0, 60) for k in range(rng.randrange(1, 9))}
        got = merged(mixing.exact_schedule(blocks, {s: rng.random() + 0.01 for s in blocks}, rng.randrange(1, 9)))
        assert {s: len(at) for s, (at, _) in got.items()} == {s: n for s, n in blocks.items() if n}
        assert sorted(slot for at, _ in got.values() for slot in at) == list(range(sum(blocks.values())))
        assert all(at == sorted(at) for at, _ in got.values())


def test_rows_follow_the_exact_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    df = spark.range(3000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "IF(id % 10 < 7, 'a', IF(id % 10 < 9, 'b', 'c')) AS source")
    rows = mixing.mix_sources(df, block=4).collect()
    blocks = {"a": 525, "b": 150, "c": 75}
    want = merged(mixing.exact_schedule(blocks, {"a": 2100**0.5, "b": 600**0.5, "c": 300**0.5}, 7))
    assert len(rows) == 3000 and len({r.mix_position for r in rows}) == 3000
    for s, (at, first) in want.items():
        assert Counter(r.mix_slot for r in rows if r.source == s) == dict.fromkeys(at, 4)
        assert {(r.mix_slot, r.mix_phase) for r in rows if r.source == s} == {(slot, sum(x <= j for x in first) - 1) for j, slot in enumerate(at)}


def test_small_sources_keep_their_own_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    sizes = {"a": 90, "b": 80, "c": 70} | {f"d{k}": 24 for k in range(3)} | {f"e{k}": 6 for k in range(4)} | {"f": 1}
    df = spark.createDataFrame([(100 * i + k, f"t{k}", s) for i, (s, n) in enumerate(sizes.items()) for k in range(n)], "doc_id long, text string, source string")
    heavy = {"a": 1.0, "b": 2.0, "c": 1.0, "d0": 9.0, "d1": 0.5, "d2": 9.0, "e1": 0.0, "e2": 0.0}
    for given in (None, heavy):
        got = sorted(mixing.mix_sources(df, given, block=1).collect(), key=lambda r: r.mix_position)
        assert Counter(r.source for r in got) == sizes and [r.mix_position for r in got] == list(range(sum(sizes.values())))
        weight = {s: n**0.5 if given is None else given.get(s, 0.0) for s, n in sizes.items()}
        left, base = dict(sizes), 0
        while left:
            # Until a source runs out, all that are alike have as many rows as each other, to one, and each is less than one from its share.
            active = {s: weight[s] for s in left if weight[s] > 0} or dict.fromkeys(left, 1.0)
            alike = {s: [o for o in active if (sizes[o], active[o]) == (sizes[s], active[s])] if s not in "abc" else [s] for s in active}
            seen, ends = Counter(), False
            while not ends:
                seen[got[base].source] += 1
                base += 1
                place = sum(seen.values())
                for s, w in active.items():
                    assert abs(seen[s] - place * w / sum(active.values())) < 2, (given, s, place)
                    assert all(abs(seen[s] - seen[o]) <= 1 for o in alike[s])
                ends = any(seen[s] == left[s] for s in active) and all(seen[o] == left[o] for s in active if seen[s] == left[s] for o in alike[s])
            left = {s: n - seen[s] for s, n in left.items() if n > seen[s]}


def test_more_sources_than_the_driver_lists(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 5)
    df = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "IF(id < 1000, concat('a', id % 7), concat('s', id % 700)) AS source")
    got = mixing.mix_sources(df, block=8).collect()
    assert len(got) == 4000 and len({r.mix_position for r in got}) == 4000
    small = sorted((r.mix_position, r.source) for r in got if r.source.startswith("s"))
    of = Counter(s for _, s in small)
    for n in set(of.values()):
        order = [s for _, s in small if of[s] == n]
        m = len(set(order))
        assert all(len(set(order[k : k + m])) == m for k in range(0, len(order), m))
