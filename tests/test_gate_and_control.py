import random

import numpy as np
import pytest
from promptloom.functions import arrow as P
from promptloom.operators import calibrate as K, control as C, gate as G, sequential as Q
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_quality(spark):
    lit = F.lit
    assert value(spark, G.quality(lit(1.0), lit(True), lit(0.8), lit(0.9), lit(0.95))) == pytest.approx(0.875)
    assert value(spark, G.quality(lit(0.99), lit(True), lit(1.0), lit(1.0), lit(1.0))) == 0.0
    assert value(spark, G.quality(lit(1.0), lit(False), lit(1.0), lit(1.0), lit(1.0))) == 0.0
    assert value(spark, G.quality(lit(1.0), lit(True), lit(1.0), lit(1.0), lit(0.5))) == pytest.approx(0.9)
    assert [value(spark, G.floor(lit(b))) for b in (False, True)] == [0.98, 0.99]


def test_rollback_order(spark):
    rows = [(1, "none", 0.5), (1, "S7", 0.5), (1, "S4", 1.0), (1, "S1", 1.0), (2, "none", 1.0), (2, "S7", 1.0), (3, "none", 0.1), (3, "S1", 0.2)]
    got = G.rollback(spark.createDataFrame([(*r, 0.98) for r in rows], "request_id long, stage string, qps double, floor double"))
    assert {r.request_id: r.stage for r in got.collect()} == {1: "S4", 2: "none", 3: "raw"}


def test_snapshot(spark):
    versions = spark.createDataFrame([(1, 0, 0, "raw"), (1, 2, 0, "s1"), (1, 3, 0, "s6"), (1, 7, 0, "s7")], "request_id long, stage_idx int, seg_idx long, text string")
    undo = lambda k: G.snapshot_after(versions, spark.createDataFrame([(1, k)], "request_id long, undo_idx int")).first().text
    assert [undo(k) for k in (1, 2, 3, 7, 9)] == ["raw", "raw", "s1", "s6", "s7"]


def plain_fidelity(a, b):
    import re

    def windows(t):
        s = [x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", t) if x.strip()]
        return [" ".join(s[k : k + 2]) for k in range(max(1, len(s) - 1))] if s else []

    x, y = windows(a), windows(b)
    if not x or not y:
        return float(not x and not y)
    return min(P.bag_cosine(x[min(k, len(x) - 1)], y[min(k, len(y) - 1)]) for k in range(max(len(x), len(y))))


def test_window_fidelity(spark):
    texts = ["One cat. Two dogs. Three birds.", "One cat. Two dogs.", "Other words. Here now.", "", "single"]
    rows = [(i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    got = {r.id: r.fidelity for r in G.window_fidelity(spark.createDataFrame(rows, "id long, original string, rewritten string")).collect()}
    for k, a, b in rows:
        assert got[k] == pytest.approx(plain_fidelity(a, b)), (a, b)


@pytest.mark.parametrize(("n", "strategy", "probation", "rate"), [(0, "S1", False, 0.20), (100, "S1", False, 0.10), (300, "S1", False, 0.03), (1000, "S1", False, 0.015), (1000, "S7", False, 0.075), (1000, "S1", True, 0.045), (0, "S7", True, 1.0)])
def test_sampling_rate(spark, n, strategy, probation, rate):
    assert value(spark, C.sampling_rate(F.lit(n), F.lit(strategy), F.lit(probation))) == pytest.approx(rate)


def plain_breaker(samples):
    window, violations, last, state, out = [], 0, None, "CLOSED", []
    for at, p in samples:
        if state != "DISABLED":
            window = [*window, p][-200:]
            bad = len(window) >= 10 and (sum(window) / len(window) < 0.95 - 1e-12 or sum(x < 0.85 for x in window) / len(window) > 0.02)
            if bad:
                violations = violations + 1 if last is not None and at - last < 86400 else 1
                last, state = at, "DISABLED" if violations >= 2 else "OPEN"
            else:
                state = "CLOSED"
        out.append(state)
    return out


def test_breaker(spark):
    rng = random.Random(7)
    cells = {"low": [(k, 0.80) for k in range(30)], "high": [(k, 0.99) for k in range(250)], "mixed": [(k * 5000, rng.choice([0.80, 0.96, 0.97, 0.99, 1.0])) for k in range(400)], "slow": [(k * 100_000, 0.9) for k in range(30)]}
    rows = [(hash((c, k)) % 10**9, c, float(at), round(p * 10_000)) for c, s in cells.items() for k, (at, p) in enumerate(s)]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "request_id long, cell string, at double, parity_bp long")
    got = {r.request_id: r.state for r in Q.circuit_states(df.repartition(5)).collect()}
    start = 0
    for c, s in cells.items():
        assert [got[start + k] for k in range(len(s))] == plain_breaker(s), c
        start += len(s)
    low = [got[k] for k in range(30)]
    assert low[:9] == ["CLOSED"] * 9 and low[9] == "OPEN" and low[10:] == ["DISABLED"] * 20


def test_quota(spark):
    rng = random.Random(8)
    rows = [(k, f"t{rng.randrange(3)}", rng.randrange(2), k, rng.randrange(1, 500)) for k in range(300)]
    got = {r.request_id: r.optimised for r in Q.quota_decisions(spark.createDataFrame(rows, "request_id long, tenant_id string, day long, at long, tokens long"), 20, 3000).collect()}
    used = {}
    for k, t, day, _, tokens in rows:
        n, total = used.get((t, day), (0, 0))
        ok = n < 20 and total + tokens <= 3000
        used[t, day] = (n + ok, total + ok * tokens)
        assert got[k] == ok


@pytest.mark.parametrize(("cost", "passed"), [(0.0, True), (0.00375, True), (0.10, False)])
def test_breakeven(spark, cost, passed):
    lhs, ratio, ok = C.breakeven(F.lit(6), F.lit(6800), F.lit(3e-6), F.lit(0.0), F.lit(cost))
    row = spark.range(1).select(lhs.alias("lhs"), ratio.alias("ratio"), ok.alias("ok")).first()
    assert row.lhs == pytest.approx(0.1224) and row.ok is passed
    assert row.ratio == (float("inf") if cost == 0 else pytest.approx(0.1224 / (5 * cost)))


def test_bandit(spark):
    log = spark.createDataFrame([("S3", "X", a, r) for a, r in ((1, 5000), (1, -2000), (2, 9000), (2, 9000))], "strategy_id string, request_class string, arm int, reward_bp long")
    post = C.posteriors(log)
    assert {r.arm: (r.alpha, r.beta) for r in post.collect()} == {1: (1.5, 1.2), 2: (2.8, 1.0)}
    shut = spark.createDataFrame([("S3", "X")], "strategy_id string, request_class string")
    assert C.select_arms(post, shut).first().arm == 2
    free = C.select_arms(post, shut.limit(0)).collect()
    assert free == C.select_arms(post, shut.limit(0)).collect() and free[0].arm in (1, 2)
    wins = [C.select_arms(post, shut.limit(0), seed).first().arm for seed in range(12)]
    assert wins.count(2) > 6


def test_sampling_floor(spark):
    log = spark.range(40).selectExpr("id AS request_id", "'c' AS cell", "id DIV 20 AS day", "id AS at", "0.0D AS rate")
    got = {r.request_id: r.sampled for r in C.sampled(log).collect()}
    assert sorted(k for k, v in got.items() if v) == [0, 1, 2, 3, 4, 20, 21, 22, 23, 24]


def test_calibration(spark):
    rows = spark.createDataFrame([("A", 0.65, 1, 0), ("A", 0.92, 5, 1), ("A", 0.62, 0, 9), ("B", 0.5, 1, 0)], "request_class string, similarity double, gain int, loss int")
    assert {r.request_class: (r.tau, r.score) for r in K.tau_sweep(rows).collect()} == {"A": (0.65, 5), "B": (0.60, 0)}
    rng = np.random.default_rng(3)
    x = rng.random((200, 4))
    w = np.array([0.4, 0.3, 0.2, 0.1])
    df = spark.createDataFrame([(*map(float, r), float(r @ w)) for r in x], "coverage double, semantic double, window double, margin double, human double")
    assert list(K.quality_weights(df).values()) == pytest.approx(w.tolist(), abs=1e-6)
    assert K.quality_weights(df.limit(5)) == K.DEFAULT_WEIGHTS
    pairs = spark.createDataFrame([(1, "a b c", "x", "a b c", ["b"]), (2, "a", "a", "a", [])], "id int, a string, b string, reference string, constraints array<string>")
    assert {r.id: r.winner for r in K.judge_pairs(pairs).collect()} == {1: "a", 2: "tie"}
    recall = spark.createDataFrame([("A", "Has it", "has", True), ("A", "none", "has", True), ("B", "none", "has", False)], "request_class string, text string, constraint string, positive boolean")
    assert {r.request_class: r.recall for r in K.constraint_recall(recall).collect()} == {"A": 0.5, "B": 1.0, "overall": 0.6667}
