import itertools
import random

import pytest
from promptloom.functions import arrow as P, text as T
from promptloom.operators import graph, segments as S, signals as G
from promptloom.operators.rewrite import dedupe, documents, fillers, hygiene, ledger, lossy, window
from pyspark.sql import functions as F


def conv(spark, texts, roles=None):
    rows = [(1, k, roles[k] if roles else "user", t) for k, t in enumerate(texts)]
    return S.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


@pytest.mark.parametrize("threshold", [0.5, 0.55, 0.6, 0.7])
def test_band_joins_miss_no_pair(spark, threshold):
    rng = random.Random(int(threshold * 100))
    texts = []
    for k in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(30)]
        for _ in range(4):
            copy = base[:]
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(30)] = f"n{rng.randrange(99)}"
            texts.append(" ".join(copy))
    texts.append(texts[0])
    got = {(r.a, r.b) for r in G.near_pairs(conv(spark, texts), threshold).collect()}
    sigs = [P.signature(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sum(x == y for x, y in zip(sigs[i], sigs[j], strict=True)) / 128 >= threshold}
    firsts = {texts.index(t) for t in texts}
    copies = {(texts.index(t), k) for k, t in enumerate(texts) if texts.index(t) != k}
    assert got == {p for p in want if p[0] in firsts and p[1] in firsts} | copies


def test_redundancy(spark):
    long = "a long sentence with several words that repeats here"
    assert G.redundancy(conv(spark, [long, long, "something else entirely, of other letters"])).first().redundancy_score == pytest.approx(2 / 3)
    assert G.redundancy(conv(spark, [long])).first().redundancy_score == 0.0


def test_clusters_and_representatives(spark):
    base = "the cat sat on the mat and looked at the small bird in the tall tree near the old house by the river bank"
    segs = conv(spark, [base, base.replace("small", "tiny"), "nothing in common with any other text of these, 12345", base])
    got = {r.seg_idx: r.cluster for r in dedupe.clusters(segs, dedupe.similar_pairs(segs)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0}
    rows = spark.createDataFrame([("x", 5, False), ("x", 7, True), ("x", 9, True), ("y", 1, False)], "g string, seg_idx long, in_prefix boolean")
    assert {(r.g, r.representative, r.members) for r in dedupe.representatives(rows, ["g"]).collect()} == {("x", 7, 3), ("y", 1, 1)}


def test_exact_copies_go_but_not_of_code(spark):
    segs = conv(spark, ["same  text", "same text", "```\nx\n```", "```\nx\n```", "other"])
    assert sorted(r.seg_idx for r in dedupe.drop_exact(segs).collect()) == [0, 2, 3, 4]


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.node: r.root for r in graph.connected(chain).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in (100, 101, 103)} == {100}


def test_fillers_keep_norms(spark):
    df = spark.createDataFrame([("Please make sure that you always reply. In order to win, go.",), ("Your task is to sum up.",), ("You must always stay.",)], "t string")
    got = [r.x for r in df.select(fillers.strip_fillers(F.col("t")).alias("x")).collect()]
    # The first rule would lose "always", the one for "must always" would lose "must".
    assert got == ["Please make sure that you always reply.  win, go.", " sum up.", "You must always stay."]


def plain_bm25(chunks, query):
    import math

    docs = [c.lower().split() for c in chunks]
    mean = max(sum(map(len, docs)) / len(docs), 1)
    out = []
    for d in docs:
        s = 0.0
        for t in query.lower().split():
            tf, df = d.count(t), sum(t in x for x in docs)
            if tf:
                s += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
        out.append(s)
    return out


def test_bm25_and_prior(spark):
    parts = ["the cat sat", "a dog and a cat", "nothing here at all", "cat cat cat"]
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate(parts)], "id long, chunk_idx int, chunk string")
    got = {r.chunk_idx: r.bm25 for r in window.bm25(df, spark.createDataFrame([(1, "Cat the cat")], "id long, query string")).collect()}
    for k, want in enumerate(plain_bm25(parts, "Cat the cat")):
        assert got[k] == pytest.approx(want)
    rows = spark.range(7).select(window.position_prior(F.col("id"), F.lit(7)).alias("p"))
    assert [round(r.p, 3) for r in rows.collect()] == [1.0, 1.0, 0.65, 0.3, 0.65, 1.0, 1.0]


def test_top_mass_and_cover(spark):
    rows = [(1, k, 5, 10, f"chunk {k} word{k}", s) for k, s in enumerate([0.9, 0.1, 0.8, 0.3, 0.2])]
    df = spark.createDataFrame(rows, "id long, chunk_idx int, n_chunks int, tokens long, chunk string, score double")
    kept = lambda x: sorted(r.chunk_idx for r in x.where("kept").collect())
    item = lambda v: spark.createDataFrame([(1, v)], "id long, value string")
    assert kept(window.top_mass(df, 0.4)) == [0, 2]
    assert kept(window.top_mass(df, 0.4, item("word3"))) == [0, 2, 3]
    assert kept(window.top_mass(df, 0.4, item("absent"))) == [0, 1, 2, 3, 4]
    spans = spark.createDataFrame([(1, "about word1 only")], "id long, span string")
    assert kept(window.force_neighbours(window.top_mass(df, 0.4), spans)) == [0, 1, 2]
    assert window.reassemble(window.top_mass(df, 0.4)).first().text == "chunk 0 word0\n[…]\nchunk 2 word2"


def test_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "x" * 896)], "doc_id long, text string")
    got = {(r.id, r.chunk_idx): r.chunk for r in window.chunks(df).collect()}
    assert got == {(1, 0): text[:1024], (1, 1): text[896:1920], (1, 2): text[1792:], (2, 0): "", (3, 0): "x" * 896}


def test_repeats_and_replacement(spark):
    df = spark.createDataFrame([("c", 1, "doc"), ("c", 2, "doc"), ("d", 3, "doc"), ("c", 4, "other")], "conv string, turn long, text string")
    assert {r.turn: r.repeat for r in documents.repeats(df, ["conv"], "turn").collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    scored = spark.createDataFrame([(1, k, 10, f"c{k}", s) for k, s in enumerate([0.5, 0.1, 0.9, 0.2, 0.3, 0.4, 0.6])], "id long, chunk_idx int, tokens long, chunk string, score double")
    titles = spark.createDataFrame([(1, "ab" * 32, "T")], "id long, doc_hash string, title string")
    assert documents.replacement(scored, titles).first().text == 'Document abababab "T", available — relevant excerpts below\nc0\nc2\nc4\nc5\nc6'


def test_turn_groups_and_aging(spark):
    segs = conv(spark, list("abcdefg"), ["user", "user", "assistant", "assistant", "user", "assistant", "user"])
    got = [r.turn_group for r in ledger.turn_groups(segs).orderBy("seg_idx").collect()]
    assert got == [1, 2, 2, 3, 4, 4, 5]
    assert sorted(r.seg_idx for r in ledger.aging(ledger.turn_groups(segs), 2).collect()) == [0, 1, 2, 3]


def test_ledger(spark):
    texts = ["You must use metric units here. Thanks for that. How many tons are there? Nothing of note.", "The total is 42 tons of coal.", "The total is 42 tons of coal.", "Another reply about weather and so on."]
    grouped = ledger.turn_groups(conv(spark, texts, ["user", "assistant", "user", "assistant"]))
    rows = ledger.entries(grouped, 1)
    assert sorted((r.bucket, r.sentence) for r in rows.collect()) == [("decision", "You must use metric units here."), ("open", "How many tons are there?")]
    assert ledger.formatted(rows).first().ledger == "«Conversation ledger: decisions=[You must use metric units here.], facts=[none], open=[How many tons are there?]»"


def test_hygiene(spark):
    roles = ["tool", "assistant", "assistant", "assistant", "assistant", "tool"]
    texts = ["the result has forty two rows of data in it", "the result has forty two rows of data in it.", "b", "c", "d", "the result has forty two rows of data in it"]
    segs = conv(spark, texts, roles)
    assert [(r.request_id, r.seg_idx) for r in hygiene.expired(segs).collect()] == [(1, 0)]
    assert hygiene.expired(segs, keep_after=4).count() == 0


def plain_drop(text, values, ratio):
    words = text.split()
    target = len(words) - max(1, int(len(words) / ratio))
    freq = {w: words.count(w) for w in words}
    strip = lambda w: w.lower().strip(".,;:!?\"'()")
    loose = sorted((w for w in freq if not any(strip(w) in v.lower() or v.lower() in strip(w) for v in values)), key=lambda w: freq[w])
    gone, went = set(), 0
    for w in loose:
        if went >= target:
            break
        gone.add(w)
        went += freq[w]
    return " ".join(w for w in words if w not in gone) or text


def test_lossy(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("aa bb cc dd ee ff gg hh ii".split()) + rng.choice(["", ".", ","]) for _ in range(rng.randrange(1, 40)))) for k in range(40)]
    values = spark.createDataFrame([(k, ["bb", "xcc"]) for k, _ in rows], "id long, values array<string>")
    got = {r.id: r.text for r in lossy.drop_rare(spark.createDataFrame(rows, "id long, text string"), values).collect()}
    assert got == {k: plain_drop(t, ["bb", "xcc"], 1.5) for k, t in rows}


def test_first_change(spark):
    before, now = conv(spark, ["a", "b", "c"]), conv(spark, ["a", "x", "c", "d"])
    assert ledger.first_changed(before, now).first().first_changed == 1
    assert ledger.first_changed(before, before).first().first_changed == 3


def test_optimiser_never_grows_a_request(spark):
    from promptloom.operators import optimizer

    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 6")
    segs = S.segments(c)
    outcome, left = optimizer.optimise(segs, S.final_user_query(c), segs.select("request_id").distinct(), doc_budget=200, keep=1, min_doc=50, lossy_budget=50)
    rows = outcome.collect()
    assert len(rows) == 6 and all(r.tokens_after <= r.tokens_before for r in rows)
    assert {r.request_id for r in left.select("request_id").distinct().collect()} == {r.request_id for r in rows}
    assert T.CHARS_PER_TOKEN == 3.8


def test_repeated_assistant_turns_still_expire_results_and_sentences(spark):
    said = "the report for march lists forty two open orders and nine late ones from the north region warehouse"
    rows = [(1, 0, "user", "q", "USER_TURN"), (1, 1, "assistant", said, "ASSISTANT_TURN"), (1, 5, "tool", said + " today", "TOOL_RESULT"), (1, 6, "assistant", "a", "ASSISTANT_TURN"), (1, 7, "assistant", "b", "ASSISTANT_TURN"), (1, 8, "assistant", "c", "ASSISTANT_TURN"), (1, 9, "assistant", said, "ASSISTANT_TURN"), (1, 10, "assistant", "d", "ASSISTANT_TURN"), (1, 11, "tool", "last", "TOOL_RESULT")]
    segs = spark.createDataFrame(rows, "request_id long, seg_idx long, role string, text string, segment_type string")
    assert [(r.request_id, r.seg_idx) for r in hygiene.expired(segs).collect()] == [(1, 5)]
    left = segs.where("seg_idx = 5")
    assert {(r.seg_idx, r.last) for r in G.near_after(left, segs.where("role = 'assistant'"), 0.5).collect()} == {(5, 9)}
    assert {(r.seg_idx, r.last) for r in G.near_after(segs.where("seg_idx = 1"), segs.where("role = 'assistant'"), 0.99).collect()} == {(1, 9)}


def request(spark, rows):
    """Segments (role, segment_type, text) of request 1."""
    from promptloom.operators import optimizer

    df = spark.createDataFrame([(1, i, r, k, t) for i, (r, k, t) in enumerate(rows)], "request_id long, seg_idx long, role string, segment_type string, text string")
    return optimizer.with_hashes(df)


def texts(df):
    return [r.text for r in df.orderBy("seg_idx").collect()]


NEAR = "the quarterly report for the north region lists forty two open orders and nine late ones, all of them from the big warehouse by the river"


def test_near_copy_with_a_constraint_of_its_own_stays(spark):
    from promptloom.operators import manifest, optimizer

    segs = request(spark, [("user", "USER_QUERY", NEAR + " today."), ("user", "USER_QUERY", NEAR + " today"), ("user", "USER_QUERY", NEAR + " 77%.")])
    items = manifest.extract(segs)
    got = texts(optimizer.pass_s1(segs, items))
    assert got[1].startswith("[dup of seg_") and got[0].endswith("today.") and got[2].endswith("77%.")
    bare = optimizer.pass_s1(segs, items.limit(0))
    assert texts(bare)[2].startswith("[dup of seg_")


def test_cached_prefix_is_only_changed_where_it_pays(spark):
    from promptloom.operators import optimizer

    segs = request(spark, [("system", "SYSTEM_INSTRUCTION", "a   " * 50), ("user", "USER_QUERY", "b   " * 50)])
    after = optimizer.pass_s6(segs)
    guard = lambda value: texts(optimizer.prefix_guard(segs, after, spark.createDataFrame([(1, 100, 1, value)], "request_id long, prefix_bytes int, price int, cache_value int")))
    assert guard(10_000) == ["a   " * 50, ("b " * 50).strip()] and guard(1) == texts(after) == [("a " * 50).strip(), ("b " * 50).strip()]
    gone = optimizer.prefix_guard(segs, after.where("seg_idx = 1"), spark.createDataFrame([(1, 100, 1, 10_000)], "request_id long, prefix_bytes int, price int, cache_value int"))
    assert texts(gone)[0] == "a   " * 50


def test_hygiene_does_all_its_parts(spark):
    from promptloom.operators import optimizer

    rows = [("system", "TOOL_SCHEMA", "Finds a thing. Long story follows here."), ("user", "STRUCTURED_DATA", '{"a": 1,  "b": [1, 2]}'), ("user", "USER_QUERY", "| a  |  b |\n|  c | d   |"), ("user", "CODE_BLOCK", "x  =  1"), ("tool", "TOOL_RESULT", NEAR)]
    rows += [("assistant", "ASSISTANT_TURN", NEAR + " now"), *[("assistant", "ASSISTANT_TURN", f"turn {k}") for k in range(4)], ("tool", "TOOL_RESULT", "last one")]
    got = texts(optimizer.pass_s6(request(spark, rows)))
    assert got[0] == "Finds a thing." and got[1] == '{"a":1,"b":[1,2]}' and got[2] == "|a|b|\n|c|d|" and got[3] == "x  =  1"
    assert got[4] == "[tool_result:tool:expired]" and got[10] == "last one"


def test_window_keeps_entities_and_what_governs_them(spark):
    from promptloom.operators import manifest, optimizer

    filler = "plain words about nothing in the middle of the text that go on and on. "
    document = filler * 40 + "other things stand here by themselves. " * 50 + "The code name is ZEBRA here. " + "still other things. " * 20
    segs = request(spark, [("user", "RETRIEVED_DOC", document), ("user", "USER_QUERY", "what is the code name")])
    queries = spark.createDataFrame([(1, "what is the code name")], "request_id long, query string")
    items = manifest.extract(segs).where("item_type = 'entity'")
    cut = texts(optimizer.pass_s3(segs, queries, items, 300, 0.2))[0]
    assert len(cut) < len(document) and "ZEBRA" in cut
    assert texts(optimizer.pass_s3(segs, queries, items, 5000, 0.2))[0] == document


def test_ledger_needs_depth_and_tokens(spark):
    from promptloom.operators import optimizer

    rows = [("user" if k % 2 == 0 else "assistant", "USER_QUERY" if k % 2 == 0 else "ASSISTANT_TURN", f"You must keep rule {k} in mind for all of it.") for k in range(12)]
    segs = request(spark, rows)
    assert len(texts(optimizer.pass_s5(segs, 2, 3, 10, None))) < 12
    assert texts(optimizer.pass_s5(segs, 2, 9, 10, None)) == texts(segs) == texts(optimizer.pass_s5(segs, 2, 3, 10_000, None))
    rich = [(r, k, t if i != 1 else " ".join(f"w{q}" for q in range(60))) for i, (r, k, t) in enumerate([(r, k, "same " * 60 + t) for r, k, t in rows])]
    kept = texts(optimizer.pass_s5(request(spark, rich), 2, 3, 10, spark.createDataFrame([(1,)], "request_id long")))
    assert any(t.startswith("w0 w1") for t in kept)


def test_lossy_pass_has_its_gates(spark):
    from promptloom.operators import manifest, optimizer

    repeat = "the same few words again and again and again so that it has little in it " * 30 + "rare unusual tokens"
    segs = request(spark, [("user", "USER_QUERY", repeat)])
    items, yes, no = manifest.extract(segs).limit(0), spark.createDataFrame([(1,)], "request_id long"), spark.createDataFrame([], "request_id long")
    assert texts(optimizer.pass_s7(segs, items, yes, 100)) != [repeat]
    assert texts(optimizer.pass_s7(segs, items, no, 100)) == [repeat] == texts(optimizer.pass_s7(segs, items, yes, 100_000))
    dense = " ".join(f"{k * 7919 % 99991:x}{chr(97 + k * 13 % 26)}" for k in range(400))
    assert texts(optimizer.pass_s7(request(spark, [("user", "USER_QUERY", dense)]), items, yes, 100)) == [dense]


def test_routes_keep_passes_off(spark):
    from promptloom.operators import optimizer

    segs = request(spark, [("system", "SYSTEM_INSTRUCTION", "Please make sure that you answer.   Thanks   a   lot"), ("user", "USER_QUERY", "b   " * 50)]).select(*optimizer.COLUMNS)
    queries, none = spark.createDataFrame([(1, "b")], "request_id long, query string"), spark.createDataFrame([], "request_id long")
    off = spark.createDataFrame([(1, f"S{k}", "DISABLED") for k in range(1, 8)], "request_id long, strategy string, status string")
    free = optimizer.optimise(segs, queries, none)[0].first()
    barred = optimizer.optimise(segs, queries, none, off)[0].first()
    assert free.tokens_after < free.tokens_before == barred.tokens_after
