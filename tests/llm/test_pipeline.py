import corpus_pipeline
import pytest
from promptloom.llm import decontaminate, nearcopies, pii, quality, queries, simhash

from .test_decontaminate import brute as overlaps
from .test_nearcopies import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        out.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, got.schema)
    return {n: (a, b) for n, a, b in out}


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_drops_what_the_classifier_rejects(spark, stages):
    before, after = stages["quality"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.scores(model, [r.text.encode() for r in before], quality.Words(model.get("vocabulary")))
    assert ids(after) == sorted(r.doc_id for r, s in zip(before, scores, strict=True) if s >= 0.3) and len(after) < len(before)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    assert ids(after) == groups([(r.doc_id, r.text) for r in before])


def test_overlapping_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {k for k, *_ in overlaps([(r.doc_id, r.text) for r in before], items)}
    assert ids(after) == sorted(r.doc_id for k, r in enumerate(before) if k not in hit)


def test_texts_are_redacted(stages):
    before, after = stages["personal_data"]
    texts = {r.doc_id: r.text for r in after}
    assert ids(before) == ids(after)
    for r in before:
        new = texts[r.doc_id]
        assert pii.base_spans(new) == [] and (pii.base_spans(r.text) != [] or new == r.text)
    assert all(r.n_chars == len(r.text) for r in after)


def test_all_rows_are_placed(stages):
    before, after = stages["mixing"]
    assert ids(before) == ids(after) and len({r.mix_position for r in after}) == len(after)


def test_columns_and_run(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name in list(stages)[:-1]:
        assert list(stages[name][1][0].__fields__) == columns
    assert ids(corpus_pipeline.run(spark, SF).collect()) == ids(stages["mixing"][1])


def awkward(spark):
    """Documents with nulls, repeated rows, an empty and a very long text, and columns that clash with internal ones."""
    from pyspark.sql import functions as F

    from .cases import frame

    return frame(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long")).withColumn("source", F.when(F.col("doc_id") > 4, F.lit("a")))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_tables(spark, name):
    from .cases import documents

    stage, docs = dict(corpus_pipeline.STAGES)[name], awkward(spark)
    none = stage(spark, docs.limit(0), SF)
    got = stage(spark, docs, SF)
    assert none.count() == 0
    rows = got.collect()
    if name == "mixing":
        assert len(rows) == len(documents()) and len({r.mix_position for r in rows}) == len(rows)
        return
    assert got.columns == docs.columns and none.columns == docs.columns
    if name == "near_dedup":
        kept = [r.doc_id for r in rows]
        assert None not in kept and len(kept) == len(set(kept)) and {1, 3, 6, 10, 11, 12} <= set(kept) and not {2, 4, 5} & set(kept)
    if name == "decontamination":
        assert len(rows) == len(documents())
    if name == "personal_data":
        assert sorted(map(str, (r.text for r in rows))) == sorted(map(str, (t for _, t in documents())))
    if name == "quality":
        assert sorted(map(str, rows)) == sorted(map(str, stage(spark, docs.repartition(7), SF).collect()))


def test_queries_run_on_the_smallest_tables(spark):
    for name, query in queries.QUERIES.items():
        assert query(spark, SF).count() >= 0, name


def test_thresholds_are_production_ones():
    assert (simhash.SHINGLE, simhash.SEED, simhash.RADIUS) == (4, 42, 4) and (nearcopies.SHINGLE, nearcopies.SHARE) == (5, 0.8) and decontaminate.WINDOW == 13


def test_spelled_addresses_without_a_trigger_are_redacted(spark):
    lead = "lorem ipsum dolor sit amet " * 9
    docs = spark.createDataFrame([(1, lead + "write to john (at) example.org now. " + lead), (2, lead)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.personal_data_stage(spark, docs, SF).collect()}
    assert got == {1: lead + "write to [EMAIL] now. " + lead, 2: lead}
