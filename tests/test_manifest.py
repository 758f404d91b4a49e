import pytest
from promptloom.operators import manifest as M, segments as S
from pyspark.sql import functions as F


def conv(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def items(spark, rows):
    return [(r.item_type, r.value) for r in M.extract(S.segments(conv(spark, rows))).collect()]


@pytest.mark.parametrize(("text", "values"), [
    ("The budget is $4.2M for Q3 2024.", {"$4.2M", "Q3 2024"}), ("growth of 12.5% now", {"12.5%"}), ("due 2025-03-31", {"2025-03-31"}), ("on v3.11.0", {"v3.11.0"}), ("EUR 3.5B and January 2024", {"EUR 3.5B", "January 2024"}),
])
def test_numbers(spark, text, values):
    assert values <= {v for k, v in items(spark, [(1, 0, "user", text)]) if k == "number"}


def test_normative_clauses_come_from_system_text(spark):
    text = "You must always respond in valid JSON format."
    assert ("normative", text) in items(spark, [(1, 0, "system", text)])
    assert not [v for k, v in items(spark, [(1, 0, "user", text)]) if k == "normative"]


def test_formats(spark):
    got = {v for k, v in items(spark, [(1, 0, "user", "say \"APPROVED\" or 'ACTIVE' but James's and the owner's words are none, {\"status\": 1}")]) if k == "format"}
    assert {'"APPROVED"', "'ACTIVE'", "status"} <= got and not any("s and the" in v for v in got)


def test_entities_and_first_of_each(spark):
    got = items(spark, [(1, 0, "user", "see NASA and getUserName in MAX_SIZE"), (1, 1, "user", "NASA again")])
    assert got.count(("entity", "NASA")) == 1 and {("entity", "getUserName"), ("entity", "MAX_SIZE")} <= set(got)


def test_governing_span(spark):
    df = spark.createDataFrame([(["Before it.", "Total cost is $12.5M.", "This figure is estimated and subject to change.", "Other."], "$12.5M"), (["One.", "Two 7.", "Three."], "7"), (["a", "b"], "zz")], "s array<string>, v string")
    got = [r.x for r in df.select(M.governing_span(F.col("v"), F.col("s")).alias("x")).collect()]
    assert got == ["Before it. Total cost is $12.5M. This figure is estimated and subject to change.", "Two 7.", "a b"]


def cover(spark, text, value, span, full=True):
    rows = spark.createDataFrame([(1, value, span)], "request_id long, value string, governing_span string")
    return M.coverage(rows, spark.createDataFrame([(1, text)], "request_id long, text string"), full).first().coverage


def test_coverage(spark):
    span = "These figures are projected. Revenue target is $4.2M."
    assert cover(spark, span, "$4.2M", span) == 1.0
    assert cover(spark, "Revenue target is $4.2M.", "$4.2M", span) < 1.0
    assert cover(spark, "Revenue target is $4.2M.", "$4.2M", span, full=False) == 1.0
    assert cover(spark, "The projected sum. Revenue target is $4.2M.", "$4.2M", span) == 1.0
    none = spark.createDataFrame([], "request_id long, value string, governing_span string")
    assert M.coverage(none, spark.createDataFrame([(1, "x")], "request_id long, text string")).first().coverage == 1.0


def test_polarity(spark):
    before = S.segments(conv(spark, [(1, 0, "user", "The cost is not $5M. Fine."), (2, 0, "user", "The cost is $5M.")]))
    found = M.extract(before)
    after = S.segments(conv(spark, [(1, 0, "user", "The cost is $5M. Fine."), (2, 0, "user", "Well, the cost is $5M.")]))
    assert {r.request_id: r.intact for r in M.polarity_intact(found, before).collect()} == {1: 1, 2: 1}
    assert {r.request_id: r.intact for r in M.polarity_intact(found.where("item_type = 'number'"), after).collect()} == {1: 0, 2: 1}
