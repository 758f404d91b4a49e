"""Queries over constraint manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import manifest as M, segments as S
from ..sources.tables import literal, load
from .registry import query
from .requests import conversations, sql_strip

TEXT_ROWS = [
    (1, "The budget is $4.2M for Q3 2024. Growth was 12.5% by 2025-03-31 on v3.11.0 and 1,200 users."), (2, "You must always respond in JSON format. Never guess. Plain text is fine."), (3, "NASA and ESA met; API calls use getUserName and MAX_SIZE."),
    (4, "Total cost is 12.5 million. This figure is estimated and subject to change. Nothing else."), (5, "James has the owner's \"APPROVED\" mark and 'ACTIVE' state at /v1/users/ path."), (6, ""), (7, "Dr. Smith Jones came. He left.\n\nA new paragraph here! \"Quoted\" start."),
    (8, "Revenue is not 5. It can't be 6 and is approximately 7."), (9, "no numbers here at all"), (10, "EUR 3.5B and USD 2,000 in January 2024 at 7 %"),
]
TEXT_SQL = literal(TEXT_ROWS, ["id", "text"])


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXT_ROWS, "id int, text string")


def constraint_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and the texts above as system segments of requests with negative numbers."""
    fixed = texts(spark).select((-F.col("id")).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), "text")
    return S.segments(conversations(spark, sf_dir).unionByName(fixed))


@query()
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.sha2(F.array_join("s", "\n"), 256).alias("sentences_sha256"))


SENTENCE_SQL = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '[\x01\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len({SENTENCE_SQL}) AS INTEGER) AS n_sentences, sha256(array_to_string({SENTENCE_SQL}, '|')) AS sentences_sha256 FROM documents")
def coverage_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", T.coverage_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.sha2(F.array_join("s", "|"), 256).alias("sentences_sha256"))


EDGE = r"[^\p{L}\p{N}\p{M}_]+"


@query(rf"SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(text, '{EDGE}'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))), ' ') AS acronyms FROM documents UNION ALL SELECT -id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(text, '{EDGE}'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))), ' ') FROM {TEXT_SQL}")
def entities_acronym(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(texts(spark).select((-F.col("id")).cast("long").alias("id"), "text"))
    return rows.select("id", F.array_join(F.array_sort(F.array_distinct(M.found(F.col("text"), M.ACRONYM))), " ").alias("acronyms"))


@query()
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = constraint_segments(spark, sf_dir)
    return rows.select("request_id", "seg_idx", F.explode(M.entities(F.col("text"))).alias("entity"))


NUMBER_SQL = ", ".join(f"list_transform(regexp_extract_all(text, '{p}'), lambda x: trim(x))" for p in M.NUMBERS)


@query(rf"SELECT id, array_to_string(list_sort(list_distinct(flatten([{NUMBER_SQL}]))), ' ; ') AS numbers FROM (SELECT doc_id AS id, regexp_replace(text, '[^\x00-\x7F€£¥]', ' ', 'g') AS text FROM documents UNION ALL SELECT -id, text FROM {TEXT_SQL})")
def numbers_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over ASCII and currency signs: the twin's word edges know no other letters."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"[^\x00-\x7F€£¥]", " ").alias("text"))
    rows = docs.unionByName(texts(spark).select((-F.col("id")).cast("long").alias("id"), "text"))
    return rows.select("id", F.array_join(F.array_sort(M.numbers(F.col("text"))), " ; ").alias("numbers"))


CLAUSE_SQL = M.CLAUSE.replace("'", "''")


@query(rf"""SELECT id, clause FROM (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{CLAUSE_SQL}'), lambda x: {sql_strip('x')}))) AS clause
FROM (SELECT conv_id AS id, string_agg(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id UNION ALL SELECT -id, text FROM {TEXT_SQL})) WHERE length(clause) > 10""")
def normative_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = conversations(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    whole = S.joined_texts(S.segments(conv)).select(F.col("request_id").alias("id"), F.col("full_text").alias("text"))
    rows = whole.unionByName(texts(spark).select((-F.col("id")).cast("long").alias("id"), "text"))
    return rows.select("id", F.explode(M.normative_clauses(F.col("text"))).alias("clause"))


@query()
def format_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(texts(spark).select((-F.col("id")).cast("long").alias("id"), "text"))
    return rows.select("id", F.explode(M.format_specs(F.col("text"))).alias("spec"))


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"""WITH q AS (SELECT conv_id AS request_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id),
w AS (SELECT request_id, list_filter(string_split_regex(text, '{EDGE}'), lambda w: regexp_matches(w, '^[a-zA-Z_]') AND length(w) > 2 AND lower(w) NOT IN ({STOPS})) AS ws FROM q)
SELECT request_id, array_to_string(list_filter(ws, lambda w, i: list_position(list_transform(ws, lambda v: lower(v)), lower(w)) = i), ' ') AS terms FROM w""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.final_user_query(conversations(spark, sf_dir))
    return rows.select("request_id", F.array_join(T.query_terms(F.col("query")), " ").alias("terms"))


@query()
def governing_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark).select("id", T.sentences(F.col("text")).alias("s"), F.explode(M.numbers(F.col("text"))).alias("value"))
    return rows.select("id", "value", M.governing_span(F.col("value"), F.col("s")).alias("span"))


def _guard_sql(x: str) -> str:
    tests = []
    for t in sorted(T.NEGATIONS):
        q = t.replace("'", "''")
        test = f"contains(lower({x}), '{q}')" if " " in t else rf"regexp_matches(lower({x}), '(^|[^\p{{L}}\p{{N}}\p{{M}}_]){q}($|[^\p{{L}}\p{{N}}\p{{M}}_])')"
        tests.append(f"CASE WHEN {test} THEN '{q}' END")
    return f"sha256(concat_ws('|', {', '.join(tests)}))"


@query(f"SELECT conv_id AS id, turn AS seg_idx, {_guard_sql('text')} AS guard FROM conversations UNION ALL SELECT -id, 0, {_guard_sql('text')} FROM {TEXT_SQL}")
def polarity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraint_segments(spark, sf_dir).select(F.col("request_id").alias("id"), "seg_idx", T.polarity_guard(F.col("text")).alias("guard"))


@query()
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.extract(constraint_segments(spark, sf_dir)).select("request_id", "item_type", "value", "source_segment_hash", "polarity_guard")


ACR = rf"list_distinct(list_filter(string_split_regex(text, '{EDGE}'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))"


@query(rf"""WITH v AS (SELECT doc_id AS request_id, text, unnest({ACR}) AS value FROM documents), c AS (SELECT request_id, avg(CAST(contains(left(text, 600), value) AS INTEGER)) AS c FROM v GROUP BY request_id)
SELECT doc_id AS request_id, round(coalesce(c, 1.0), 6) AS coverage FROM documents LEFT JOIN c ON doc_id = request_id""")
def coverage_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many acronyms of a document its lead (600 characters) still has."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    items = docs.select("request_id", F.explode(F.array_distinct(M.found(F.col("text"), M.ACRONYM))).alias("value"))
    out = M.coverage(items, docs.withColumn("text", F.left(F.col("text"), F.lit(600))), full=False)
    return out.select("request_id", F.round("coverage", 6).alias("coverage"))


@query()
def coverage_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and qualifiers after each request loses its first sentence."""
    segs = constraint_segments(spark, sf_dir)
    items = M.extract(segs)
    whole = S.joined_texts(segs).select("request_id", F.array_join(F.slice(T.sentences(F.col("full_text")), 2, 1 << 30), " ").alias("text"))
    return M.coverage(items, whole).select("request_id", F.round("coverage", 6).alias("coverage"))


@query()
def polarity_intact(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = constraint_segments(spark, sf_dir)
    changed = segs.withColumn("text", F.regexp_replace("text", r"(?i)\b(not|never) ", "")).withColumn("segment_hash", T.segment_hash(F.col("text")))
    return M.polarity_intact(M.extract(segs), changed)


NORM = T.NORMATIVE_WORDS


@query(rf"""SELECT conv_id AS request_id, turn AS seg_idx, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '(?i)\b({NORM})\b'), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))))), '|') AS tokens FROM conversations""")
def normative_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seg_idx"), F.array_join(T.normative_tokens(F.regexp_replace("text", r"[^\x00-\x7F]", "x")), "|").alias("tokens"))
