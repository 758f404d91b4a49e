"""Queries over the rewrite passes. Thresholds are those of the table sizes here, as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import manifest as M, segments as S
from ..operators.rewrite import common, dedupe, documents, fillers, hygiene, ledger, lossy, window
from ..sources.tables import REQUESTS_SQL, literal, load, request_log
from .registry import query
from .requests import SEGMENTS_SQL, conversations, sql_strip, sql_tokens, sql_word, sql_words


@query(f"""WITH s AS (SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY request_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_byte FROM {SEGMENTS_SQL})
SELECT request_id, seg_idx, CAST(start_byte AS BIGINT) AS start_byte, CAST(start_byte >= 400 OR token_count * 3 > 300 AS INTEGER) AS safe FROM s""")
def prefix_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached prefix of 400 bytes worth 300 micro-USD; saved tokens cost 3 each."""
    rows = common.byte_offsets(S.segments(conversations(spark, sf_dir)))
    safe = common.prefix_safe(F.col("start_byte"), F.lit(400), F.col("token_count"), F.lit(3), F.lit(300))
    return rows.select("request_id", "seg_idx", "start_byte", safe.cast("int").alias("safe"))


@query()
def dedupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.similar_pairs(S.segments(conversations(spark, sf_dir)))


@query(f"""WITH a AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT p.vec_id AS a, q.vec_id AS b, round(list_inner_product(p.v, q.v) / (sqrt(list_inner_product(p.v, p.v)) * sqrt(list_inner_product(q.v, q.v))), 4) AS cosine
FROM a p JOIN a q ON p.label = q.label AND p.vec_id % 100 = 0 AND q.vec_id <> p.vec_id WHERE list_inner_product(p.v, q.v) / (sqrt(list_inner_product(p.v, p.v)) * sqrt(list_inner_product(q.v, q.v))) >= 0.3""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours with a cosine of 0.3 of the query vectors (every hundredth) within their label."""
    from ..operators.vectors import neighbours

    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("namespace"), "embedding")
    return neighbours(rows, rows.where("vec_id % 100 = 0"), least=0.3).select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), F.round("cosine", 4).alias("cosine"))


@query()
def dedupe_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = S.segments(conversations(spark, sf_dir))
    return dedupe.clusters(segs, dedupe.similar_pairs(segs))


EXACT_SQL = r"sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"""WITH d AS (SELECT doc_id, source, {EXACT_SQL} AS h, CAST(doc_id % 7 = 0 AS INTEGER) AS in_prefix FROM documents)
SELECT h AS rewrite_hash, arg_min(doc_id, (1 - in_prefix) * 1000000000 + doc_id) AS representative, count(*) AS members FROM d GROUP BY h""")
def dedupe_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seg_idx"), T.rewrite_hash(F.col("text")).alias("rewrite_hash"), (F.col("doc_id") % 7 == 0).alias("in_prefix"))
    return dedupe.representatives(rows, ["rewrite_hash"])


@query(f"""WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY source, {EXACT_SQL} ORDER BY doc_id) AS copy FROM documents) SELECT doc_id AS seg_idx FROM d WHERE copy = 1""")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as segments of one request."""
    rows = load(spark, sf_dir, "documents").select(F.col("source").alias("request_id"), F.col("doc_id").alias("seg_idx"), F.lit("RETRIEVED_DOC").alias("segment_type"), "text")
    return dedupe.drop_exact(rows).select("seg_idx")


FILLER_ROWS = [(1, "Please make sure that you always answer. In order to help, please note that this is it."), (2, "You must always be kind. Your task is to sum up."), (3, "As an AI assistant, I would like you to go."), (4, "You should always read. Make sure to stop."), (5, "nothing here"), (6, "I want you to never lie. You will need to work.")]


def _filler_sql(x: str) -> str:
    """The rules in a dialect without a fold: one level of subquery a rule."""
    tokens = lambda c: rf"list_distinct(list_transform(regexp_extract_all({c}, '(?i)\b({T.NORMATIVE_WORDS})\b'), lambda w: lower(regexp_replace(w, '\s+', ' ', 'g'))))"
    inner = f"SELECT id, {x} AS t FROM src"
    for pattern, new in fillers.FILLERS:
        p = pattern.replace("'", "''")
        inner = f"SELECT id, CASE WHEN len(list_filter({tokens('t')}, lambda w: NOT list_contains({tokens('n')}, w))) = 0 THEN n ELSE t END AS t FROM (SELECT id, t, regexp_replace(t, '(?i){p}', '{new}', 'g') AS n FROM ({inner}))"
    return inner


@query(f"WITH src AS (SELECT * FROM {literal(FILLER_ROWS, ['id', 'text'])} UNION ALL SELECT conv_id + 1000, text FROM conversations WHERE role = 'system') SELECT id, t AS text FROM ({_filler_sql('text')})")
def filler_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(FILLER_ROWS, "id long, text string")
    rows = fixed.unionByName(conversations(spark, sf_dir).where("role = 'system'").select((F.col("conv_id") + 1000).alias("id"), "text"))
    return rows.select("id", fillers.strip_fillers(F.col("text")).alias("text"))


@query(f"SELECT left(h, 16) AS prefix_hash, count(*) AS reuse_count FROM (SELECT {EXACT_SQL} AS h FROM conversations WHERE role = 'system') GROUP BY 1")
def template_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).where("role = 'system'").groupBy(F.left(T.rewrite_hash(F.col("text")), F.lit(16)).alias("prefix_hash")).agg(F.count("*").alias("reuse_count"))


TEMPLATE_SQL = f"""t AS (SELECT tenant_id, query_key, count(*) AS reuse_count FROM {REQUESTS_SQL} GROUP BY ALL)"""


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).groupBy("tenant_id", "query_key").agg(F.count("*").alias("reuse_count"))


@query(f"WITH {TEMPLATE_SQL} SELECT r.request_id, CASE WHEN t.reuse_count >= 3 THEN 'c' || t.query_key END AS rewritten FROM {REQUESTS_SQL} r LEFT JOIN t ON r.tenant_id = t.tenant_id AND r.query_key = t.query_key AND t.query_key % 2 = 0")
def template_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified stored rewrites (even keys, used three times) by template and tenant."""
    stored = templates(spark, sf_dir).where("query_key % 2 = 0 AND reuse_count >= 3").select("tenant_id", "query_key", F.concat(F.lit("c"), "query_key").alias("rewritten"))
    return request_log(spark, sf_dir).join(stored, ["tenant_id", "query_key"], "left").select("request_id", "rewritten")


@query(f"""WITH {TEMPLATE_SQL} SELECT tenant_id, query_key, CASE WHEN reuse_count < 3 THEN 'skipped_low_reuse' WHEN reuse_count * 40 <= 150 THEN 'breakeven_failed' WHEN query_key % 5 = 0 THEN 'rewriter_error' WHEN query_key % 3 = 0 THEN 'verify_failed' ELSE 'ok' END AS status FROM t""")
def rewrite_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("query_key")
    rows = templates(spark, sf_dir).select("*", (F.col("reuse_count") * 40 > 150).alias("breakeven"), F.when(key % 5 != 0, "x").alias("rewritten"), (key % 3 != 0).alias("verified"))
    return fillers.job_status(rows, min_reuse=3).select("tenant_id", "query_key", "status")


VERIFY_ROWS = [(1, "You must never lie", "never lie, you must", "lie"), (2, "You must never lie", "do not lie", "lie"), (3, "keep ABC", "keep abc", "ABC"), (4, "keep ABC", "keep", "ABC"), (5, "Only go", "go", "go")]


@query(f"""SELECT id, CAST(len(list_filter(regexp_extract_all(lower(a), '\\b({T.NORMATIVE_WORDS})\\b'), lambda w: NOT list_contains(regexp_extract_all(lower(b), '\\b({T.NORMATIVE_WORDS})\\b'), w))) = 0 AND contains(lower(b), lower(v)) AS INTEGER) AS ok FROM {literal(VERIFY_ROWS, ['id', 'a', 'b', 'v'])}""")
def rewrite_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(VERIFY_ROWS, "id int, a string, b string, v string")
    return rows.select("id", fillers.rewrite_ok(F.col("a"), F.col("b"), F.array("v")).cast("int").alias("ok"))


@query(f"SELECT request_id, CAST(tokens_in > 2000 * 1.5 AND request_class <> 'CHAT_OPEN' AS INTEGER) AS applies FROM {REQUESTS_SQL}")
def s3_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = request_log(spark, sf_dir)
    status = F.when(F.col("request_class") == "CHAT_OPEN", "DISABLED").otherwise("ALLOWED")
    return rows.select("request_id", window.applies(F.col("tokens_in"), F.lit(2000), F.lit(True), status).cast("int").alias("applies"))


CHUNKS_SQL = """(SELECT doc_id AS id, CAST(i AS INTEGER) AS chunk_idx, CAST(greatest(1, ceil(length(text) / 896)) AS INTEGER) AS n_chunks, substr(text, CAST(i * 896 + 1 AS INTEGER), 1024) AS chunk
FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil(length(text) / 896) - 1) AS INTEGER))) AS i FROM documents))"""


@query(f"SELECT id, chunk_idx, n_chunks, {sql_tokens('chunk')} AS tokens, sha256(chunk) AS chunk_sha256 FROM {CHUNKS_SQL}")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.chunks(load(spark, sf_dir, "documents")).select("id", "chunk_idx", "n_chunks", "tokens", F.sha2("chunk", 256).alias("chunk_sha256"))


def document_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document asked for by the last eight words of its text."""
    found = T.words(F.col("text"))
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.slice(found, F.greatest(F.size(found) - 7, F.lit(1)), 8), " ").alias("query"))


QUERIES_SQL = f"(SELECT doc_id AS id, array_to_string(({sql_words('text')})[-8:], ' ') AS query FROM documents)"
BM25_CTE = f"""c AS (SELECT id, chunk_idx, {sql_words('lower(chunk)')} AS ws FROM {CHUNKS_SQL}),
n AS (SELECT id, count(*) AS n, greatest(avg(len(ws)), 1.0) AS avg_len FROM c GROUP BY id),
q AS (SELECT id, term, count(*) AS times FROM (SELECT id, unnest({sql_words('lower(query)')}) AS term FROM {QUERIES_SQL}) GROUP BY ALL),
tf AS (SELECT id, chunk_idx, len, term, count(*) AS tf FROM (SELECT id, chunk_idx, len(ws) AS len, unnest(ws) AS term FROM c) GROUP BY ALL),
m AS (SELECT tf.*, q.times FROM tf JOIN q ON tf.id = q.id AND tf.term = q.term), df AS (SELECT id, term, count(*) AS df FROM m GROUP BY ALL),
b AS (SELECT m.id, chunk_idx, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS bm25 FROM m JOIN df ON m.id = df.id AND m.term = df.term JOIN n ON m.id = n.id GROUP BY ALL)"""


@query(f"WITH {BM25_CTE} SELECT c.id, c.chunk_idx, CAST(round(coalesce(bm25, 0) * 1000) AS BIGINT) AS bm25_milli FROM c LEFT JOIN b ON c.id = b.id AND c.chunk_idx = b.chunk_idx")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window.bm25(window.chunks(load(spark, sf_dir, "documents")), document_queries(spark, sf_dir))
    return rows.select("id", "chunk_idx", F.round(F.col("bm25") * 1000).cast("long").alias("bm25_milli"))


@query(f"SELECT id, chunk_idx, round(CASE WHEN least(chunk_idx, n_chunks - 1 - chunk_idx) = 0 THEN 1.0 ELSE 1.0 - 0.7 * (least(chunk_idx, n_chunks - 1 - chunk_idx) - 1) / greatest((n_chunks - 1) / 2 - 1, 1.0) END, 6) AS prior FROM {CHUNKS_SQL}")
def position_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.chunks(load(spark, sf_dir, "documents")).select("id", "chunk_idx", F.round(window.position_prior(F.col("chunk_idx"), F.col("n_chunks")), 6).alias("prior"))


@query(f"""WITH {BM25_CTE}, k AS (SELECT k.*, query FROM {CHUNKS_SQL} k JOIN {QUERIES_SQL} q ON k.id = q.id),
t AS (SELECT id, chunk_idx, w, sum(x) AS x, sum(y) AS y FROM (SELECT id, chunk_idx, unnest(regexp_extract_all(lower(query), '[a-z]+')) AS w, 1 AS x, 0 AS y FROM k UNION ALL SELECT id, chunk_idx, unnest(regexp_extract_all(lower(chunk), '[a-z]+')), 0, 1 FROM k) GROUP BY ALL),
z AS (SELECT id, chunk_idx, CASE WHEN sum(x) = 0 OR sum(y) = 0 THEN 0.0 ELSE sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) END AS cosine FROM t GROUP BY ALL),
l AS (SELECT k.id, k.chunk_idx, k.n_chunks, coalesce(bm25, 0) AS lex, max(coalesce(bm25, 0)) OVER (PARTITION BY k.id) AS top FROM k LEFT JOIN b ON k.id = b.id AND k.chunk_idx = b.chunk_idx)
SELECT l.id, l.chunk_idx, round(0.7e0 * coalesce(cosine, 0) + 0.2e0 * CASE WHEN top > 0 THEN lex / top ELSE 0 END
 + 0.1e0 * CASE WHEN least(l.chunk_idx, n_chunks - 1 - l.chunk_idx) = 0 THEN 1e0 ELSE 1e0 - 0.7e0 * (least(l.chunk_idx, n_chunks - 1 - l.chunk_idx) - 1) / greatest((n_chunks - 1) / 2 - 1, 1.0) END, 6) AS score
FROM l LEFT JOIN z ON l.id = z.id AND l.chunk_idx = z.chunk_idx""")
def chunk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.chunk_scores(window.chunks(load(spark, sf_dir, "documents")), document_queries(spark, sf_dir)).select("id", "chunk_idx", F.round("score", 6).alias("score"))


def _length_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks scored by a fixed rule, so that ranks are whole numbers."""
    parts = window.chunks(load(spark, sf_dir, "documents"))
    return parts.withColumn("score", ((F.col("id") * 31 + F.col("chunk_idx") * 17) % 101).cast("long"))


MASS_CTE = f"""k AS (SELECT id, chunk_idx, chunk, {sql_tokens('chunk')} AS tokens, (id * 31 + chunk_idx * 17) % 101 AS score FROM {CHUNKS_SQL}),
r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER (PARTITION BY id ORDER BY score DESC, chunk_idx ROWS UNBOUNDED PRECEDING) AS mass, sum(tokens) OVER (PARTITION BY id) AS total FROM k WINDOW w AS (PARTITION BY id ORDER BY score DESC, chunk_idx)),
s AS (SELECT id, min(rank) FILTER (WHERE mass >= 0.6 * total) AS stop FROM r GROUP BY id)"""


@query(f"WITH {MASS_CTE} SELECT r.id, chunk_idx FROM r JOIN s USING (id) WHERE rank <= stop")
def topmass_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.top_mass(_length_scored(spark, sf_dir), 0.6).where("kept").select("id", "chunk_idx")


@query(rf"""WITH {MASS_CTE}, i AS (SELECT doc_id AS id, unnest(list_distinct(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))) AS value FROM documents),
f AS (SELECT i.id, value, min(CASE WHEN contains(chunk, value) THEN rank END) AS first FROM i JOIN r ON r.id = i.id GROUP BY ALL),
c AS (SELECT id, max(coalesce(first, 1 << 30)) AS cover FROM f GROUP BY id)
SELECT r.id, chunk_idx FROM r JOIN s ON r.id = s.id LEFT JOIN c ON r.id = c.id WHERE rank <= greatest(stop, coalesce(cover, 0))""")
def cover_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass and the cover of every document's acronyms, then neighbours."""
    items = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(M.found(F.col("text"), M.ACRONYM))).alias("value"))
    return window.top_mass(_length_scored(spark, sf_dir), 0.6, items).where("kept").select("id", "chunk_idx")


@query(f"""WITH {MASS_CTE}, k2 AS (SELECT r.id, chunk_idx, chunk, rank <= stop AS kept FROM r JOIN s USING (id)),
n AS (SELECT *, coalesce(lag(kept) OVER w, false) OR coalesce(lead(kept) OVER w, false) AS beside FROM k2 WINDOW w AS (PARTITION BY id ORDER BY chunk_idx)),
q AS (SELECT id, list_filter({sql_words('lower(query)')}, lambda w: length(w) >= 4) AS ws FROM {QUERIES_SQL})
SELECT n.id, chunk_idx FROM n LEFT JOIN q ON n.id = q.id WHERE kept OR (beside AND len(list_filter(ws, lambda w: contains(lower(chunk), w))) > 0)""")
def neighbor_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = document_queries(spark, sf_dir).select("id", F.col("query").alias("span"))
    return window.force_neighbours(window.top_mass(_length_scored(spark, sf_dir), 0.6), spans).where("kept").select("id", "chunk_idx")


@query(f"""WITH {MASS_CTE}, o AS (SELECT r.id, chunk_idx, chunk, lag(chunk_idx) OVER (PARTITION BY r.id ORDER BY chunk_idx) AS before FROM r JOIN s USING (id) WHERE rank <= stop)
SELECT id, sha256(string_agg(CASE WHEN chunk_idx - before > 1 THEN '[…]' || chr(10) ELSE '' END || chunk, chr(10) ORDER BY chunk_idx)) AS text_sha256 FROM o GROUP BY id""")
def reassemble_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window.reassemble(window.top_mass(_length_scored(spark, sf_dir), 0.6)).select("id", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) > 1 AS INTEGER) AS repeat FROM documents")
def repeat_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for a conversation."""
    return documents.repeats(load(spark, sf_dir, "documents"), ["source"], "doc_id").select("doc_id", "repeat")


@query(f"SELECT conv_id, turn, CAST(NOT {sql_word('text', T.FULL_DOCUMENT)} AND {sql_tokens('text')} >= 100 AS INTEGER) AS applies FROM conversations")
def s4_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return conversations(spark, sf_dir).select("conv_id", "turn", documents.applies(text, T.token_estimate(text), F.col("conv_id"), F.lit("ALLOWED"), 100).cast("int").alias("applies"))


@query()
def racr_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated documents as a header and their best chunks."""
    again = documents.repeats(load(spark, sf_dir, "documents"), ["source"], "doc_id").where("repeat = 1")
    scored = window.chunk_scores(window.chunks(again), document_queries(spark, sf_dir))
    out = documents.replacement(scored, again.select(F.col("doc_id").alias("id"), "doc_hash", T.title_guess(F.col("text")).alias("title")))
    return out.select("id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


FIRST_LINE = sql_strip("string_split(text, chr(10))[1]")


@query(f"""SELECT doc_id, CASE WHEN len({sql_words(FIRST_LINE)}) BETWEEN 1 AND 10 AND NOT regexp_matches({FIRST_LINE}, '[.?!]$') THEN {FIRST_LINE} ELSE array_to_string(({sql_words('text')})[1:5], ' ') || '...' END AS title FROM documents""")
def title_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.title_guess(F.col("text")).alias("title"))


GROUPS_SQL = """(SELECT *, CAST(sum(CASE WHEN role = 'user' OR before = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_group
FROM (SELECT conv_id AS request_id, turn AS seg_idx, role, text, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'assistant') AS before FROM conversations WHERE role IN ('user', 'assistant')))"""


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.turn_groups(S.segments(conversations(spark, sf_dir)))


@query(f"SELECT request_id, seg_idx, turn_group FROM {GROUPS_SQL}")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).select("request_id", "seg_idx", "turn_group")


@query(f"SELECT request_id, seg_idx FROM (SELECT *, max(turn_group) OVER (PARTITION BY request_id) AS last FROM {GROUPS_SQL}) WHERE turn_group <= last - 2")
def aging_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.aging(grouped(spark, sf_dir), 2).select("request_id", "seg_idx")


@query(f"""WITH g AS {GROUPS_SQL}, t AS (SELECT request_id, turn_group, len(list_distinct(ws)) / len(ws) AS ttr FROM (SELECT *, {sql_words('lower(text)')} AS ws FROM g WHERE role = 'assistant')),
r AS (SELECT request_id, turn_group FROM (SELECT *, avg(ttr) OVER (PARTITION BY request_id) AS mean FROM t) WHERE ttr > 1.05 * mean) SELECT g.request_id, seg_idx FROM g JOIN r USING (request_id, turn_group)""")
def exemplar_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.exemplars(grouped(spark, sf_dir), 1.05)


@query(name="ledger")
def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.entries(grouped(spark, sf_dir), 1).select("request_id", "seg_idx", "place", "bucket", "sentence")


BUCKET_ROWS = [(1, "We must go."), (2, "It cost $5M."), (3, "Is it done?"), (4, "Plain words."), (5, "Use tabs."), (6, "Growth of 12% in may"), (7, "Ask CRF-21 about it"), (8, "I want tea"), (9, "Do not wait 5 days?")]


@query(f"""SELECT id, CASE WHEN regexp_matches(s, '(?i)\\b(?:must|never|always|only|exactly|shall|do not|required|forbidden|shall not|should not|need to|have to)\\b') OR regexp_matches(s, '(?i)\\b(?:i want|use |in [a-z]+|format|write in|reply in|respond in)\\b') THEN 'decision'
WHEN regexp_matches(s, '\\$[0-9,]+(?:\\.[0-9]+)?[MBKkm]?|\\b[0-9]+(?:[,0-9]*\\.?[0-9]+)?(?:%|percent)?\\b|\\b[A-Z]{{2,}}(?:-[A-Z0-9]+)+\\b') THEN 'fact' WHEN s LIKE '%?' THEN 'open' END AS bucket
FROM (SELECT * FROM {literal(BUCKET_ROWS, ['id', 's'])} UNION ALL SELECT conv_id * 100 + turn + 1000, trim(regexp_replace(text, '[^\\x20-\\x7E]+', 'x', 'g')) FROM conversations)""")
def ledger_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(BUCKET_ROWS, "id long, s string")
    rows = fixed.unionByName(conversations(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn") + 1000).alias("id"), F.trim(F.regexp_replace("text", r"[^\x20-\x7E]+", "x")).alias("s")))
    return rows.select("id", ledger.bucket(F.col("s")).alias("bucket"))


@query("""SELECT conv_id AS request_id, '«Conversation ledger: decisions=[' || coalesce(string_agg(text, '; ' ORDER BY turn) FILTER (WHERE turn % 3 = 0), 'none') || '], facts=[' || coalesce(string_agg(text, '; ' ORDER BY turn) FILTER (WHERE turn % 3 = 1), 'none')
|| '], open=[' || coalesce(string_agg(text, '; ' ORDER BY turn) FILTER (WHERE turn % 3 = 2), 'none') || ']»' AS ledger FROM conversations GROUP BY conv_id""")
def ledger_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("decision"), F.lit("fact"), F.lit("open")), (F.col("turn") % 3 + 1).cast("int"))
    rows = conversations(spark, sf_dir).select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seg_idx"), F.lit(0).alias("place"), F.col("text").alias("sentence"), kind.alias("bucket"))
    return ledger.formatted(rows)


@query(f"SELECT request_id, CAST(coalesce(min(seg_idx) FILTER (WHERE seg_idx >= 1 AND request_id % 3 = 0), count(*)) AS BIGINT) AS first_changed FROM {SEGMENTS_SQL} GROUP BY request_id")
def first_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation changes from its second turn on."""
    before = S.segments(conversations(spark, sf_dir))
    changed = F.when((F.col("request_id") % 3 == 0) & (F.col("seg_idx") >= 1), F.lit("x")).otherwise(F.col("segment_hash"))
    return ledger.first_changed(before, before.withColumn("segment_hash", changed))


@query()
def resurrect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped(spark, sf_dir)
    old = ledger.aging(rows, 1)
    ledgers = ledger.formatted(ledger.entries(rows, 1))
    return ledger.resurrect(old, ledgers, S.final_user_query(conversations(spark, sf_dir)), 0.05).select("request_id", "seg_idx", F.round("gain", 6).alias("gain"))


@query(r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_sha256
FROM (SELECT page_id, replace(html, '<p>', '  ' || chr(10) || chr(10) || chr(10) || '  ') AS t FROM pages)""")
def whitespace_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<p>"), F.lit("  \n\n\n  ")).alias("t"))
    return rows.select("page_id", F.sha2(hygiene.canonical(F.col("t"), F.lit("USER_QUERY")), 256).alias("text_sha256"))


@query("""SELECT event_id, replace(props, ': ', ':') AS text FROM events""")
def json_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", hygiene.minified(F.col("props"), F.lit("STRUCTURED_DATA")).alias("text"))


@query("""SELECT conv_id, turn, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN ltrim(x) LIKE '|%' THEN array_to_string(list_transform(string_split(x, '|'), lambda c: trim(c)), '|') ELSE x END), chr(10)) AS text
FROM (SELECT conv_id, turn, ' |  ' || replace(text, ',', '  |  ') || ' |' || chr(10) || '  no  table' AS t FROM conversations)""")
def table_depad(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit(" |  "), F.replace("text", F.lit(","), F.lit("  |  ")), F.lit(" |\n  no  table"))
    return conversations(spark, sf_dir).select("conv_id", "turn", T.depad_tables(made).alias("text"))


@query()
def tool_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's text as a result too, followed by the conversation: each is superseded by its own turn."""
    segs = S.segments(conversations(spark, sf_dir)).select("request_id", (F.col("seg_idx") + 100).alias("seg_idx"), "role", "segment_type", "text")
    results = segs.where("segment_type = 'ASSISTANT_TURN'").select("request_id", (F.col("seg_idx") - 100).alias("seg_idx"), F.lit("tool").alias("role"), F.lit("TOOL_RESULT").alias("segment_type"), "text")
    return hygiene.expired(segs.unionByName(results), keep_after=1)


@query("""SELECT conv_id AS request_id, turn AS seg_idx, CAST(coalesce(sum(CAST(role = 'assistant' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS turns_after FROM conversations""")
def assistant_turns_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = S.segments(conversations(spark, sf_dir)).withColumn("segment_type", F.when(F.col("role") == "assistant", "ASSISTANT_TURN").otherwise("OTHER"))
    return hygiene.assistant_turns_after(segs).select("request_id", "seg_idx", "turns_after")


@query(r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?s)^(.*?[.!?])\s', 1), ''), text) AS text FROM documents")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", hygiene.pruned_schema(F.col("text")).alias("text"))


@query()
def s7_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import arrow as P

    rows = load(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), P.semantic_density("text").alias("density"))
    return rows.select("doc_id", lossy.applies(F.lit(True), F.lit("ALLOWED"), F.col("tokens"), F.lit(200), F.col("density")).cast("int").alias("applies"))


PROTECT_SQL = """list_filter(list_distinct(ws), lambda w: contains('the theatre', regexp_replace(lower(w), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g')) OR contains(regexp_replace(lower(w), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g'), 'the theatre')
 OR contains('ing', regexp_replace(lower(w), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g')) OR contains(regexp_replace(lower(w), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g'), 'ing'))"""


@query(f"SELECT doc_id, CAST(len({PROTECT_SQL}) AS INTEGER) AS n_protected FROM (SELECT doc_id, {sql_words('text')} AS ws FROM documents)")
def protected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.lit("the theatre"), F.lit("ing"))
    found = F.filter(F.array_distinct(T.words(F.col("text"))), lambda w: lossy.protected(w, values))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_protected"))


@query(f"""WITH w AS (SELECT doc_id AS id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM (SELECT doc_id, {sql_words('text')} AS ws FROM documents)),
c AS (SELECT id, word, count(*) AS freq, min(place) AS first FROM w GROUP BY ALL), n AS (SELECT id, sum(freq) AS n FROM c GROUP BY id),
l AS (SELECT c.*, n.n, coalesce(sum(freq) OVER (PARTITION BY c.id ORDER BY freq, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass FROM c JOIN n ON c.id = n.id WHERE NOT contains(lower(word), 'the') AND NOT contains('the', regexp_replace(lower(word), '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g'))),
g0 AS (SELECT id, word, freq, n FROM l WHERE mass < n - greatest(1, floor(n / 1.5))), ok AS (SELECT id FROM g0 GROUP BY id HAVING sum(freq) < max(n)), g AS (SELECT g0.id, word FROM g0 JOIN ok ON g0.id = ok.id),
k AS (SELECT w.id, string_agg(w.word, ' ' ORDER BY place) AS text, count(*) AS kept FROM w LEFT JOIN g ON w.id = g.id AND w.word = g.word WHERE g.word IS NULL GROUP BY w.id)
SELECT n.id, sha256(coalesce(text, '')) AS text_sha256, CAST(n AS BIGINT) AS n_words, CAST(n - coalesce(kept, 0) AS BIGINT) AS n_dropped FROM n LEFT JOIN k ON n.id = k.id""")
def lossy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    values = docs.select("id", F.array(F.lit("the")).alias("values"))
    return lossy.drop_rare(docs, values).select("id", F.sha2("text", 256).alias("text_sha256"), "n_words", "n_dropped")
