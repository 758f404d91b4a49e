"""The ``opN`` queries: thin wrappers that apply an operator to its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, mixing, pii, quality, simhash, substrings, tokens, topk, webtext


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantise(F.col("embedding")).alias("vector"))
    return topk.exact_topk(rows, rows.where("vec_id % 50 = 0"), k=5)


def op2_web_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.main_texts(table(spark, sf_dir, "pages"), webtext.train())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_turns(rows.unionByName(more)))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap; clean documents have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("contamination").alias("c")).select("doc_id", "c.*")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii.train())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix whose sources weigh the square root of their size."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_phase", "mix_slot", "mix_position")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_web_text, op3_substring_dedup, op4_chat_format, op5_benchmark_decontamination, op6_personal_data, op7_token_counts, op8_simhash_near_dedup, op9_source_mix, op10_quality)}

ORACLE: dict[str, str] = {
    "op1_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
           FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_benchmark_decontamination": r"""
WITH dw AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p, len(ws) AS n_doc FROM
             (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
iw AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS q, len(ws) AS n_item, least(13, len(ws)) AS size,
              CASE WHEN len(ws) < 8 THEN len(ws) ELSE (4 * least(13, len(ws)) + 4) // 5 END AS need FROM
             (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark)),
lined AS (SELECT doc_id, item_id, p - q AS place, any_value(n_doc) AS n_doc, any_value(n_item) AS n_item, any_value(size) AS size, any_value(need) AS need, list(p) AS ps
          FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) >= any_value(need)),
places AS (SELECT doc_id, item_id, place, size, need, ps, unnest(generate_series(greatest(0, place), least(n_doc, place + n_item) - size)) AS s FROM lined),
good AS (SELECT * FROM places WHERE len(list_filter(ps, lambda p: p >= s AND p < s + size)) >= need),
inside AS (SELECT doc_id, item_id, place, unnest(list_filter(ps, lambda p: p >= s AND p < s + size)) AS p FROM good),
found AS (SELECT doc_id, item_id, place, min(p) AS start, max(p) - min(p) + 1 AS n_words, count(DISTINCT p) AS n_equal FROM inside GROUP BY ALL)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(n_words AS INTEGER) AS n_words, CAST(n_equal AS INTEGER) AS n_equal FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start, place) = 1""",
    "op4_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+12], ' ')) AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM windows JOIN firsts USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
}
