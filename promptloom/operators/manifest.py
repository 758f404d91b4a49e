"""Constraints that a rewrite must keep: extraction, governing spans, coverage and polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

# Fixed patterns.
CAPITALISED = r"(?<!\.\s)(?<!\n)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"
ACRONYM = r"\b([A-Z]{2,})\b"
IDENTIFIER = r"\b([a-z]+[A-Z]\w*|[A-Z]+_[A-Z_]+|[a-z]+\.[a-z_]+)\b"
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
NUMBERS = [
    r"((?:[$€£¥][0-9,.]+[KMBTkmbt]?|(?:USD|EUR|GBP|JPY|CAD)\s*[0-9,.]+[KMBTkmbt]?))",
    r"\b([0-9]+(?:\.[0-9]+)?\s*%)",
    rf"(?i)\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|Q[1-4]\s+[0-9]{{4}}|(?:{MONTHS})\s+[0-9]{{4}})\b",
    r"\b(v?[0-9]+\.[0-9]+(?:\.[0-9]+)*)\b",
    r"\b([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\b|\b[0-9]+\.[0-9]+)\b",
]
CLAUSE = r"(?i)([^.!?\n]*\b(?:must|never|always|only|exactly|do not|required|forbidden|shall not|should not|at least|at most|you must|you should not|is required|are required|is forbidden|are forbidden)\b[^.!?\n]*[.!?]?)"
QUOTED = r"""("[^"\n]{2,}"|(?<![A-Za-z])'[^'\n]{2,}')"""
SLASHED = r"(/[^/\s]{3,}/[gimsuy]*)"
JSON_KEY = r'"(\w[\w_-]*)"(?=\s*:)'


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), 1)


def entities(text: Column) -> Column:
    every = F.concat(found(text, CAPITALISED), found(text, ACRONYM), found(text, IDENTIFIER))
    return F.array_distinct(F.filter(F.transform(every, T.strip), lambda x: F.length(x) > 1))


def numbers(text: Column) -> Column:
    every = F.concat(*(found(text, p) for p in NUMBERS))
    return F.array_distinct(F.filter(F.transform(every, T.strip), lambda x: x != ""))


def normative_clauses(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found(text, CLAUSE), T.strip), lambda x: F.length(x) > 10))


def format_specs(text: Column) -> Column:
    every = F.concat(F.transform(F.concat(found(text, QUOTED), found(text, SLASHED)), T.strip), found(text, JSON_KEY))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def qualified(sentence: Column) -> Column:
    """Whether a sentence has a qualifier or a pronoun that points back."""
    single = "|".join(w for w in T.QUALIFIERS + T.PRONOUNS if " " not in w)
    phrases = [w for w in T.QUALIFIERS if " " in w]
    low = F.lower(sentence)
    out = low.rlike(rf"(?U)\b(?:{single})\b")
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def governing_span(value: Column, sentences: Column) -> Column:
    """The first sentence with the value, and a neighbour on either side if it is qualified; all sentences if none has it."""
    at = F.array_position(F.transform(sentences, lambda s: F.contains(s, value)), F.lit(True)).cast("int")
    neighbour = lambda i: F.when(qualified(F.try_element_at(sentences, i)), F.try_element_at(sentences, i))
    before = F.when(at > 1, neighbour(F.when(at > 1, at - 1).otherwise(F.lit(1))))
    span = F.concat_ws(" ", before, F.try_element_at(sentences, F.greatest(at, F.lit(1))), neighbour(at + 1))
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.array_join(sentences, " ")).otherwise(span)


def extract(segs: DataFrame) -> DataFrame:
    """(request_id, item_type, value, source_segment_hash, governing_span, polarity_guard): the first of each type and value. Normative
    clauses come from system segments, query terms from the last user segment."""
    text = F.col("text")
    items = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("item_type"), v.alias("value")))
    none = F.array().cast("array<string>")
    last = Window.partitionBy("request_id", "role").orderBy(F.col("seg_idx").desc())
    rows = segs.withColumn("is_query", (F.col("role") == "user") & (F.row_number().over(last) == 1)).withColumn("sentences", T.sentences(text))
    every = F.concat(
        items("entity", entities(text)), items("number", numbers(text)), items("normative", F.when(F.col("role") == "system", normative_clauses(text)).otherwise(none)),
        items("format", format_specs(text)), items("query_term", F.when(F.col("is_query"), T.query_terms(text)).otherwise(none)),
    )
    rows = rows.select("request_id", "seg_idx", "segment_hash", "sentences", F.posexplode(every).alias("place", "item"))
    first = F.min(F.struct("seg_idx", "place", "segment_hash", "sentences")).alias("f")
    rows = rows.groupBy("request_id", "item.item_type", "item.value").agg(first)
    span = governing_span(F.col("value"), F.col("f.sentences"))
    spanned = rows.select("request_id", "item_type", "value", F.col("f.segment_hash").alias("source_segment_hash"), span.alias("governing_span"))
    return spanned.withColumn("polarity_guard", T.polarity_guard(F.col("governing_span")))


def qualifiers_in(span: Column) -> Column:
    low = F.lower(span)
    lexicon = F.array(*map(F.lit, T.QUALIFIERS))
    return F.filter(lexicon, lambda t: F.when(F.instr(t, " ") > 0, F.contains(low, t)).otherwise(F.regexp_like(low, F.concat(F.lit(r"(?U)\b"), t, F.lit(r"\b")))))


def qualifiers_survive(value: Column, span: Column, text: Column) -> Column:
    """All qualifiers of the span lie within a sentence of some sentence with the value, or the span is there as it was."""
    need = qualifiers_in(span)
    whole = F.contains(T.collapse(text), T.collapse(span))
    sentences = T.coverage_sentences(text)
    around = lambda i: F.lower(F.array_join(F.slice(sentences, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " "))
    near = F.exists(F.transform(sentences, lambda s, i: F.contains(s, value) & F.forall(need, lambda t: F.contains(around(i), t))), lambda x: x)
    return (F.size(need) == 0) | whole | near


def coverage(items: DataFrame, texts: DataFrame, full: bool = True) -> DataFrame:
    """(request_id, coverage): share of a request's items whose value (and, if ``full``, qualifiers) is in its ``text``; 1 without items."""
    text = F.col("text")
    kept = F.contains(T.collapse(text), T.collapse(F.col("value")))
    if full:
        kept = kept & qualifiers_survive(F.col("value"), F.col("governing_span"), text)
    scored = texts.join(items, "request_id", "left").withColumn("kept", F.when(F.col("value").isNotNull(), F.coalesce(kept, F.lit(False)).cast("int")))
    return scored.groupBy("request_id").agg(F.coalesce(F.sum("kept") / F.count("kept"), F.lit(1.0)).alias("coverage"))


def polarity_intact(items: DataFrame, segs: DataFrame) -> DataFrame:
    """(request_id, intact): for every item its source segment is unchanged, or its span is still there, or the span around the value
    now has the same guard."""
    texts = segs.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda r: r["text"]), "\n\n").alias("text"), F.collect_set("segment_hash").alias("hashes"))
    same = F.array_contains("hashes", F.col("source_segment_hash"))
    verbatim = F.contains(T.collapse(F.col("text")), T.collapse(F.col("governing_span")))
    again = T.polarity_guard(governing_span(F.col("value"), T.sentences(F.col("text")))) == F.col("polarity_guard")
    joined = texts.join(items, "request_id", "left")
    ok = F.when(F.col("value").isNull(), True).otherwise(F.coalesce(same, F.lit(False)) | verbatim | again)
    return joined.groupBy("request_id").agg(F.bool_and(ok).cast("int").alias("intact"))
