"""Column functions over texts: hashes, token estimates, sniffers, splits and word tests.

All patterns are matched with Unicode classes (``(?U)``), and every function stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CHARS_PER_TOKEN = 3.8

# Lexicons and patterns that results depend on.
QUALIFIERS = ["projected", "estimated", "not", "except", "only", "excluding", "before", "after", "assuming", "unless", "approximately", "pending", "assumed", "as of", "up to", "at most", "at least", "subject to"]
NEGATIONS = ["not", "never", "no", "neither", "nor", "cannot", "can't", "won't", "wouldn't", "shouldn't", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "hardly", "rarely", "seldom", "projected", "estimated", "approximately", "pending", "assumed", "subject to"]
PRONOUNS = ["it", "its", "they", "their", "this", "that", "these", "those"]
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can to of in on at by for with from and or but not no "
    "if then else when where how what which who that this these those it its i you we they me him her us them my your our their "
    "up out about into through after before above below between over under so as just more also very too only than now here there"
).split()
NORMATIVE_WORDS = r"must|never|always|only|exactly|shall|do\s+not|required|forbidden|shall\s+not|should\s+not"
REFUSALS = r"i cannot|i'm not able|i am not able|i apologize, but|i can't|i'm unable|unable to|cannot assist|not able to help"
GREETINGS = ["thanks", "thank you", "sure", "of course", "certainly", "i'd be happy to", "i would be happy to", "great question", "good question", "absolutely", "no problem", "no worries", "i hope that helps", "let me know if you have any questions"]
FULL_DOCUMENT = r"whole\s+document|entire\s+report|all\s+pages|every\s+section|full\s+document|complete\s+report|read\s+everything|entire\s+text"
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "cf", "al", "eg", "ie", "etc", "approx", "est", "fig", "no", "vol", "pp"]

def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Every run of white space one space, ends stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_estimate(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """0 for an empty or null text, else at least 1."""
    size = F.coalesce(F.length(text), F.lit(0))
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.round(size / F.lit(chars_per_token)).cast("long"))).cast("long")


def normalise(text: Column) -> Column:
    """Runs of blanks one space, three or more line ends two, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def segment_hash(text: Column) -> Column:
    return F.sha2(normalise(text), 256)


def rewrite_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def has_word(text: Column, alternatives: str) -> Column:
    """Whether one of the alternatives occurs as whole words, in any case."""
    return text.rlike(rf"(?iU)\b(?:{alternatives})\b")


def looks_json(text: Column) -> Column:
    """Brackets at both ends and parses."""
    bare = strip(text)
    return bare.rlike(r"(?s)^[\[{].*[\]}]$") & F.try_parse_json(bare).isNotNull()


def looks_csv(text: Column) -> Column:
    """At least two lines that are not blank, the first five of them with one number of fields, two at least."""
    lines = F.filter(F.split(strip(text), r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), lambda x: x.rlike(r"(?U)\S"))
    fields = F.transform(F.slice(lines, 1, 5), lambda x: F.size(F.split(x, ",", -1)))
    return (F.size(lines) >= 2) & (F.size(F.array_distinct(fields)) == 1) & (F.get(fields, F.lit(0)) >= 2)


#: Fixed patterns of document marks, examples and code fences.
DOCUMENT_MARK = r"(?:^|\n)(?:---+|<doc>|</doc>|Source:|Document [0-9]+|## Document|\[Doc [0-9]+\])"
EXAMPLES = r"(?i)(?:(?:Input|Question|Q):\s*.+\n(?:Output|Answer|A):\s*.+\n?){2,}"
FENCE = r"(?m)^(`{3,}|~{3,})\s*\w*\s*$"
DOCUMENT_WORDS, LONG_WORDS = 80, 300


def segment_type(text: Column, role: Column) -> Column:
    """Type of one text block by the first rule that holds."""
    bare = strip(text)
    n = F.size(words(bare))
    is_system, is_assistant = role == "system", role == "assistant"
    document = ~is_system & ((bare.rlike(DOCUMENT_MARK) & (n >= DOCUMENT_WORDS)) | (~is_assistant & (n >= LONG_WORDS)))
    return (
        F.when(bare.rlike(FENCE), "CODE_BLOCK").when(looks_json(bare) | looks_csv(bare), "STRUCTURED_DATA").when(bare.rlike(EXAMPLES), "FEW_SHOT_EXAMPLE")
        .when(document, "RETRIEVED_DOC").when(is_system, "SYSTEM_INSTRUCTION").when(is_assistant, "ASSISTANT_TURN").when(role == "tool", "TOOL_RESULT").otherwise("USER_QUERY")
    )


def coverage_sentences(text: Column) -> Column:
    """Split after . ! ? and white space, and at line ends; no empty ones."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+|\n+"), strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Paragraphs cut after . ! ? before a capital or quote; a piece that ends in an abbreviation is put behind the sentence before it."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda p: p != "")
    pieces = F.filter(F.transform(F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"""(?U)(?<=[.!?])\s+(?=[A-Z"'])"""))), strip), lambda s: s != "")
    short = rf"(?iU)\b(?:{'|'.join(ABBREVIATIONS)})\.\s*$"
    # One pass: every piece is led by the mark that cuts or joins it, so that long texts stay linear.
    marked = F.transform(pieces, lambda s, i: F.concat(F.when((i > 0) & s.rlike(short), F.lit(" ")).otherwise(F.lit("\x01")), s))
    found = F.split(F.substring(F.array_join(marked, ""), 2, 1 << 30), "\x01")
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(pieces) == 0, F.array(text)).otherwise(found)


def normative_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?iU)\b({NORMATIVE_WORDS})\b"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"\s+", " ")))))


def polarity_guard(span: Column) -> Column:
    """SHA-256 of the negation and modality tokens that occur, sorted and joined by '|'; of nothing if there are none."""
    low = F.lower(span)
    lexicon = F.array(*(F.lit(t) for t in sorted(NEGATIONS)))
    found = F.filter(lexicon, lambda t: F.when(F.instr(t, " ") > 0, F.contains(low, t)).otherwise(F.regexp_like(low, F.concat(F.lit(r"(?U)\b"), t, F.lit(r"\b")))))
    return F.sha2(F.array_join(found, "|"), 256)


def query_terms(query: Column) -> Column:
    """Content words, first spelling of each, in order."""
    found = F.filter(F.regexp_extract_all(query, F.lit(r"(?U)\b([a-zA-Z_]\w*)\b"), 1), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(STOP_WORDS))
    low = F.transform(found, F.lower)
    return F.filter(found, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def title_guess(text: Column) -> Column:
    """The first line if it is short and no sentence, else the first five words."""
    line = strip(F.substring_index(text, "\n", 1))
    n = F.size(words(line))
    is_title = (n >= 1) & (n <= 10) & ~line.rlike(r"[.?!]$")
    return F.when(is_title, line).otherwise(F.concat(F.array_join(F.slice(words(text), 1, 5), " "), F.lit("...")))


def tidy(text: Column) -> Column:
    """Lines without trailing blanks, three or more line ends two, runs of blanks one space, ends stripped."""
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return normalise(lines)


def depad_tables(text: Column) -> Column:
    """Cells of lines that begin with a bar stripped."""
    line = lambda x: F.when(F.ltrim(x).startswith("|"), F.array_join(F.transform(F.split(x, r"\|", -1), lambda c: F.trim(c)), "|")).otherwise(x)
    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*?[.!?])\s", 1)


def answer_tokens(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"""[!-/:-@\[-`{-~]""", ""), r"(?U)\b(a|an|the)\b", " ")
    return words(bare)
