"""Text columns: normalisation of statements, sentences, shingles, prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The surface rules of statements.
URL = r"(?iU)\b(?:https?://|www\.)\S+\b"
EMAIL = r"(?iU)\b[\w\.-]+@[\w\.-]+\.\w+\b"
LEADING_SUBJECT = r"(?iU)^(?:it|this|that|they|these|those|this\s+product|this\s+item|the\s+item|the\s+product)\b\s*"
PUNCTUATION = r"[\/\\\|\(\)\[\]\{\}:;\"“”‘’`~^+=<>]"
DASHES = r"[\-_–—]+"
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000",
}
DIGITS = r"(?U)\b\d+(?:[.,]\d+)?\b"
TRAILING_DOTS = r"[.!?]+$"
TRAILING_FILLER = r"(?iU)\b(?:overall|anyway)\b$"
# Word endings and words by which a plain tagger tells adjectives and function words; other words count as nouns.
ADJECTIVE_ENDINGS = r"(?:able|ible|al|ful|ic|ish|ive|less|ous|y)$"
ADJECTIVES = ["bad", "best", "better", "big", "easy", "fast", "fine", "good", "great", "hard", "high", "large", "light", "long", "low", "new", "nice", "old", "poor", "short", "small", "soft", "strong", "thick", "thin", "worst"]
FUNCTION_WORDS = ["a", "am", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "his", "if", "in", "is", "it", "its", "just", "no", "not", "of", "on", "or", "she", "so", "than", "that", "the", "their", "them", "then", "there", "they", "this", "to", "too", "very", "was", "were", "what", "when", "which", "will", "with", "would", "you", "your"]
SUBJECT_WORDS = ["i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves"]


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


@F.pandas_udf(T.StringType())
def unescape_nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references decoded, then compatibility-composed; the JVM has no such function."""
    import html
    import unicodedata

    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


def mask_url_email(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, URL, " <url> "), EMAIL, " <email> ")


def leading_subject(c: Column, subject: str = "the product") -> Column:
    return F.regexp_replace(c, LEADING_SUBJECT, subject + " ")


def replace_each(c: Column, pattern: str, name) -> Column:
    """``c`` with ``name(match)`` in place of every match. Split keeps what lies between the matches, so one array pass does it."""
    between = F.split(c, pattern)
    found = F.regexp_extract_all(c, F.lit("(" + pattern + ")"), F.lit(1))
    return F.concat_ws("", F.flatten(F.zip_with(between, F.transform(found, name), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))


def number_words(c: Column) -> Column:
    """Number words as digits, whole words only, in one pass."""
    digits = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    pattern = r"(?iU)\b(?:" + "|".join(NUMBER_WORDS) + r")\b"
    return F.when(F.rlike(c, F.lit(pattern)), replace_each(c, pattern, lambda x: F.element_at(digits, F.lower(x)))).otherwise(c)


def number_bucket(c: Column) -> Column:
    """Numbers replaced by the name of their range; a number that can't be read is ``<num>``."""
    value = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    name = lambda x: F.when(value(x).isNull(), "<num>").when(value(x) <= 1, "<n1>").when(value(x) <= 2, "<n2>").when(value(x) <= 5, "<n3_5>").when(value(x) <= 10, "<n6_10>").otherwise("<n10p>")
    return replace_each(c, DIGITS, name)


def normalize_statement(c: Column, subject: str = "the product", numbers: str = "keep", min_chars: int = 8, min_tokens: int = 3, only_subject: bool = False, unescape: bool = True) -> Column:
    """Canonical surface form of a statement, or null if nothing worth keeping is left.

    The order of the steps matters: address placeholders lose their brackets to the punctuation rule, and
    commas and full stops go before numbers are read, so decimals fall apart.
    """
    squeeze = lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))
    s = strip(F.lower(unescape_nfkc(c) if unescape else c))
    s = F.regexp_replace(F.regexp_replace(mask_url_email(s), DASHES, " "), PUNCTUATION, " ")
    s = strip(leading_subject(F.translate(s, ",.", "  "), subject))
    s = number_words(s)
    if numbers == "bucket":
        s = number_bucket(s)
    elif numbers == "mask":
        s = F.regexp_replace(s, DIGITS, "<num>")
    s = strip(F.regexp_replace(squeeze(s), TRAILING_DOTS, ""))
    s = squeeze(F.regexp_replace(s, TRAILING_FILLER, ""))
    enough = (F.length(s) >= min_chars) & (F.size(F.split(s, " ")) >= min_tokens)
    return F.when(enough if only_subject else enough & (s != subject), s)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_truncate(c: Column, n: int) -> Column:
    """The text, or its first ``n`` words joined by spaces if it has more."""
    return let(words(c), lambda w: F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(c))


def k_shingles(c: Column, k: int) -> Column:
    """Distinct ``k``-word shingles in lower case; fewer words: none; ``k`` of 1 or less: the words."""
    if k <= 1:
        return F.array_distinct(words(F.lower(c)))

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (k - 1))
        return F.when(F.size(w) >= k, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " ")))).otherwise(F.array().cast("array<string>"))

    return let(words(F.lower(c)), cut)


def sentences(c: Column) -> Column:
    """Pieces between ``: , ? ! .`` and line ends, trimmed, none empty."""
    return F.filter(F.transform(F.split(c, r"[:,?!\n.]"), strip), lambda x: x != "")


def subject_count(c: Column) -> Column:
    """First-person words of a sentence."""
    return F.size(F.filter(words(F.lower(c)), lambda x: x.isin(SUBJECT_WORDS)))


def word_kinds(c: Column) -> Column:
    """The kind of each word: ``adj`` by list or ending, ``other`` for function and first-person words, else ``noun``.
    A plain stand-in for a tagger; verbs count as nouns."""
    bare = F.transform(words(F.lower(c)), lambda x: F.regexp_replace(x, r"[^a-z']", ""))
    kind = lambda x: F.when((x == "") | x.isin(FUNCTION_WORDS + SUBJECT_WORDS), "other").when(x.isin(ADJECTIVES) | F.rlike(x, F.lit(ADJECTIVE_ENDINGS)), "adj").otherwise("noun")
    return F.transform(bare, kind)


def sentence_counts(c: Column) -> list[Column]:
    """``word_num``, ``subj_num``, ``noun_num`` and ``adj_num`` of a sentence."""
    of = lambda k: F.size(F.filter(word_kinds(c), lambda x: x == k))
    return [F.size(words(F.lower(c))).alias("word_num"), subject_count(c).alias("subj_num"), of("noun").alias("noun_num"), of("adj").alias("adj_num")]


def good_sentence() -> Column:
    """Whether a row of :func:`sentence_counts` can be an explanation: two words, no first person, a noun and an adjective."""
    return (F.col("word_num") >= 2) & (F.col("subj_num") == 0) & (F.col("noun_num") >= 1) & (F.col("adj_num") >= 1)


def sentiment_code(c: Column) -> Column:
    """-1, 0 or 1 of a sentiment's name; null for others."""
    name = F.lower(strip(c))
    return F.when(name == "negative", -1).when(name == "neutral", 0).when(name == "positive", 1)


def sentiment_name(c: Column) -> Column:
    """The name of -1, 0 or 1; null for others."""
    return F.when(c == -1, "negative").when(c == 0, "neutral").when(c == 1, "positive")


def is_missing(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def pair_prompt(instruction: Column, a: Column, b: Column) -> Column:
    """The cross-encoder's input for a pair."""
    return F.concat(F.lit("<Instruct>: "), instruction, F.lit("\n<Query>: "), a, F.lit("\n<Document>: "), b)


def review_prompt(title: Column, review: Column, max_words: int = 128) -> Column:
    """The extraction model's user message."""
    return F.concat(F.lit("Title: "), title, F.lit(" - Review: "), word_truncate(review, max_words), F.lit("\nOutput:"))
