"""Tokenisers, text statistics and readability as column expressions.

Everything here is row-local: no operator in this module shuffles. Expressions
used more than once are added as columns first, so that Catalyst evaluates the
regular expressions once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token, sentence, URL and address patterns.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
# On cleaned text every other character is a blank or one of the kept marks.
CLEAN_TOKEN = r"[^ .!?,;:()\-]+|[^ ]"
CLEAN_WORD = r"[^ .!?,;:()\-]+"
TERM = r"[\p{L}\p{N}_]{2,}"
SENTENCE_BREAK = r"[.!?]+"
URL = r"https?://[!$-_a-z]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
NOT_KEPT = r"[^a-zA-Z0-9_\s.!?,;:\-()\p{L}\p{N}]"
BLANK_RUN = r"[\t\n\x0B\f\r]\s*| \s+"
BLANKS = " \t\r\n\f\u000b\u00a0"


def strip(col: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(col, F.lit(BLANKS))


def clean_text(col: Column, order: str = "urls_first") -> Column:
    """T1. `urls_first` removes addresses while their marks still exist;
    `reference` replaces special characters first, so addresses survive in pieces."""

    def without_addresses(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, URL, ""), EMAIL, "")

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(c, BLANK_RUN, " "), NOT_KEPT, " ")

    if order == "urls_first":
        has_address = F.contains(col, F.lit("://")) | F.contains(col, F.lit("@"))
        return F.trim(plain(F.when(has_address, without_addresses(col)).otherwise(col)))
    if order == "reference":
        return F.trim(without_addresses(plain(col)))
    raise ValueError(f"unknown cleaning order: {order}")


def tokens(col: Column) -> Column:
    """Lower-cased word and punctuation tokens."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


def clean_tokens(clean: Column) -> Column:
    """T2 over already cleaned text: the same tokens by a cheaper pattern."""
    return F.regexp_extract_all(F.lower(clean), F.lit(CLEAN_TOKEN), F.lit(0))


def alpha_words(clean: Column) -> Column:
    """The tokens of cleaned text made of letters only."""
    words = F.regexp_extract_all(F.lower(clean), F.lit(CLEAN_WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.rlike(r"[\p{N}_]"))


def sentences(col: Column) -> Column:
    """Split at sentence marks, trimmed, blanks dropped."""
    parts = F.transform(F.split(col, SENTENCE_BREAK, -1), strip)
    return F.filter(parts, lambda s: s != "")


def blank_words(col: Column) -> Column:
    """Words by whitespace, as in T7, T12 and T15."""
    return F.filter(F.split(col, r"[\s\u00a0]+", -1), lambda w: w != "")


def blank_word_count(col: Column) -> Column:
    """Number of whitespace-separated words, without building the array."""
    return F.regexp_count(col, F.lit(r"[^\s\u00a0]+")).cast("bigint")


def content_words(words: Column, stop_words: Sequence[str], min_length: int = 1) -> Column:
    """T4: drop stop words (a hash-set test) and words under `min_length`."""
    if min_length > 1:
        return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*stop_words))
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def ngram_terms(col: Column, stop_words: Sequence[str]) -> Column:
    """T5 step 1: terms of two or more characters without stop words."""
    found = F.regexp_extract_all(F.lower(col), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words))


def with_bigrams(words: Column) -> Column:
    """T5 step 2: the words followed by each adjacent pair. `words` must be a plain column."""
    pairs = F.transform(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.concat_ws(" ", F.get(words, i), w),
    )
    return F.concat(words, pairs)


def bigrams_of(words: Column) -> Column:
    """Same as `with_bigrams` for use inside a lambda, where `words` is a lambda variable."""
    return with_bigrams(words)


def syllable_total(words: Column) -> Column:
    """T8 summed over an array of lower-case letter words.

    Vowel runs, less one for each silent final e of a word with several runs,
    plus one for each word without a vowel. Counting on the joined string
    keeps this to three native scans instead of a lambda per word.
    """
    joined = F.array_join(words, " ")
    runs = F.regexp_count(joined, F.lit(r"[aeiouy]+"))
    silent = F.regexp_count(joined, F.lit(r"[aeiouy][^aeiouy ]+[aeiouy]*e(?= |$)"))
    mute = F.regexp_count(joined, F.lit(r"(?<![^ ])[^aeiouy ]+(?= |$)"))
    return (runs - silent + mute).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """Double division with 0 for an empty denominator."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def rounded(col: Column, places: int) -> Column:
    """Half-up rounding by plain double arithmetic, so that any engine gives the same value."""
    scale = F.lit(10.0**places)
    return F.floor(col.cast("double") * scale + F.lit(0.5)).cast("double") / scale


def add_statistics(df: DataFrame, text: str, stop_words: Sequence[str], title: str | None = None) -> DataFrame:
    """Statistics of the cleaned text; paragraphs are counted on the raw text,
    with the parity count (always one after cleaning) beside it."""
    out = (
        df.withColumn("clean", clean_text(F.col(text)))
        .withColumn("tokens", clean_tokens(F.col("clean")))
        .withColumn("content_tokens", content_words(alpha_words(F.col("clean")), stop_words))
    )
    n_words = F.size("tokens").cast("bigint")
    n_sent = F.size(sentences(F.col("clean"))).cast("bigint")
    n_content = F.size("content_tokens").cast("bigint")
    uniq = F.size(F.array_distinct("content_tokens")).cast("bigint")
    out = out.withColumns(
        {
            "char_count": F.length("clean").cast("bigint"),
            "word_count": n_words,
            "sentence_count": n_sent,
            "paragraph_count": F.size(F.split(F.col(text), "\n\n", -1)).cast("bigint"),
            "paragraph_count_parity": F.size(F.split(F.col("clean"), "\n\n", -1)).cast("bigint"),
            "token_chars": F.length(F.regexp_replace("clean", r"\s+", "")).cast("bigint"),
            "content_word_count": n_content,
            "unique_words": uniq,
        }
    ).withColumns(
        {
            "avg_words_per_sentence": ratio(F.col("word_count"), F.col("sentence_count")),
            "avg_chars_per_word": ratio(F.col("token_chars"), F.col("word_count")),
            "lexical_diversity": ratio(F.col("unique_words"), F.col("content_word_count")),
        }
    )
    if title:
        out = out.withColumns(
            {
                "title_length": F.length(title).cast("bigint"),
                "title_word_count": blank_word_count(F.col(title)),
            }
        )
    return out.drop("clean", "tokens", "content_tokens", "token_chars")


# Lower bounds of the reading bands.
READING_BANDS = (
    (90, "Very Easy"),
    (80, "Easy"),
    (70, "Fairly Easy"),
    (60, "Standard"),
    (50, "Fairly Difficult"),
    (30, "Difficult"),
)


def reading_level(score: Column) -> Column:
    """Seven-band reading level of a Flesch score."""
    level = F.lit(None).cast("string")
    for bound, name in reversed(READING_BANDS):
        level = F.when(score >= bound, name).otherwise(
            level if name != READING_BANDS[-1][1] else F.lit("Very Difficult")
        )
    return F.when(score.isNotNull(), level)


def add_readability(df: DataFrame, text: str) -> DataFrame:
    """Flesch ease and grade over the cleaned text; null where it has no words or sentences."""
    out = df.withColumn("clean", clean_text(F.col(text)))
    out = out.withColumns(
        {
            "words": F.regexp_count("clean", F.lit(CLEAN_TOKEN)).cast("double"),
            "sents": F.size(sentences(F.col("clean"))).cast("double"),
            "syllables": syllable_total(alpha_words(F.col("clean"))),
        }
    )
    usable = (F.col("words") > 0) & (F.col("sents") > 0)
    out = out.withColumns(
        {
            "avg_sentence_length": F.when(usable, F.col("words") / F.col("sents")),
            "avg_syllables_per_word": F.when(usable, F.col("syllables").cast("double") / F.col("words")),
        }
    ).withColumns(
        {
            "flesch_reading_ease": F.lit(206.835)
            - (F.lit(1.015) * F.col("avg_sentence_length"))
            - (F.lit(84.6) * F.col("avg_syllables_per_word")),
            "flesch_kincaid_grade": (F.lit(0.39) * F.col("avg_sentence_length"))
            + (F.lit(11.8) * F.col("avg_syllables_per_word"))
            - F.lit(15.59),
        }
    )
    return out.withColumn("reading_level", reading_level(F.col("flesch_reading_ease"))).drop("clean", "words", "sents")


def add_display_statistics(df: DataFrame, text: str) -> DataFrame:
    """The display variant over the raw text, readability clamped to 0..100."""
    t = F.col(text)
    out = df.withColumns(
        {
            "word_count": blank_word_count(t),
            "sentence_count": F.size(sentences(t)).cast("bigint"),
            "character_count": F.length(t).cast("bigint"),
            "word_chars": F.length(F.regexp_replace(t, r"[\s\u00a0]+", "")).cast("bigint"),
            "unique_words": F.size(F.array_distinct(blank_alpha_words(t))).cast("bigint"),
        }
    )
    sents = F.greatest(F.col("sentence_count"), F.lit(1)).cast("double")
    words = F.greatest(F.col("word_count"), F.lit(1)).cast("double")
    out = out.withColumns(
        {
            "avg_words_per_sentence": F.col("word_count").cast("double") / sents,
            "avg_word_length": F.col("word_chars").cast("double") / words,
            "lexical_diversity": F.col("unique_words").cast("double") / words,
        }
    )
    raw = (
        F.lit(206.835)
        - (F.lit(1.015) * F.col("avg_words_per_sentence"))
        - (F.lit(84.6) * F.col("avg_word_length") / F.lit(2.0))
    )
    return out.withColumn("readability_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).drop("word_chars")


def blank_alpha_words(col: Column) -> Column:
    """Lower-cased whitespace words made of letters only."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"(?<![^\s\u00a0])\p{L}+(?![^\s\u00a0])"), F.lit(0))
