"""Cleaning, tokenising, labelling and readability as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode classes behind \s, \w and the separators between tokens.
WHITESPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
TOKEN = r"\p{L}\p{Nl}\p{No}_"

# Texts a delimited file may use for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Labels that count as class 1.
POSITIVE_LABELS = ("true", "mostly-true", "half-true")

# English stop words.
ENGLISH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at
    by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both
    each few more most other some such no nor not only own same so than too very s t can will just
    don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
    doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't
    needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# Stop words of the news domain.
DOMAIN_STOPWORDS = tuple(
    "breaking exclusive shocking amazing unbelievable must read share viral secret hidden truth".split()
)

STOPWORDS = tuple(sorted({*ENGLISH_STOPWORDS, *DOMAIN_STOPWORDS}))


def normalize_missing(value: Column) -> Column:
    """Null where the value is one of the missing-value tokens (case matters)."""
    return F.when(~value.isin(*MISSING_TOKENS), value)


def binarize_label(label: Column, positives: Sequence[str] = POSITIVE_LABELS) -> Column:
    """1 for a positive label (trimmed, any case), else 0; a null label is 0."""
    trimmed = F.regexp_replace(label, rf"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")
    return F.when(F.lower(trimmed).isin(*positives), 1).otherwise(0)


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, rf"http[^{WHITESPACE}]+|www[^{WHITESPACE}]+", "")


def remove_mentions(text: Column) -> Column:
    return F.regexp_replace(text, rf"[@#][{WORD}]+", "")


def remove_punct_digits(text: Column) -> Column:
    spaced = F.regexp_replace(text, rf"[^{WORD}{WHITESPACE}]", " ")
    return F.regexp_replace(spaced, r"\p{Nd}+", " ")


def _without_links(text: Column) -> Column:
    return remove_mentions(remove_urls(F.lower(text_or_empty(text))))


def raw_tokens(text: Column) -> Column:
    """Cleaned words of a text, any length.

    Punctuation, digits and whitespace all end up as separators, so one split replaces the two
    substitutions of :func:`remove_punct_digits` followed by a split.
    """
    return F.filter(F.split(_without_links(text), rf"[^{TOKEN}]+"), lambda t: F.length(t) > 0)


def clean_text(text: Column) -> Column:
    return F.array_join(raw_tokens(text), " ")


def tokens(text: Column, stopwords: Sequence[str] = STOPWORDS, min_length: int = 3) -> Column:
    """Cleaned words that are no stop words and have at least ``min_length`` characters."""
    words = F.split(_without_links(text), rf"[^{TOKEN}]+")
    if stopwords:
        return F.filter(words, lambda t: (F.length(t) >= min_length) & ~t.isin(*stopwords))
    return F.filter(words, lambda t: F.length(t) >= min_length)


def drop_stopwords(words: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Words that are not stop words; order and repeats stay."""
    return F.filter(words, lambda t: ~t.isin(*stopwords))


def readability(text: Column) -> dict[str, Column]:
    """Words per sentence, characters per word and share of distinct words; 0 where undefined."""
    body = text_or_empty(text)
    words = F.filter(F.split(body, rf"[{WHITESPACE}]+"), lambda w: F.length(w) > 0)
    sentences = F.filter(F.split(body, r"[.!?]+"), lambda s: s.rlike(rf"[^{WHITESPACE}]"))
    n_words = F.size(words).cast("double")
    n_sentences = F.size(sentences).cast("double")
    n_letters = F.length(F.regexp_replace(body, rf"[{WHITESPACE}]+", "")).cast("double")
    n_distinct = F.size(F.array_distinct(words)).cast("double")
    defined = (n_words > 0) & (n_sentences > 0)
    zero = F.lit(0.0)
    return {
        "avg_sentence_length": F.when(defined, F.try_divide(n_words, n_sentences)).otherwise(zero),
        "avg_word_length": F.when(defined, F.try_divide(n_letters, n_words)).otherwise(zero),
        "unique_word_ratio": F.when(defined, F.try_divide(n_distinct, n_words)).otherwise(zero),
    }
