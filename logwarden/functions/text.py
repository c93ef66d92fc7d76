"""Tokenisers and n-grams as JVM expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters that are not decimal digits / word characters.
ALPHABETIC_RUN = r"[\p{L}\p{Nl}\p{No}_]+"
WORD_RUN = r"[\p{L}\p{N}_]{2,}"
# Every character Python's str.isspace() accepts.
WHITESPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def not_blank(text: Column) -> Column:
    return text.rlike(f"[^{WHITESPACE}]")


def simple_tokens(text: Column | str, shortest: int = 2, longest: int = 15) -> Column:
    """Lower-cased runs of word characters without decimal digits, by length."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(ALPHABETIC_RUN), F.lit(0))
    return F.filter(
        runs, lambda t: F.length(t).between(shortest, longest) & ~F.startswith(t, F.lit("_"))
    )


def word_tokens(text: Column | str) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))


def unigrams_and_bigrams(tokens: str) -> Column:
    """The tokens of a column, then every adjacent pair joined by one space.

    Takes a column name: the tokens are used three times and must be a computed
    column by then, not an expression that would be evaluated three times.
    """
    t = F.col(tokens)
    rest = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    # the shorter side ends in a null pair, which is dropped
    bigrams = F.array_compact(F.zip_with(t, rest, lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(t, bigrams)


def char_ngrams(token: Column | str, shortest: int = 3, longest: int = 6) -> Column:
    """Character n-grams of ``<token>``, shortest first, left to right."""
    token = F.col(token) if isinstance(token, str) else token
    word = F.concat(F.lit("<"), token, F.lit(">"))
    lengths = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(word)))
    grams = F.flatten(
        F.transform(
            lengths,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length(word) - n + 1),
                lambda start: F.substring(word, start, n),
            ),
        )
    )
    return F.when(F.length(word) >= shortest, grams).otherwise(F.array().cast("array<string>"))


def preview(text: Column | str, width: int = 50) -> Column:
    """First ``width`` characters, followed by ``...`` when there are more."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)
