"""Tokenising and text cleaning expressions (ASCII classes spelled out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the caption tokeniser.
STOP_WORDS = (
    "a an and are as at based be best by correct does for from in is it of on option question "
    "select the this to video what which who with"
).split()

# Articles dropped before answers are compared.
ARTICLES = ["a", "an", "the", "and"]

# Fixed value: the ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Words without stop words and single characters."""
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def strip(text: Column) -> Column:
    """Outer blanks, tabs and line breaks removed."""
    return F.btrim(text, F.lit(" \t\n\r\f\u000b"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f\u000b]+", " "))


def _without_articles(text: Column) -> Column:
    """Lower case without punctuation (commas included) and articles; blanks not yet squeezed."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.regexp_replace(plain, rf"(?U)\b(?:{'|'.join(ARTICLES)})\b", " ")


def normalize_answer(text: Column) -> Column:
    """Answer form for token F1: no commas or punctuation, lower case, no articles."""
    return squeeze(_without_articles(text))


def answer_tokens(text: Column) -> Column:
    """Tokens of a normalised answer."""
    return F.regexp_extract_all(_without_articles(text), F.lit("[a-z0-9]+"), F.lit(0))


def stem(token: Column) -> Column:
    """Strip the first matching suffix of ing, ed, es, s when enough letters remain."""
    out = token
    for suffix in reversed(["ing", "ed", "es", "s"]):
        fits = token.endswith(suffix) & (F.length(token) > len(suffix) + 3)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def text_key(text: Column) -> Column:
    """Key under which a question text is looked up."""
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def clean_newlines(text: Column) -> Column:
    """Unix line ends, at most one blank line in a row, trimmed."""
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    return F.regexp_replace(strip(unix), "\n{3,}", "\n\n")


def letter_profile(text: Column) -> Column:
    """Offline stand-in for an embedding model: unit vector of letter counts a..z."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    counts = [
        (F.length(lowered) - F.length(F.replace(lowered, F.lit(chr(97 + i)), F.lit("")))).cast("double")
        for i in range(26)
    ]
    return F.array(*counts)
