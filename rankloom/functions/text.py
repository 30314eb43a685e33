"""Column functions over text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.stopwords import ENGLISH_STOP_WORDS

# The characters Python's str.split() treats as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Word tokens of two or more letters, digits or underscores, for any script.
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def bind(value: Column, body) -> Column:
    """`body` applied to a value that is computed once, however often `body` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens; punctuation stays attached, NULL text has no tokens.

    Mapping every space to a blank first lets the split use a plain character, not a regex.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(F.translate(lowered, SPACES, " " * len(SPACES)), " "), "")


def compress_score(value: Column) -> Column:
    """sign(x) * ln(1 + |x|)."""
    return F.signum(value) * F.log1p(F.abs(value))


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.greatest(denominator.cast("double"), F.lit(1.0))


def sigmoid(margin: Column) -> Column:
    clipped = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), margin))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def content_words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Word tokens of a text in order, stop words dropped."""
    stop_words = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(lowered, F.lit(WORD_TOKEN), F.lit(0))
    if not stop_words:
        return words
    return F.filter(words, lambda word: ~word.isin(stop_words))


def unigrams_and_bigrams(words: Column) -> Column:
    """Single words followed by pairs of neighbours, repeats kept."""
    def grams(w: Column) -> Column:
        followers = F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))
        pairs = F.zip_with(w, followers, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(w, F.array_compact(pairs))

    return bind(words, grams)


def preview(text: Column, length: int = 220, strip: bool = True) -> Column:
    """One-line snippet: newlines become spaces, ends are stripped, first `length` characters."""
    line = F.regexp_replace(text, "\n", " ")
    if strip:
        line = F.btrim(line, F.lit(SPACES))
    return F.substring(line, 1, length)


def shingles(words: Column, width: int) -> Column:
    """Every run of `width` neighbouring tokens joined by single blanks."""
    def runs(w: Column) -> Column:
        starts = F.when(
            F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - F.lit(width - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(width)), " "))

    return bind(words, runs)
