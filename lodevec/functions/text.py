"""Text functions: tokens, n-grams, stop words, light stems, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKEN_BYTES = 2
# The words left out by the named filters.
STOP_WORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas por para com que se e ou mas ao aos pelo pela como mais sem sua seu".split(),
}


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of at least two bytes; null text gives null."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda t: F.octet_length(t) >= MIN_TOKEN_BYTES), lambda t: F.lower(t))


def joined_text(*columns: str) -> Column:
    """Several text columns with blanks between; nulls are skipped."""
    return F.concat_ws(" ", *columns)


def character_ngrams(text: Column | str, low: int = 1, high: int = 2) -> Column:
    """All character n-grams, lower case, by position and then length: for scripts without blanks."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    n = F.length(t)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    sizes = F.array(*[F.lit(i) for i in range(low, high + 1)])
    grams = F.flatten(F.transform(at, lambda i: F.transform(sizes, lambda s: F.when(i + s - 1 <= n, F.substring(t, i, s)))))
    return F.filter(grams, lambda g: g.isNotNull())


def without_stop_words(words: Column, lang: str = "en") -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS[lang]])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def light_stems(words: Column) -> Column:
    """English plural and -ing / -ed endings cut in the JVM: a light stemmer, no Snowball."""

    def stem(w: Column) -> Column:
        s = F.regexp_replace(w, "(ss|us|is)$", "$1\u0001")
        s = F.regexp_replace(s, "ies$", "y")
        s = F.regexp_replace(s, "(x|ch|sh|ss\u0001?)es$", "$1")
        s = F.regexp_replace(s, "([^s])s$", "$1")
        s = F.regexp_replace(s, "([a-z]{3,}?)(?:ing|ed)$", "$1")
        s = F.regexp_replace(s, "\u0001", "")
        return F.regexp_replace(s, "([bdfgmnprt])\\1$", "$1")

    return F.transform(words, stem)


def escape_xml(text: Column | str) -> Column:
    """& < > \" as entities."""
    c = F.col(text) if isinstance(text, str) else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def truncate_int(c: Column, width: int) -> Column:
    """The multiple of ``width`` at or below a number, also for negative ones."""
    return c - F.pmod(c, F.lit(width))


def truncate_text(c: Column, width: int) -> Column:
    """The first characters of a string."""
    return F.substring(c, 1, width)
