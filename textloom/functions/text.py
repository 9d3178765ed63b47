"""Column expressions on words and texts. Space is Unicode space throughout."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

SPACES = r"(?U)\s+"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_NAMED = r"^([+-]?(?i:inf|infinity)|(?i:nan))\z"
_HEX = r"^[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+\z"
_LOWER_START = r"(?U)(^|[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|\s)\p{Ll}"


def sanitize(text: Column) -> Column:
    """Curly quotes, and the entity of one, made straight. A text without them is not
    translated, which would look up each of its characters."""
    curly = text.contains("“") | text.contains("”") | text.contains("‘") | text.contains("’")
    straight = F.when(curly, F.translate(text, "“”‘’", "\"\"''")).otherwise(text)
    return F.replace(straight, F.lit("&rsquo;"), F.lit("'"))


def space_split(text: Column) -> Column:
    """Runs of non-space, in order."""
    return F.filter(F.split(text, SPACES), lambda s: s != "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def is_numeric(word: Column) -> Column:
    """Whether the word is a finite decimal, a hexadecimal float, or names inf or nan."""
    finite = word.rlike(_DECIMAL) & F.coalesce(F.abs(word.try_cast("double")) < F.lit(float("inf")), F.lit(False))
    return finite | word.rlike(_NAMED) | word.rlike(_HEX)


def shape(word: Column) -> Column:
    lower = F.lower(word)
    return (
        F.when(is_numeric(word), "number")
        .when(word.rlike(r"[^A-Za-z0-9_]\z"), "punct")
        .when(lower == word, "downcase")
        .when(~word.rlike(_LOWER_START), "upcase")
        .when(word != "", "mixedcase")
        .otherwise("other")
    )


def normalize(word: Column) -> Column:
    """A word's class in tagging features: hyphenated, year, digits, or lower-case."""
    return (
        F.when(word.contains("-") & ~word.startswith("-"), "!HYPHEN")
        .when(word.rlike(r"^[+-]?[0-9]+\z") & (F.octet_length(word) == 4), "!YEAR")
        .when(word.rlike(r"^[0-9]"), "!DIGITS")
        .otherwise(F.lower(word))
    )


def prefix(word: Column, n: int = 3) -> Column:
    return F.lower(F.left(word, F.lit(n)))


def suffix(word: Column, n: int = 3) -> Column:
    return F.lower(F.right(word, F.lit(n)))


def simple_tag(label: Column) -> Column:
    """v for verb tags, else what stands before the first hyphen."""
    return F.when(label.startswith("V"), "v").otherwise(F.substring_index(label, "-", 1))


def is_special(token: Column, emoticons: Iterable[str] = C.EMOTICONS, pattern: str = C.SPECIAL) -> Column:
    """Whether a token is never split."""
    return token.isin(list(emoticons)) | token.rlike(pattern)


def ends_sentence(token: Column) -> Column:
    ends = token.rlike("(?:" + "|".join(re.escape(x) for x in C.ENDERS) + r")\z") & ~token.contains(C.NEVER_END)
    inside = F.lit(False)
    for x in C.INNER_ENDERS:
        inside = inside | token.contains(x)
    return ends | inside


def non_space_length(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"(?U)\s", ""))


def adjusted_position(text: Column, at: Column) -> Column:
    """A character offset as an offset in the text without its spaces."""
    return non_space_length(F.left(text, at))


def log2_sum_exp(values: Column) -> Column:
    """log2 of the sum of powers of two of an array, stable; -inf when all are."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.pow(F.lit(2.0), v - top))
    return F.when(top == float("-inf"), top).otherwise(top + F.log2(total))
