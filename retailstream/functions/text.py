"""Word matching for the keyword search."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = r"[^\p{L}\p{N}]+"
_IDEOGRAPH = r"([\p{IsHan}\p{IsHiragana}])"


def words(text: Column, split_ideographs: bool = True) -> Column:
    """Distinct lower-case words of a text, cut at anything but letters and digits.

    Chinese and Japanese are written without spaces, so by default each
    ideograph counts as a word of its own.
    """
    lowered = F.lower(text)
    if split_ideographs:
        lowered = F.regexp_replace(lowered, _IDEOGRAPH, " $1 ")
    return F.array_remove(F.array_distinct(F.split(lowered, _BREAK)), "")


def has_all_words(text: Column, keyword: str, split_ideographs: bool = True) -> Column:
    """True when every word of ``keyword`` occurs in ``text``; a keyword without
    any word, of punctuation only, occurs nowhere."""
    wanted = words(F.lit(keyword), split_ideographs)
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, words(text, split_ideographs))) == 0)
