"""An inverted index: which rows have a word, so that a search need not read texts.

A posting is a word of a row, signed: a row that comes again with other words takes
its old ones back. Per row and word the signs add up to one or nothing, so a row has
all of the wanted words when its signs over them add up to their number.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def postings(rows: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), split_ideographs: bool = True) -> DataFrame:
    """``(key, keep, word, sign)``: each distinct word of each row, with sign 1."""
    each = rows.select(key, *keep, F.explode(words(F.col(text), split_ideographs)).alias("word"))
    return each.withColumn("sign", F.lit(1).cast("bigint"))


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Postings to add so that ``old`` ones become ``new`` ones; equal ones cancel out."""
    columns = [c for c in new.columns if c != "sign"]
    both = new.unionByName(old.withColumn("sign", -F.col("sign")))
    return both.groupBy(*columns).agg(F.sum("sign").alias("sign")).filter("sign <> 0").select(*new.columns)


def wanted_words(frame: DataFrame, keyword: str, split_ideographs: bool = True) -> list[str]:
    """The distinct words of a keyword, which is one short text."""
    return frame.sparkSession.range(1).select(words(F.lit(keyword), split_ideographs).alias("w")).first().w


def having_all(index: DataFrame, wanted: list[str], key: str) -> DataFrame:
    """``(key)`` of the rows that have every wanted word; of no word at all, none."""
    if not wanted:
        return index.select(key).limit(0)
    found = index.filter(F.col("word").isin(wanted)).groupBy(key).agg(F.sum("sign").alias("_n"))
    return found.filter(F.col("_n") == len(wanted)).select(key)


def word_bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")
