"""Mixing sources to target weights by Pareto order sampling.

Columns and SQL functions only. Every document of a source is due the same
number of copies, the target of the source over its size: the whole part is
certain, and the fraction is the inclusion probability of one more copy. The
documents of a source are ranked by their random odds over their inclusion odds,
and the first of them are taken up to the size that is still due.

The size of a sample is fixed in words, not in documents: a few documents are
thousands of times longer than most, so a number of documents says little.

A source may hold a third of all documents, so no task ever sorts a whole
source: the ranks are cut into equal bins first, bins are summed, running sums
over bins find the bin in which a source is full, and only that bin is sorted.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources by code point, NULL last, repeating
LIMIT = 3.0  # a source is taken at most so many times
BIN_ROWS = 500  # documents in a bin of ranks, about
BROADCAST_SOURCES = 50_000  # with more sources than that, Spark joins them its own way
_HEX, _UNIT = 13, 16.0**13  # digits of a digest used for a random number


def word_count(text: str) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_unit(key: str, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")).cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") + 0.5) / _UNIT


def targets(sizes: DataFrame, weights=WEIGHTS, limit: float = LIMIT, share: float = 1.0) -> DataFrame:
    """(source, source_size, documents) -> these and `target`.

    One row per source. Sources share `share` of all sizes by weight; what
    exceeds `limit` times a source's size goes to the others by weight. Sorted by
    limit over weight, the sources that stop at their limit come first, so running
    sums find the level at which all of it is given out.
    """
    period = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    filling = Window.orderBy(F.col("_stop") / F.col("_weight"), "_turn")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opened = F.col("_level") * F.col("_weight") < F.col("_stop")
    filled = (
        sizes.withColumn("_turn", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(period, ((F.col("_turn") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_stop", F.col("source_size") * F.lit(float(limit)))
        .withColumn("_due", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_due") - F.coalesce(F.sum("_stop").over(before), F.lit(0.0))) / F.sum("_weight").over(after))
        # The first source that its level doesn't fill sets the level of all that follow.
        .withColumn("_level", F.first(F.when(opened, F.col("_level")), ignorenulls=True).over(everything))
    )
    return filled.select(
        "source", "source_size", "documents",
        F.least("_stop", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_stop"))).alias("target"),
    )


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, unit): what the sampling needs of a document."""
    return docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"),
        word_count(text).alias("size"), random_unit(key, seed).alias("unit"),
    )


def allotments(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Rows of `sized` -> one row per source: source_size, target, `whole` copies of
    each document, `part`, the inclusion probability of one copy more, and `last`,
    the rank of the last document that gets it (NULL: none does).
    """
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = checkpointed(
        targets(per_source, weights, limit)
        .withColumn("whole", F.floor(due))
        .withColumn("part", due - F.col("whole"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("bins", F.ceil(F.col("documents") / bin_rows))
    )
    placed = with_source(docs, per_source).filter("part > 0").withColumn("bin", F.floor(F.col("unit") * F.col("bins")))
    # Ranks rise with the unit, so bins of units are bins of ranks.
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")).withColumn(
        "before", F.coalesce(F.sum("bin_size").over(running), F.lit(0))
    )
    rows = placed.alias("d").join(
        sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bin") == F.col("s.bin")),
    ).filter("s.before < d.rest").select("d.*", "s.before")
    inside = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    taken = rows.withColumn("rank", rank()).withColumn(
        "middle", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    ).filter("middle <= rest")
    last = taken.groupBy("source").agg(F.max("rank").alias("last"))
    return per_source.alias("p").join(
        last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left"
    ).select("p.source", "source_size", "target", "whole", "part", "last")


def rank() -> Column:
    """Random odds over inclusion odds of a document's next copy; NULL if it has none."""
    return F.when(F.col("part") > 0, (F.col("unit") / (1 - F.col("unit"))) / (F.col("part") / (1 - F.col("part"))))


def with_source(docs: DataFrame, per_source: DataFrame, source: str = "source") -> DataFrame:
    """Documents with the columns of their source, which are few by a count."""
    few = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = per_source.withColumnRenamed("source", "_of")
    joined = docs.join(F.broadcast(right) if few else right, docs[source].eqNullSafe(right["_of"]))
    return joined.drop("_of")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, limit: float = LIMIT, seed: str = "mix",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row per document.

    `copies` whole copies of a document are taken, at most `limit` (rounded up),
    and `taken` words with them. A source's taken words differ from its target by
    at most half of one document. NULL text has size 0; a NULL source is a source
    of its own, the last. Documents of size 0 and sources of size 0 are fine; the
    latter get no copies. Rows that repeat a key stay together. Other columns are
    left out, so their names don't matter; an empty table gives an empty result.
    """
    rows = checkpointed(sized(docs, key, text, source, seed))
    return with_source(rows, checkpointed(allotments(rows, weights, limit))).withColumn("copies", copies()).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def copies() -> Column:
    more = F.coalesce(rank() <= F.col("last"), F.lit(False))
    return (F.col("whole") + more.cast("long")).cast("long")


def mixed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, limit: float = LIMIT, seed: str = "mix",
) -> DataFrame:
    """The documents themselves, each as often as `mix` takes it, columns as they were."""
    rows = checkpointed(sized(docs, key, text, source, seed))
    chosen = checkpointed(allotments(rows, weights, limit)).select("source", "whole", "part", "last")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source).alias("source"), random_unit(key, seed).alias("unit"))
    counted = with_source(packed, chosen).withColumn("copies", copies()).filter("copies > 0")
    return counted.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
