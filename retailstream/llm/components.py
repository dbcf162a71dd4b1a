"""Connected components of links, as joins and aggregates."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_tasks

MAX_ROUNDS = 60  # far beyond what is needed: the rounds grow with the logarithm of a chain


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) -> (node, component): the smallest node that each linked node reaches.

    Alternates between two steps until nothing changes: every node tells its
    larger neighbours, then its smaller ones, of the smallest that it knows. All
    are joins with a minimum per node, so a node with very many links is summed
    before it is shuffled and its links are split by Spark. Links to itself and
    repeated links do no harm; NULL nodes are left out; no links give no rows. With
    `rows` each task has about so many links, however many shuffle partitions there are;
    links that fit in one task are joined by broadcasts and not shuffled at all.
    """
    edges = checkpointed(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    tasks = None if rows is None else edges.count() // rows + 1

    def few(frame: DataFrame) -> DataFrame:
        return frame if tasks is None else in_tasks(frame, tasks)

    edges, state = few(edges), None
    for _ in range(MAX_ROUNDS):
        edges = few(checkpointed(_small_star(_large_star(edges, few), few)))
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("the links did not settle")
    # Each node now has one link, to the smallest.
    return few(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    ))


def _large_star(edges: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Link a node's larger neighbours to the smallest of its neighbours and itself."""
    both = few(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    smallest = both.groupBy("a").agg(F.min("b").alias("m"))
    found = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    return few(found.filter("a <> b").distinct())


def _small_star(edges: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; a > b in every link."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    found = few(edges.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        smallest.select("a", F.col("m").alias("b"))
    ))
    return few(found.filter("a <> b").distinct())
