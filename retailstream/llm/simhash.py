"""Near duplicates by SimHash: pigeonhole blocks, a join on blocks, Hamming distance.

Documents with the same fingerprint are one class from the start, so copies
never meet in pairs. The fingerprints are cut into blocks; two that differ in at
most `distance` bits agree in all but that many blocks, so each choice of the
other blocks is a table of keys, and close pairs share a key in one of them.

Where many fingerprints share a key, a family of near copies, pairs would grow
with the square of the family. There every fingerprint sends itself and its
one-bit neighbours instead: those that share a value lie within two bits of each
other, and any two within two bits share a value. So a star per value links just
what the pairs would link, with rows in proportion to the family.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import checkpointed, stored
from .components import components

SHINGLE = 3  # words
SEED = 42
DISTANCE = 2  # bits
BLOCKS = 4  # two of four blocks agree: keys of 32 bits in six tables
CROWDED = 64  # fingerprints of a key that still meet in pairs
BROADCAST_IDS = 100_000  # repeated ids, numbers alone; with more of them Spark joins its own way
_BITS = 64
_CHUNK = 1 << 16  # shingles whose bits are summed at once


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; 0 without words."""
    # Of bytes, lower() changes just A-Z and split() cuts at just the six characters.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(_BITS, dtype=np.int64)
    for first in range(0, n, _CHUNK):
        runs = zip(*(words[first + i : min(first + _CHUNK, n) + i] for i in range(shingle)), strict=True) if len(words) >= shingle else [words]
        hashes = np.array([digest(b" ".join(run), seed) for run in runs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in batch["t"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["k"], "bits": bits})

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, bits long")


def _bits(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each table the bits of its key, as a signed number."""
    edges = [i * _BITS // blocks for i in range(blocks + 1)]
    spans = [((1 << high) - 1) & ~((1 << low) - 1) for low, high in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(spans, blocks - distance)]
    return [m - (1 << _BITS) if m >> (_BITS - 1) else m for m in masks]


def close_links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(bits) -> (a, b): links that connect all fingerprints within `distance` bits.

    Both kinds of links hold between close fingerprints only, and every close pair
    is connected by them.
    """
    if distance != 2:
        raise ValueError("crowded keys are resolved for a distance of two bits")
    masks = block_masks(blocks, distance)
    members = distinct.select("bits", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("t", "mask")).select(
        F.col("t"), F.col("bits").bitwiseAND(F.col("mask")).alias("key"), "bits", "mask",
    )
    shared = checkpointed(members.groupBy("t", "key").count().filter("count > 1"))
    members = members.join(shared, ["t", "key"])
    few = members.filter(F.col("count") <= crowded)
    pairs = few.alias("x").join(few.alias("y"), ["t", "key"]).filter("x.bits < y.bits").select(
        F.col("x.bits").alias("a"), F.col("y.bits").alias("b"),
    ).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return pairs.distinct().unionByName(_stars(members.filter(F.col("count") > crowded)))


def _stars(members: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded keys by their neighbours outside the key's bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(_BITS)])
    free = F.filter(flips, lambda f: f.bitwiseAND(F.col("mask")) == 0)
    near = members.select("bits", "t", F.explode(F.transform(free, lambda f: F.col("bits").bitwiseXOR(f))).alias("value"))
    star = near.groupBy("t", "value").agg(F.min("bits").alias("a"), F.max("bits").alias("z")).filter("a < z")
    return near.join(star, ["t", "value"]).filter("bits > a").select("a", F.col("bits").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document.

    component_id is the smallest id that a document reaches over links, its own
    included. NULL and empty texts have fingerprint 0 and are linked like others.
    A NULL id takes no part in the choice of the smallest (NULL if a component has
    no other). Repeated rows stay rows; other columns are left out; an empty table
    gives an empty result.
    """
    marked = checkpointed(fingerprints(docs, key, text))
    return marked.join(_grouped(marked).drop("component"), "bits").select(
        "doc_id", as_hex("bits").alias("fingerprint"), "component_id",
    )


def _grouped(marked: DataFrame) -> DataFrame:
    """(doc_id, bits) -> one row per fingerprint: bits, component, component_id.

    `component` is the smallest fingerprint of the group, `component_id` its smallest id.
    """
    classes = checkpointed(marked.groupBy("bits").agg(F.min("doc_id").alias("first")))
    linked = components(close_links(classes.select("bits")))
    # A component is named by its smallest fingerprint; its smallest document is wanted.
    named = classes.join(linked.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "component", F.coalesce("component", "bits")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(smallest, "component").select("bits", "component", "component_id")


def as_hex(bits: str) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The documents, one of each component: that with the smallest id.

    Without `similarity` documents link by the distance of their fingerprints, as in
    `near_duplicates`; with it, if the Jaccard similarity of their sets of shingles
    is at least that (`similar.grouped`). Of rows that repeat this id in the
    component one stays, always the same. A component without any id keeps one of
    its rows too.
    """
    if similarity is None:
        marked = checkpointed(fingerprints(docs, key, text, shingle))
        groups = checkpointed(_grouped(marked))
        classes = _bits(F.col("text"), shingle)
    else:
        marked, groups = similar.grouped(docs, key, text, shingle, similarity)
        classes = similar.set_numbers(F.col("text"), shingle)
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = marked.join(groups, "bits").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(is_first).alias("stays"))
    ids = checkpointed(ids.filter("stays").drop("stays"))
    repeated = ids.filter("n > 1")
    many = repeated.limit(BROADCAST_IDS + 1).count()

    def rows_of(chosen: DataFrame, few: bool = False) -> DataFrame:
        chosen = chosen.select(F.col("doc_id").alias("_id"))
        same = F.col(f"d.`{key}`").cast("long").eqNullSafe(chosen["_id"])
        return docs.alias("d").join(F.broadcast(chosen) if few else chosen, same, "left_semi")

    # An id tells its row unless it is repeated; only such rows are looked at again.
    once = rows_of(ids.filter("n = 1"))
    if not many:
        return once
    again = stored(rows_of(repeated, many <= BROADCAST_IDS).select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
    ))
    one = again.withColumn("bits", classes).join(groups, "bits").filter(is_first).groupBy("component").agg(
        F.min_by("doc", F.sha2(F.to_json("doc"), 256)).alias("doc")
    )
    return once.unionByName(one.select("doc.*"))
