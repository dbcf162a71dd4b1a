"""Near copies by the Jaccard similarity of their shingles, retrieved by SimHash.

Documents with the same set of shingles are one class from the start. Of every set
a SimHash of 1024 bits is taken: two sets of similarity s differ in a share
acos(2s / (1 + s)) / pi of them, about 0.15 at 0.8. Some of the bits are kept for a
first test of distance; keys are drawn from the others. The keys get longer with the
number of classes, so that a key holds few unrelated ones, and as many are taken as
find all but LOSS of the pairs at the bound; closer pairs are missed far more rarely.

First every class meets one other in each of its keys made longer, where those that
meet are related. So families of near copies grow together in linear space. Then
classes that are not together yet meet in the keys. What meets is measured by all
bits; pairs far closer than the bound are links, and those around it are verified on
the sets themselves, few pairs of a class at a time. What is narrow and small is read
in few tasks: a shuffle leaves files per task, and there are many rounds.

The texts of a family that stay outside are near many and similar to none, so their
pairs would grow with the square of the family. Beside the SimHash each set therefore
has parities: bit i tells if the number of its hashes that end in i is odd. A hash that
only one of two sets holds changes one bit, so parities never differ in more bits than
sets in hashes, and a pair that differs in too many bits is left out without loss.
"""

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, gathered, stored
from .components import components

SHINGLE = 5  # words
SIMILARITY = 0.8
LOSS = 0.002  # of pairs at the bound that no key finds
SEED = 42
MEMBERS = 256  # unrelated classes in a key at most, on average
LEAST_BITS = 10  # of a key
EXTRA = 14  # further bits of a key of stars
SMALL = 32  # classes of a long key that all meet
HUBS = 4  # of a long key with more
CROWDED = 1024  # classes of a key that meet without a look at what is together
FEW = 4  # pairs per class that are verified at once at first; then 64 times as many, and so on
LINKS = 200_000  # links in a task
MANY = 64  # shingles, from which on very close pairs need no look at the sets
_WORDS = 16  # of 64 bits each; the first two are for the test of distance
_TEST = 2
_ODD = 4  # words of folded parities
_ODDS = [f"o{i}" for i in range(_ODD)]
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, (2, _WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of hashes of runs of words, sorted; of all words if they are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((digest(b" ".join(run), SEED) for run in runs), dtype=np.uint64))


def set_number(found: np.ndarray) -> int:
    """A signed 64-bit number that tells the set."""
    n = xxhash.xxh64_intdigest(found.tobytes(), SEED + 1)
    return n - (1 << 64) if n >> 63 else n


def wide_fingerprint(found: np.ndarray) -> bytes:
    """A bit is set if it is set in over half of the mixed hashes."""
    counts = np.zeros(64 * _WORDS, dtype=np.int64)
    for first in range(0, len(found), 255):
        mixed = found[first : first + 255, None] * _MIX[0]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").tobytes()


def parities(found: np.ndarray) -> bytes:
    """A bit is set if an odd number of the hashes ends in its number."""
    counts = np.bincount((found & np.uint64(64 * _WORDS - 1)).astype(np.int64), minlength=64 * _WORDS)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def set_numbers(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([set_number(shingles(t, shingle)) for t in texts], dtype="int64")

    return run(text)


def _share(similarity: float) -> float:
    """Of the bits in which sets of a similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def key_shape(classes: int, similarity: float, loss: float = LOSS) -> tuple[int, int]:
    """(bits of a key, number of keys)."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, classes) / MEMBERS)))
    agree = (1 - _share(similarity)) ** bits
    return bits, max(1, math.ceil(math.log(loss) / math.log1p(-agree))) if agree < 1 else 1


def _beyond(similarity: float, words: int, deviations: float) -> float:
    """The bits of so many words in which sets of a similarity differ, and deviations from that."""
    n, p = 64 * words, _share(similarity)
    return n * p + deviations * math.sqrt(n * p * (1 - p))


def radius(similarity: float) -> int:
    """Test bits that may differ: five standard deviations beyond the mean at the bound."""
    return math.ceil(_beyond(similarity, _TEST, 5))


def reach(similarity: float) -> int:
    """Of all bits, likewise: three and a half, which lose one pair at the bound of 4,000."""
    return math.ceil(_beyond(similarity, _WORDS, 3.5))


def surely(similarity: float) -> int:
    """Five below the mean: of 3 million pairs at the bound one is as close, and of less similar ones fewer."""
    return math.floor(_beyond(similarity, _WORDS, -5))


def unlike(similarity: float) -> float:
    """Of the sizes of two sets together, the share that sets of a similarity hold alone."""
    return (1 - similarity) / (1 + similarity) + 1e-9


def _keyed(classes: DataFrame, similarity: float, extra: int) -> DataFrame:
    """(bits, size, x, y, o0, o1, ..., keys), written once: the size, test bits and folded parities
    of each class and its keys, each with `extra` further bits behind it that make it the key of a star."""
    bits, tables = key_shape(classes.count(), similarity)
    draw = np.random.default_rng(SEED)
    chosen = np.array([draw.choice(np.arange(64 * _TEST, 64 * _WORDS), bits + extra, replace=False) for _ in range(tables)])
    powers = np.int64(1) << np.arange(bits + extra, dtype=np.int64)[::-1]
    tags = np.arange(tables, dtype=np.int64) << (bits + extra)

    def run(batches):
        for batch in batches:
            if batch.empty:
                continue
            raw = np.frombuffer(b"".join(batch["code"]), dtype=np.uint8).reshape(len(batch), -1)
            flat = np.unpackbits(raw[:, : 8 * _WORDS], axis=1, bitorder="little")
            keys = np.stack([flat[:, c].astype(np.int64) @ powers for c in chosen], axis=1) + tags
            tests = np.ascontiguousarray(raw[:, : 8 * _TEST]).view("<i8")
            # Bits whose numbers agree in their ends fall together, and parities add up.
            odd = np.bitwise_xor.reduce(np.ascontiguousarray(raw[:, 8 * _WORDS :]).view("<i8").reshape(len(batch), -1, _ODD), axis=1)
            yield pd.DataFrame({
                "bits": batch["bits"], "size": batch["n"], "x": tests[:, 0], "y": tests[:, 1],
                **{c: odd[:, i] for i, c in enumerate(_ODDS)}, "keys": list(keys),
            })

    schema = f"bits long, size long, x long, y long, {', '.join(f'{c} long' for c in _ODDS)}, keys array<long>"
    return stored(classes.select("bits", "n", "code").mapInPandas(run, schema))


def _differing(a: str, b: str, columns: list[str]) -> Column:
    return sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in columns)


def _near(a: str, b: str, most: int, similarity: float) -> Column:
    """By the test bits, and by what sizes and parities leave possible."""
    p, q = F.col(f"{a}.size"), F.col(f"{b}.size")
    possible = (F.least(p, q) >= similarity * F.greatest(p, q)) & (_differing(a, b, _ODDS) <= unlike(similarity) * (p + q))
    return (_differing(a, b, ["x", "y"]) <= most) & possible


def _pair(l: Column, r: Column) -> list[Column]:
    return [F.least(l, r).alias("a"), F.greatest(l, r).alias("b")]


def _stars(keyed: DataFrame) -> DataFrame:
    """(a, b): pairs of long keys, which are related: all pairs of a key of a few classes, and
    each class with HUBS others, always the same ones, of a key of many."""
    members = keyed.select("bits", F.explode("keys").alias("star")).repartition("star")
    counts = members.groupBy("star").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    together = members.join(counts, "star")
    few = together.filter(F.col("n") <= SMALL)
    pairs = few.alias("l").join(few.alias("r"), "star").filter("l.bits < r.bits").select(F.col("l.bits").alias("a"), F.col("r.bits").alias("b"))
    # By hashes, so that a family has few hubs, the same ones in many keys.
    many = together.filter(F.col("n") > SMALL)
    least = [F.min_by("bits", F.xxhash64("bits", F.lit(i))) for i in range(HUBS)]
    hubs = many.groupBy("star").agg(F.array_distinct(F.array(*least)).alias("hubs")).select("star", F.explode("hubs").alias("hub"))
    near = many.join(hubs, "star").filter("bits <> hub").select(*_pair(F.col("bits"), F.col("hub")))
    return pairs.unionByName(near).distinct()


def _apart(keyed: DataFrame, edges: DataFrame, similarity: float, extra: int, crowded: int) -> DataFrame:
    """(a, b): pairs of a key that can have the similarity and are not together yet.

    In a crowded key most classes are together, a family: each pair that is not together
    has a class outside the largest such group of the key, so only the others meet all.
    """
    named = components(edges, LINKS).select(F.col("node").alias("bits"), F.col("component").alias("group"))
    members = keyed.join(gathered(named, LINKS), "bits", "left").withColumn("group", F.coalesce("group", "bits")).select(
        "bits", "size", "x", "y", *_ODDS, "group", F.explode("keys").alias("key"),
    ).withColumn("key", F.shiftright("key", extra))
    full = gathered(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowded), LINKS)
    differ = (F.col("l.group") != F.col("r.group")) & _near("l", "r", radius(similarity), similarity)
    few = members.join(full, "key", "left_anti")
    pairs = few.alias("l").join(few.alias("r"), "key").filter((F.col("l.bits") < F.col("r.bits")) & differ).select(*_pair(F.col("l.bits"), F.col("r.bits")))
    if full.isEmpty():
        return pairs.distinct()
    many = members.join(full.select("key"), "key")
    sizes = many.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "group")).alias("m")).select("key", F.col("m.group").alias("own"))
    others = many.join(gathered(largest, LINKS), "key").filter("group <> own").drop("own")
    met = others.alias("l").join(many.alias("r"), "key").filter(differ)
    return pairs.unionByName(met.select(*_pair(F.col("l.bits"), F.col("r.bits")))).distinct()


def _measured(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, d, n): pairs that can have the similarity, by all bits, all parities and their sizes.

    d is the number of bits that differ and n the size of the smaller set.
    """
    most = reach(similarity)

    def run(batches):
        for batch in batches:
            if batch.empty:
                continue
            p, q = (np.frombuffer(b"".join(batch[c]), dtype=np.uint64).reshape(len(batch), -1) for c in ("p", "q"))
            differing = np.bitwise_count(p ^ q)
            batch["d"] = differing[:, :_WORDS].sum(axis=1, dtype=np.int32)
            possible = differing[:, _WORDS:].sum(axis=1, dtype=np.int64) <= unlike(similarity) * (batch["n"] + batch["m"])
            yield batch.loc[(batch["d"] <= most) & possible, ["a", "b", "d", "n"]]

    side = lambda name, code, size: classes.select(F.col("bits").alias(name), F.col("code").alias(code), F.col("n").alias(size))
    full = pairs.join(side("a", "p", "m"), "a").join(side("b", "q", "n"), "b")
    sized = full.withColumns({"n": F.least("m", "n"), "m": F.greatest("m", "n")}).filter(F.col("n") >= similarity * F.col("m"))
    return gathered(sized.select("a", "b", "n", "m", "p", "q").mapInPandas(run, "a long, b long, d int, n long"), LINKS)


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(bits, items): the sets of the classes in pairs, read from one row per class or few."""
    wanted = gathered(pairs.select(F.col("a").alias("bits")).unionByName(pairs.select(F.col("b").alias("bits"))).distinct(), LINKS)
    ids = gathered(classes.join(wanted, "bits").select(F.col("first").alias("_id")).distinct(), LINKS)

    def run(batches):
        for batch in batches:
            found = [shingles(t, shingle) for t in batch["t"]]
            yield pd.DataFrame({"bits": [set_number(x) for x in found], "items": [x.tobytes() for x in found]}).astype({"bits": "int64"})

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    read = rows.join(ids, F.col("k").eqNullSafe(F.col("_id")), "left_semi").select("t").mapInPandas(run, "bits long, items binary")
    # Ids can be repeated, so other classes come along.
    return stored(read.join(wanted, "bits").groupBy("bits").agg(F.first("items").alias("items")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            near = []
            for p, q in zip(batch["p"], batch["q"], strict=True):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= similarity * max(len(p), len(q)) else 0
                near.append(both >= similarity * (len(p) + len(q) - both))
            yield batch.loc[near, ["a", "b"]]

    left = sets.select(F.col("bits").alias("a"), F.col("items").alias("p"))
    right = sets.select(F.col("bits").alias("b"), F.col("items").alias("q"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def _not_together(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    named = gathered(components(edges, LINKS), LINKS)
    return gathered(
        pairs.join(named.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(named.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns),
        LINKS,
    )


def _linked(pairs: DataFrame, edges: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """`edges` and verified links of the pairs: what all pairs of them connect is connected.

    Few pairs of each class are verified at a time, the closest first; those that are
    together by then need not be.
    """
    again, most, items = _not_together(pairs, edges), FEW, None
    while not again.isEmpty():
        if items is None:
            items = sets(again)
        degrees = again.groupBy("b").agg(F.count(F.lit(1)).alias("degree"), F.min("d").alias("low"), F.max("d").alias("high"))
        # About how many of the class's pairs are closer, if their distances are spread evenly.
        unit = (F.col("d") - F.col("low") + F.shiftrightunsigned(F.xxhash64("a", "b"), 11) / float(1 << 53)) / (F.col("high") - F.col("low") + 1)
        ranked = gathered(again.join(degrees, "b").select("a", "b", "d", (unit * F.col("degree")).alias("i")), LINKS)
        edges = gathered(edges.unionByName(_verified(ranked.filter(F.col("i") < most), items, similarity)), LINKS)
        again = ranked.filter(F.col("i") >= most).select("a", "b", "d")
        if again.isEmpty():
            break
        again, most = _not_together(again, edges), 64 * most
    return edges


def similar_links(docs: DataFrame, classes: DataFrame, key: str, text: str, shingle: int, similarity: float, crowded: int = CROWDED, extra: int = EXTRA) -> DataFrame:
    """(a, b): links between classes that connect those of the similarity."""
    keyed = _keyed(classes, similarity, extra)
    sure, edges = surely(similarity), classes.select(F.col("bits").alias("a"), F.col("bits").alias("b")).limit(0)

    def joined(pairs: DataFrame, edges: DataFrame) -> DataFrame:
        found = _measured(pairs, classes, similarity)
        certain = (F.col("d") <= sure) & (F.col("n") >= MANY)
        edges = gathered(edges.unionByName(found.filter(certain).select("a", "b")), LINKS)
        return _linked(found.filter(~certain).select("a", "b", "d"), edges, lambda p: _sets(docs, classes, p, key, text, shingle), similarity)

    edges = joined(_stars(keyed), edges)
    return joined(_apart(keyed, edges, similarity, extra, crowded), edges)


def grouped(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, bits) of every document, and one row per class: bits, component, component_id.

    `bits` tells the set of shingles, `component` is the smallest of the group and
    `component_id` its smallest document id, NULL if it has none. Texts without words
    are one class.
    """

    def run(batches):
        for batch in batches:
            found = [shingles(t, shingle) for t in batch["t"]]
            yield pd.DataFrame({
                "doc_id": batch["k"], "bits": np.array([set_number(x) for x in found], dtype=np.int64),
                "n": np.array([len(x) for x in found], dtype=np.int64), "code": [wide_fingerprint(x) + parities(x) for x in found],
            })

    coded = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, bits long, n long, code binary")
    coded = stored(coded)
    marked = coded.select("doc_id", "bits")
    classes = stored(coded.groupBy("bits").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("code").alias("code")))
    linked = components(similar_links(docs, classes, key, text, shingle, similarity), LINKS)
    named = classes.select("bits", "first").join(linked.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "component", F.coalesce("component", "bits")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return marked, checkpointed(named.join(smallest, "component").select("bits", "component", "component_id"))
