"""Near duplicates of vectors by iterative quantisation and multi-index hashing.

A rotation of the principal axes, learned so that signs lose little, turns vectors
into codes of 64 bits. The codes are cut into parts, and two vectors are
candidates if some part differs in one bit at most: every vector lies in a bucket
of each part, and visits those whose key differs by one bit. Candidates are
compared by their original vectors in double precision.

Equal vectors are one class from the start, with a size. A pair counts in the
first part that finds it, in the bucket with the smaller key, so no pair is
counted twice and none need be made distinct. Where a bucket is crowded, pairs are
not made as rows: its vectors are dealt out as tiles of blocks against blocks, and
a task returns just how many links each vector has, and a forest that connects
what they connect.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components

COSINE = 0.93
BITS, PARTS = 64, 4
SAMPLE = 20_000  # vectors that the rotation is fitted on at most: those with the least hash
ROUNDS = 50  # of fitting
CROWDED = 128  # vectors at home in a bucket that still meet in pairs
BLOCK = 512  # vectors of a tile's side
_PART_BITS = BITS // PARTS
_MASK = (1 << _PART_BITS) - 1


def fit(sample: np.ndarray, rounds: int = ROUNDS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes and the rotation that quantises them best.

    Alternates between the codes of the rotated data and the rotation nearest to
    them. Fewer dimensions than bits are filled up by random directions.
    """
    draw = np.random.default_rng(11)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, :bits]
    if axes.shape[1] < bits:
        more = draw.standard_normal((axes.shape[0], bits - axes.shape[1]))
        axes = np.hstack([axes, more / np.linalg.norm(more, axis=0)])
    data = centred @ axes
    rotation, _ = np.linalg.qr(draw.standard_normal((bits, bits)))
    for _ in range(rounds):
        codes = np.where(data @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(data.T @ codes)
        rotation = u @ v
    return mean, axes @ rotation


def codes(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = (unit - mean) @ projection >= 0
    return np.packbits(signs, axis=1, bitorder="little").view("<i8").ravel()


def _vectors(rows: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (vec_id), and the classes of equal usable vectors:
    (label, v, id, size), `id` the smallest of the class."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        F.col(vector).isNotNull() & F.col(label).isNotNull() & F.col(key).isNotNull() & finite
        & F.exists(values, lambda x: x != 0)
    )
    found = rows.filter(usable).select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"),
        # -0.0 is 0.0
        F.transform(values, lambda x: x + F.lit(0.0)).alias("v"),
    )
    return found, found.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))


def _units(column) -> np.ndarray:
    data = np.array(column.tolist(), dtype=float).reshape(len(column), -1)
    data /= np.abs(data).max(axis=1, keepdims=True)  # no overflow in squares
    return data / np.linalg.norm(data, axis=1, keepdims=True)


def encoded(classes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Classes with their `code`; the rotation is fitted per length of vectors, on a sample."""
    widths = [r["w"] for r in classes.select(F.size("v").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(64).collect()]
    models = {}
    for width in widths:
        picked = classes.filter(F.size("v") == width).select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
        models[width] = fit(_units(picked["v"]), rounds)

    def run(batches):
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int64)
            lengths = batch["v"].map(len).to_numpy()
            for width in np.unique(lengths):
                at = lengths == width
                # Lengths beyond the most frequent 64 share one code: they meet in tiles.
                if width in models:
                    out[at] = codes(_units(batch["v"][at]), *models[width])
            yield batch.assign(code=out)

    kept = classes.withColumn("width", F.size("v"))
    names = dict(classes.dtypes)
    schema = f"label {names['label']}, v array<double>, id long, size long, width int, code long"
    return kept.mapInPandas(run, schema)


def _part(code, t: int):
    return F.shiftrightunsigned(code, t * _PART_BITS).bitwiseAND(F.lit(_MASK))


def _first_part(x, y):
    """Number of the first part in which two codes differ in one bit at most."""
    return F.coalesce(*[F.when(F.bit_count(_part(x, t).bitwiseXOR(_part(y, t))) <= 1, F.lit(t)) for t in range(PARTS)])


def links(coded: DataFrame, cosine: float = COSINE, crowded: int = CROWDED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, n): how many other vectors each class links to, and (a, b): links that
    connect all linked classes."""
    where = ["label", "width", "t", "key"]
    parts = coded.select(
        "label", "width", "id", "code",
        F.posexplode(F.array(*[_part(F.col("code"), t) for t in range(PARTS)])).alias("t", "home"),
    )
    homes = parts.withColumn("key", F.col("home"))
    visits = parts.withColumn(
        "key", F.explode(F.array(*[F.col("home").bitwiseXOR(F.lit(1 << i)) for i in range(_PART_BITS)]))
    ).filter("key < home")  # the pair belongs to the bucket with the smaller key
    counted = checkpointed(homes.groupBy(*where).agg(F.count(F.lit(1)).alias("n")))
    small, large = counted.filter(F.col("n") <= crowded), counted.filter(F.col("n") > crowded)

    guests = homes.unionByName(visits)
    pairs = (
        homes.join(small.drop("n"), where).alias("x").join(guests.alias("y"), where)
        .filter("x.home < y.home or x.home = y.home and x.id < y.id")
        .filter(_first_part(F.col("x.code"), F.col("y.code")) == F.col("t"))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    )
    left = coded.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("size").alias("sa"))
    right = coded.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("size").alias("sb"))

    def compare(batches):
        for batch in batches:
            near = np.zeros(len(batch), dtype=bool)
            lengths = batch["va"].map(len).to_numpy()
            for width in np.unique(lengths):
                at = np.flatnonzero(lengths == width)
                near[at] = np.einsum("ij,ij->i", _units(batch["va"].iloc[at]), _units(batch["vb"].iloc[at])) >= cosine
            yield batch.loc[near, ["a", "b", "sa", "sb"]]

    linked = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "va", "vb").mapInPandas(compare, "a long, b long, sa long, sb long")
    linked = checkpointed(linked)
    counts = linked.select(F.col("a").alias("id"), F.col("sb").alias("n")).unionByName(linked.select(F.col("b").alias("id"), F.col("sa").alias("n")))

    tiles = checkpointed(_tiles(homes, visits, large, coded, cosine, block))
    counts = counts.unionByName(tiles.filter("b is null").select(F.col("a").alias("id"), "n"))
    edges = linked.select("a", "b").unionByName(tiles.filter("b is not null").select("a", "b"))
    return counts.groupBy("id").agg(F.sum("n").alias("n")), edges


def _tiles(homes: DataFrame, visits: DataFrame, large: DataFrame, coded: DataFrame, cosine: float, block: int) -> DataFrame:
    """Links of crowded buckets: rows (a, NULL, links of a) and (a, b, NULL) of a forest.

    Blocks of those at home meet blocks of all that are in the bucket.
    """
    where = ["label", "width", "t", "key"]
    guests = homes.withColumn("own", F.lit(True)).unionByName(visits.withColumn("own", F.lit(False))).join(large, where)
    blocks = F.ceil(F.col("n") / block).cast("int")
    total = F.col("_blocks")
    placed = guests.withColumn("_blocks", blocks).withColumn("_at", F.pmod(F.xxhash64("id"), total).cast("int"))
    rows = placed.filter("own").withColumn("column", F.explode(F.sequence(F.lit(0), total - 1))).withColumn("row", F.col("_at")).withColumn("side", F.lit(0))
    columns = placed.withColumn("row", F.explode(F.sequence(F.lit(0), total - 1))).withColumn("column", F.col("_at")).withColumn("side", F.lit(1))
    # Two blocks of those at home meet once, guests meet every block.
    dealt = rows.unionByName(columns).filter("side = 0 or not own or row <= column").select(*where, "row", "column", "side", "own", "id", "home")
    dealt = dealt.join(coded.select("id", "v", "size", "code"), "id")

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        return _tile(frame, cosine)

    return dealt.groupBy(*where, "row", "column").applyInPandas(tile, "a long, b long, n long")


def _tile(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    x, y = frame[frame["side"] == 0], frame[frame["side"] == 1]
    if x.empty or y.empty:
        return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
    t, same_block = int(frame["t"].iloc[0]), frame["row"].iloc[0] == frame["column"].iloc[0]
    near = _units(x["v"]) @ _units(y["v"]).T >= cosine
    differ = np.bitwise_xor(x["code"].to_numpy().view(np.uint64)[:, None], y["code"].to_numpy().view(np.uint64)[None, :])
    for earlier in range(t):
        part = (differ >> np.uint64(earlier * _PART_BITS)) & np.uint64(_MASK)
        near &= np.bitwise_count(part) > 1
    if same_block:  # those at home in one block meet twice
        near &= ~y["own"].to_numpy()[None, :] | (x["id"].to_numpy()[:, None] < y["id"].to_numpy()[None, :])
    by_x = near @ y["size"].to_numpy()
    by_y = x["size"].to_numpy() @ near
    forest = _forest(near, x["id"].to_numpy(), y["id"].to_numpy())
    counts = pd.DataFrame({"a": np.concatenate([x["id"], y["id"]]), "n": np.concatenate([by_x, by_y])})
    counts = counts[counts["n"] > 0].assign(b=None)[["a", "b", "n"]]
    return pd.concat([counts.astype("Int64"), forest.assign(n=None).astype("Int64")], ignore_index=True)


def _forest(near: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray) -> pd.DataFrame:
    """Links of each vector to the smallest it reaches inside the tile."""
    ids = np.concatenate([x_ids, y_ids])
    names, at = np.unique(ids, return_inverse=True)
    i, j = np.nonzero(near)
    a, b = at[i], at[len(x_ids) + j]
    least = np.arange(len(names))
    while True:
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        least = least[least]
        if (least == before).all():
            break
    moved = np.flatnonzero(least != np.arange(len(names)))
    return pd.DataFrame({"a": names[least[moved]], "b": names[moved]})


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors of the same label and length link if their cosine in double precision
    is at least `cosine`; those without a label, an id or a usable vector (NULL,
    zero, a NULL or non-finite component) link with nothing and are components of
    their own. Equal vectors are always found; of others, pairs whose codes differ
    in two or more bits in every part are missed. A row that repeats an id is a
    vector of its own, which counts as a link. Empty tables give an empty result.
    """
    found, classes = _vectors(rows, key, vector, label)
    coded = checkpointed(encoded(checkpointed(classes), rounds))
    counts, edges = links(coded, cosine)
    together = components(edges)
    named = (
        coded.select("label", "v", "id", "size").join(counts, "id", "left")
        .join(together.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = found.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    rest = _unusable(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unusable(rows: DataFrame) -> DataFrame:
    values = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(
        F.col("embedding").isNull() | F.col("label").isNull() | F.col("vec_id").isNull()
        | F.coalesce(bad, F.lit(False)) | F.forall(values, lambda x: F.coalesce(x == 0, F.lit(False)))
    )
