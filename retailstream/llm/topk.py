"""Exact top-k by inner product: columnar branch and bound over tiles.

Queries and candidates are cut into blocks; a task gets one block of each. There
the candidates lie in columns, a block of dimensions after the other. Scores are
added up block by block, and after each block only candidates stay whose score
so far, plus the most that the remaining dimensions can add (the product of the
remaining norms), reaches the k-th best score that is already certain. The best
k of all tiles are ranked per query.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

K = 20
SCALE = 64
QUERY_BLOCK = 2_048  # queries of a tile
CANDIDATE_BLOCK = 8_192  # candidates of a tile
DIMENSIONS = 8  # of a block of columns
_EXACT = float(1 << 53)  # whole numbers below it are exact as doubles
_TILE = "query_id long, vec_id long, score long"


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components turned into floor(scale * x).

    Vectors that are NULL or hold NULL or non-finite components are left out.
    """
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.col(vector).isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(usable).select(
        F.col(key).alias("vec_id"), F.transform(values, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"),
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(vec_id, v) and (vec_id, v) of whole numbers -> (query_id, rank, vec_id, score).

    The k highest inner products of each query with all vectors whose id is not
    its own, fewer if there are fewer; ties go to the smaller id, NULL ids last.
    Vectors of unequal length are compared as if filled up with zeros. A query
    that is there twice counts once, and a candidate row that is there twice is
    found twice. Scores beyond the range of a long stop at its ends. Empty tables
    give an empty result.
    """
    n, m = (frame.count() for frame in (vectors, queries))
    columns, rows = -(-n // CANDIDATE_BLOCK) or 1, -(-m // QUERY_BLOCK) or 1
    place = F.xxhash64("vec_id", "v")
    candidates = vectors.select(
        F.lit(False).alias("asks"), "vec_id", "v", F.pmod(place, F.lit(columns)).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"),
    )
    asking = queries.dropDuplicates(["vec_id"]).select(
        F.lit(True).alias("asks"), "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"),
        F.pmod(place, F.lit(rows)).cast("int").alias("r"),
    )

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        return best_of_tile(frame, k)

    found = candidates.unionByName(asking).groupBy("c", "r").applyInPandas(tile, _TILE)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of_tile(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    asks = frame["asks"].to_numpy(dtype=bool)
    width = max(map(len, frame["v"]), default=0)
    values = np.zeros((len(frame), width))
    for i, v in enumerate(frame["v"]):
        values[i, : len(v)] = v
    # The largest integer stands for NULL: it sorts last and is turned back below.
    no_id = np.iinfo(np.int64).max
    ids = frame["vec_id"].astype("Int64").fillna(no_id).to_numpy(dtype=np.int64)
    order = np.argsort(ids[~asks], kind="stable")
    ids_c, columns = ids[~asks][order], np.ascontiguousarray(values[~asks][order].T)
    exact = width * float(np.abs(values).max(initial=0)) ** 2 < _EXACT
    norms = _norms_after(columns) if exact else None
    out = []
    for q, own in zip(values[asks], ids[asks], strict=True):
        if exact:
            at, score = _branch_and_bound(columns, norms, q, ids_c, own, k)
        else:
            at, score = _plain(columns, q, ids_c, own, k)
        out.append((np.full(len(at), own), ids_c[at], score))
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    query_id, vec_id, score = map(np.concatenate, zip(*out, strict=True))
    table = pd.DataFrame({"query_id": query_id, "vec_id": pd.array(vec_id, dtype="Int64"), "score": score.astype("int64")})
    table.loc[table["vec_id"] == no_id, "vec_id"] = pd.NA
    return table


def _norms_after(columns: np.ndarray) -> np.ndarray:
    """[b, i]: norm of vector i without the dimensions of the first b + 1 blocks."""
    squares = np.add.reduceat(columns**2, np.arange(0, max(len(columns), 1), DIMENSIONS), axis=0) if len(columns) else columns
    left = squares.sum(axis=0) - np.cumsum(squares, axis=0)
    return np.sqrt(np.maximum(left, 0))


def _branch_and_bound(columns, norms, query, ids, own, k):
    """Positions of the best k candidates and their scores; positions are in order of id."""
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive))
    for b, first in enumerate(range(0, len(columns), DIMENSIONS)):
        part = slice(first, first + DIMENSIONS)
        block = columns[part] if len(alive) == columns.shape[1] else columns[part][:, alive]
        score += query[part] @ block
        if len(alive) <= k:
            continue
        rest = norms[b][alive] * np.linalg.norm(query[first + DIMENSIONS :])
        # Scores are whole numbers: half of one makes up for rounding of the bound.
        sure = np.partition(score - rest, len(alive) - k)[len(alive) - k] - 0.5
        keep = score + rest >= sure
        if not keep.all():
            alive, score = alive[keep], score[keep]
    best = np.lexsort((alive, -score))[:k]
    return alive[best], score[best]


def _plain(columns, query, ids, own, k):
    """The same with Python's integers, for scores that doubles can't hold."""
    alive = np.flatnonzero(ids != own)
    whole, q = columns[:, alive].astype(object), [int(x) for x in query]
    ends = np.iinfo(np.int64)
    sums = [min(max(sum(int(x) * y for x, y in zip(column, q, strict=True)), ends.min), ends.max) for column in whole.T]
    best = sorted(range(len(alive)), key=lambda i: (-sums[i], i))[:k]
    return alive[best], np.array([sums[i] for i in best], dtype=np.int64)


def search(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K) -> DataFrame:
    """Top k of each row whose id is divisible by `every`, against all rows."""
    vectors = checkpointed(whole_vectors(rows, key, vector))
    return top_k(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
