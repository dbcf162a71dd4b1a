"""Fill-in-the-middle: a text cut in two places and told as prefix, suffix, middle.

Where a text may be cut is a set of byte offsets, kept as a Roaring bitmap keeps its
numbers: containers for 65,536 offsets each, as an array, a bitmap or runs, whichever
is smallest, and their cumulative cardinalities. The offset of a cut is a selection:
a search for the container among the cardinalities, then a selection within it. So
a cut that is drawn by its rank among characters (or lines) is found without taking
the text apart.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 16  # offsets of a container
MARKS = (b"<P>", b"<S>", b"<M>")  # prefix, suffix, middle
PLAIN = 10  # of 100 texts stay as they are
SUFFIX_FIRST = 20  # of 100 others begin with the suffix
SEED = 1
UNITS = ("character", "line")
PIECE = 64 << 20  # bytes of output that a task hands on at once
_WORD = 64


class _Array:
    """Sorted offsets, two bytes each."""

    def __init__(self, mask):
        self.values = np.flatnonzero(mask).astype(np.uint16)

    @staticmethod
    def size(cardinality, runs):
        return 2 * cardinality

    def select(self, rank):
        return int(self.values[rank])


class _Bitmap:
    """One bit per offset of the container, and how many are set before each word."""

    def __init__(self, mask):
        bits = np.zeros(SPAN, dtype=bool)
        bits[: len(mask)] = mask
        self.words = np.packbits(bits, bitorder="little").reshape(-1, _WORD // 8)
        self.upto = np.cumsum(bits.reshape(-1, _WORD).sum(axis=1))

    @staticmethod
    def size(cardinality, runs):
        return SPAN // 8

    def select(self, rank):
        word = int(np.searchsorted(self.upto, rank, side="right"))
        before = int(self.upto[word - 1]) if word else 0
        bits = np.flatnonzero(np.unpackbits(self.words[word], bitorder="little"))
        return word * _WORD + int(bits[rank - before])


class _Runs:
    """Beginnings of runs, and how many offsets there are up to the end of each."""

    def __init__(self, mask):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
        self.first = edges[::2]
        self.upto = np.cumsum(edges[1::2] - edges[::2])

    @staticmethod
    def size(cardinality, runs):
        return 4 * runs

    def select(self, rank):
        run = int(np.searchsorted(self.upto, rank, side="right"))
        return int(self.first[run]) + rank - (int(self.upto[run - 1]) if run else 0)


def container(mask: np.ndarray):
    """The smallest of the three containers for the offsets at which the mask is true."""
    cardinality = int(np.count_nonzero(mask))
    runs = int(mask[0]) + int(np.count_nonzero(mask[1:] > mask[:-1]))
    kind = min((_Array, _Bitmap, _Runs), key=lambda k: k.size(cardinality, runs))
    return kind(mask), cardinality


class Boundaries:
    """The byte offsets at which a UTF-8 text can be cut: where a unit begins, and the end."""

    def __init__(self, data: bytes, unit: str = "character"):
        if unit not in UNITS:
            raise ValueError(f"cut between units of {UNITS}")
        raw, end = np.frombuffer(data, dtype=np.uint8), len(data)
        self.containers, counts = [], []
        for base in range(0, end + 1, SPAN):
            stop = min(base + SPAN, end + 1)
            mask = np.ones(stop - base, dtype=bool)  # the end is a boundary, and so is the beginning
            if unit == "character":
                found = raw[base : min(stop, end)]
                mask[: len(found)] = (found & 0xC0) != 0x80
            else:
                low = max(base, 1)
                found = raw[low - 1 : min(stop, end) - 1]
                mask[low - base : low - base + len(found)] = found == 0x0A
            if base == 0:
                mask[0] = True
            made, cardinality = container(mask)
            self.containers.append(made)
            counts.append(cardinality)
        self.upto = np.cumsum(counts)

    @property
    def units(self) -> int:
        return int(self.upto[-1]) - 1

    def select(self, rank: int) -> int:
        """The offset that `rank` others precede, from 0 to the number of units."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        at = int(np.searchsorted(self.upto, rank, side="right"))
        return at * SPAN + self.containers[at].select(rank - (int(self.upto[at - 1]) if at else 0))


def draws(key: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that depend on the id and the seed alone."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else int(key)}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def told(key: int | None, data: bytes, unit: str = "character", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: int = SEED):
    """(units, form, units of the prefix, units of the middle, output) of one text."""
    first, second, whether, order = draws(key, seed)
    cuts = Boundaries(data, unit)
    n = cuts.units
    if not data or whether % 100 >= 100 - plain or any(mark in data for mark in MARKS):
        return n, "plain", None, None, data
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = cuts.select(low), cuts.select(high)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = MARKS
    if order % 100 < suffix_first:
        return n, "spm", low, high - low, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", low, high - low, b"".join((p, prefix, s, suffix, m, middle))


_SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"


def _batch(rows: list) -> pa.RecordBatch:
    ids, n, forms, prefix, middle, output = zip(*rows, strict=True)
    # A view and not a cast: what was no proper UTF-8 stays as it was.
    texts = pa.array(output, pa.binary()).view(pa.string())
    numbers = [pa.array(c, pa.int64()) for c in (ids, n, prefix, middle)]
    return pa.RecordBatch.from_arrays([numbers[0], numbers[1], pa.array(forms, pa.string()), numbers[2], numbers[3], texts], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])


def infilled(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "character", plain: int = PLAIN,
    suffix_first: int = SUFFIX_FIRST, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output), one row per document.

    `form` is `psm`, `spm` or, for texts that stay as they are, `plain`: those drawn to
    stay, empty ones and those that hold a mark. Units are code points or, with
    unit="line", lines with their ends; `prefix_units` and `middle_units` are NULL for
    plain texts. A NULL text counts as empty, a NULL id draws like an id without
    digits. Repeated rows give the same result each; other columns are left out; an
    empty table gives an empty result. A text is held in memory whole by its task.
    """

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = value.as_py() or b""
                rows.append((number, *told(number, data, unit, plain, suffix_first, seed)))
                held += len(data)
                if held > PIECE:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that was told, from what was told and its form alone.

    A text with marks is plain and no mark begins within another, so the marks of
    the other forms are the only ones that occur.
    """
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def digests(told_docs: DataFrame) -> DataFrame:
    """The result as digests: output_sha256 and restored_sha256 in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return told_docs.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
