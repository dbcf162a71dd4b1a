"""Packing documents into windows of tokens by best-fit decreasing.

Each task packs what it reads. Texts become ids; a document that is longer than
a window is first cut into full windows, and the rest of it, smaller than a
window, waits with the rests of the task's other documents. These are placed
longest first, each into the open window with the least room that still holds
it, which a segment tree over remaining capacities finds in a few steps. Nothing
is shuffled: a task reads thousands of documents, so the few windows that stay
half empty at its end don't matter. What a task keeps is four numbers a document.
"""

import base64
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


WINDOW = 1_024
SEPARATOR = 0  # the id that ends a document
SPECIAL = "<|endoftext|>"
# Long texts are turned into ids by pieces of about so many characters. A piece
# ends before a blank between two letters: no token ever crosses that place.
PIECE = 1 << 16
_SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_IDS_BITS = 31  # of a sequence id: the window's number in its task

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)


def tokenizer(path: str):
    """A function from text to ids, of a vocabulary file.

    `.tiktoken` holds the same vocabulary as ranks, and its library is three times
    as fast, with the same ids; `.json` is read by the tokenizers library. A text that
    the first gives up on, with a million blanks in a row, goes to the second, which
    reads the `.json` file of the same name.
    """
    if path.endswith(".tiktoken"):
        import tiktoken
        from public_tokenizers import PATTERN

        lines = map(bytes.split, Path(path).read_bytes().splitlines())
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        known = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
        plain = []

        def encode(text: str) -> np.ndarray:
            try:
                return known.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                if not plain:
                    plain.append(tokenizer(path.removesuffix(".tiktoken") + ".json"))
                return plain[0](text)

        return encode
    from tokenizers import Tokenizer

    read = Tokenizer.from_file(path)
    return lambda text: np.array(read.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(text: str, size: int = PIECE):
    """The text in parts that have the ids of the whole when put together."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def ids_of(text: str | None, encode, separator: int = SEPARATOR) -> np.ndarray:
    """Ids of a text (NULL: empty) and the separator, as little-endian 32-bit numbers."""
    parts = [encode(part) for part in pieces(text)] if text else []
    return np.concatenate([*parts, np.array([separator])]).astype("<u4")


class OpenWindows:
    """Windows by remaining capacity, in a segment tree.

    Leaf r stands for the windows with room for r tokens, an inner node for
    whether one of its leaves has any. The tightest window for n tokens is the
    first leaf from n on that has one.
    """

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.windows = [[] for _ in range(self.width)]
        self.filled = bytearray(2 * self.width)

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.width
        while node and not self.filled[node]:
            self.filled[node] = 1
            node //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """(window, room) of the tightest one with room for `length`, which leaves the tree."""
        node = length + self.width
        while not self.filled[node]:
            while node & 1:  # a right child, or the root: nothing further right below this parent
                node //= 2
            if node == 0:
                return None
            node += 1
        while node < self.width:
            node = 2 * node + (not self.filled[2 * node])
        room = node - self.width
        window = self.windows[room].pop()
        while node and not (self.windows[node - self.width] if node >= self.width else self.filled[2 * node] or self.filled[2 * node + 1]):
            self.filled[node] = 0
            node //= 2
        return window, room


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length (1 to `size`), windows counted from 0."""
    windows, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, n = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = tree.take(length)
        window, room = found or (n, size)
        n += found is None
        windows[i], offsets[i] = window, size - room
        if room > length:
            tree.put(room - length, window)
    return windows, offsets


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", size: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_length, and with `with_ids` the ids themselves.

    `vocabulary` is a path that the executors can read. A document has at least its
    separator, NULL and empty texts included, so it has at least one piece. Rows
    that repeat a key are documents each. Sequences hold at most `size` tokens, and
    their pieces lie at gapless offsets. Other columns are left out; an empty table
    gives an empty result. A sequence id is made of the number of the task that
    packs it, so a task that runs again on the same rows gives the same rows.
    """
    id_column, text_column = "k", "t"
    narrow = docs.select(F.col(key).cast("long").alias(id_column), F.col(text).alias(text_column))

    def run(batches):
        encode = tokenizer(vocabulary)
        first, count = TaskContext.get().partitionId() << _IDS_BITS, 0
        rests = []
        for batch in batches:
            full = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(content.as_py(), encode)
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                    if len(piece) == size:
                        full.append((*row, first + count, 0, size, piece if with_ids else None))
                        count += 1
                    else:
                        rests.append((*row, piece if with_ids else None))
                if len(full) >= 10_000:
                    yield table(full)
                    full = []
            yield table(full)
        # In an order that doesn't depend on the order in which rows came.
        rests.sort(key=lambda x: (x[2], x[0] is None, x[0] or 0, x[1], x[3]))
        lengths = np.array([x[2] for x in rests], dtype=np.int64)
        windows, offsets = best_fit_decreasing(lengths, size)
        held = np.bincount(windows, weights=lengths).astype(np.int64) if len(rests) else lengths
        for at in range(0, len(rests), 10_000):
            yield table([
                (*rests[i][:5], first + count + int(windows[i]), int(offsets[i]), int(held[windows[i]]), rests[i][5])
                for i in range(at, min(at + 10_000, len(rests)))
            ])

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def table(rows):
        columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
        arrays = [pa.array(c, type=pa.int64()) for c in columns[: len(names)]]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int64) for x in columns[-1]], type=pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, [*names, *["ids"] * with_ids])

    return narrow.mapInArrow(run, SCHEMA + ", ids array<long>" * with_ids)
