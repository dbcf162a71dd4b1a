"""Masked pseudo-likelihood of documents.

A small network predicts every word from the words around it, on both sides. The
sum of the conditional log-probabilities of all words of a document is its score.

Words are numbered by a hash, and numbers are gathered into classes: frequent
ones alone, the others by frequency, classes about equally heavy. The network,
written in numpy, predicts the class; inside a class a number has its share of
the corpus. Counts cover all words of all documents. Training goes over all
documents too: each round masks and predicts a part of the words of each, so that
over the rounds every word is predicted once. Each task trains a copy of the network
on what it reads, and Spark averages the copies by the words they have seen before
the next round.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

NUMBERS = 1 << 16  # hashed words
CLASSES, ALONE = 128, 96  # classes, and those of one number
SIDE = 2  # words on either side
WIDTH, HIDDEN = 16, 32
ROUNDS = 2
BATCH = 4_096  # words of a training step or a scoring step
RATE = 0.05
_CACHE = 300_000  # words whose numbers a task remembers
_SHAPES = {
    "E": (CLASSES + 1, WIDTH), "W": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, CLASSES), "c": (CLASSES,),
}
_PARAMETERS = sum(int(np.prod(s)) for s in _SHAPES.values())
_OFFSETS = np.array([o for o in range(-SIDE, SIDE + 1) if o])


def numbers_of(text: str | None, cache: dict) -> np.ndarray:
    """Numbers of the words of a text in lower case."""
    words = (text or "").lower().split()
    out = []
    for w in words:
        n = cache.get(w)
        if n is None:
            if len(cache) >= _CACHE:
                cache.clear()
            n = cache[w] = zlib.crc32(w.encode("utf-8", "replace")) & (NUMBERS - 1)
        out.append(n)
    return np.array(out, dtype="<u2")


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words): the words' numbers, two bytes each."""

    def run(batches):
        cache = {}
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["k"], "words": [numbers_of(t, cache).tobytes() for t in batch["t"]]})

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, "doc_id long, words binary")


def count_numbers(rows: DataFrame) -> np.ndarray:
    """How often each number stands in the corpus, over all documents."""

    def run(batches):
        counts = np.zeros(NUMBERS, dtype=np.int64)
        for batch in batches:
            for words in batch["words"]:
                np.add.at(counts, np.frombuffer(words, dtype="<u2"), 1)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"number": at.astype(np.int32), "n": counts[at]})

    found = rows.mapInPandas(run, "number int, n long").groupBy("number").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(NUMBERS, dtype=np.int64)
    counts[found["number"]] = found["n"]
    return counts


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each number, and the logarithm of its share of the class."""
    order = np.argsort(-counts, kind="stable")
    classes = np.zeros(NUMBERS, dtype=np.int64)
    classes[order[:ALONE]] = np.arange(ALONE)
    rest = order[ALONE:]
    mass = np.cumsum(counts[rest] + 1.0)
    classes[rest] = ALONE + np.minimum(((mass - 1) / mass[-1] * (CLASSES - ALONE)).astype(int), CLASSES - ALONE - 1)
    smooth = counts + 1.0
    return classes, np.log(smooth / np.bincount(classes, weights=smooth, minlength=CLASSES)[classes])


class Network:
    """Class of a word from the classes of its neighbours."""

    def __init__(self, flat: np.ndarray | None = None):
        self.p, at = {}, 0
        if flat is None:
            draw = np.random.default_rng(7)
            flat = np.concatenate([
                (draw.standard_normal(int(np.prod(s))) * (0.0 if len(s) == 1 else 1 / np.sqrt(s[0] if k != "E" else WIDTH)))
                for k, s in _SHAPES.items()
            ])
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            self.p[name] = np.array(flat[at : at + n], dtype=np.float32).reshape(shape)
            at += n
        self.squares = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(float)

    def tables(self) -> list[np.ndarray]:
        """What each class adds to the hidden layer, by place."""
        return [self.p["E"] @ self.p["W"][i * WIDTH : (i + 1) * WIDTH] for i in range(2 * SIDE)]

    def log_probabilities(self, around: np.ndarray, target: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        hidden = np.tile(self.p["b"], (len(target), 1))
        for i, t in enumerate(tables):
            hidden += t[around[:, i]]
        np.tanh(hidden, out=hidden)
        out = hidden @ self.p["V"]
        out += self.p["c"]
        out -= out.max(axis=1, keepdims=True)
        chosen = out[np.arange(len(target)), target].copy()
        np.exp(out, out=out)
        return chosen - np.log(out.sum(axis=1))

    def train(self, around: np.ndarray, target: np.ndarray) -> None:
        """One step of adaptive gradient descent on the mean log-probability."""
        p, n = self.p, len(target)
        hidden = np.tile(p["b"], (n, 1))
        for i, t in enumerate(self.tables()):
            hidden += t[around[:, i]]
        np.tanh(hidden, out=hidden)
        out = hidden @ p["V"]
        out += p["c"]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out *= 1 / (n * out.sum(axis=1, keepdims=True))
        out[np.arange(n), target] -= np.float32(1 / n)
        back = (out @ p["V"].T) * (1 - hidden**2)
        embedded, weights = np.zeros_like(p["E"]), np.zeros_like(p["W"])
        for i in range(2 * SIDE):
            place, due = slice(i * WIDTH, (i + 1) * WIDTH), summed(back, around[:, i])
            embedded += due @ p["W"][place].T
            weights[place] = p["E"].T @ due
        for name, gradient in (("V", hidden.T @ out), ("c", out.sum(axis=0)), ("W", weights), ("b", back.sum(axis=0)), ("E", embedded)):
            self.squares[name] += gradient**2
            p[name] -= np.float32(RATE) * gradient / np.sqrt(self.squares[name])


def summed(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The sum of the rows of each class, and of those beyond the ends of texts."""
    small = classes.astype(np.min_scalar_type(CLASSES))  # sorted by counting
    order = np.argsort(small, kind="stable")
    first = np.flatnonzero(np.diff(small[order], prepend=-1))
    out = np.zeros((CLASSES + 1, rows.shape[1]), dtype=rows.dtype)
    out[small[order[first]]] = np.add.reduceat(rows[order], first)
    return out


def targets(words: bytes, n: int, turn: int, rounds: int) -> np.ndarray:
    """Places of the n words of a text that are predicted in a round; over all rounds each place once."""
    return np.arange((zlib.crc32(words) + turn) % rounds, n, rounds)


def surroundings(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes around the places given; a class of its own beyond the ends of a text."""
    padded = np.concatenate([np.full(SIDE, CLASSES), classes, np.full(SIDE, CLASSES)])
    return padded[at[:, None] + SIDE + _OFFSETS[None, :]]


def train(rows: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> Network:
    """A network trained on every word of all documents, averaged over tasks after each round."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)  # NUMBERS numbers
    network = Network()
    for turn in range(rounds):
        start = network.flat()

        def run(batches, start=start, turn=turn):
            own, seen, around, target, waiting = Network(start), 0, [], [], 0
            for batch in batches:
                for words in batch["words"]:
                    ids = np.frombuffer(words, dtype="<u2")
                    at = targets(words, len(ids), turn, rounds)
                    for first in range(0, len(at), BATCH):
                        part = at[first : first + BATCH]
                        low, high = max(0, part[0] - SIDE), part[-1] + SIDE + 1
                        near = shared.value[ids[low:high]]
                        padded = np.concatenate([
                            np.full(max(0, SIDE - part[0]), CLASSES), near, np.full(max(0, part[-1] + SIDE + 1 - len(ids)), CLASSES),
                        ])
                        shift = part - part[0] + SIDE
                        around.append(padded[shift[:, None] + _OFFSETS[None, :]])
                        target.append(padded[shift])
                        waiting += len(part)
                        if waiting >= BATCH:
                            own.train(np.concatenate(around), np.concatenate(target))
                            seen, around, target, waiting = seen + waiting, [], [], 0
            if waiting:
                own.train(np.concatenate(around), np.concatenate(target))
                seen += waiting
            if seen:
                yield pd.DataFrame({"i": np.arange(_PARAMETERS, dtype=np.int32), "v": own.flat() * seen, "n": float(seen)})

        mean = rows.mapInPandas(run, "i int, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
        if len(mean):
            flat = np.zeros(_PARAMETERS)
            flat[mean["i"]] = mean["v"]
            network = Network(flat)
    return network


def log_likelihood(ids: np.ndarray, classes: np.ndarray, shares: np.ndarray, network: Network, tables: list[np.ndarray]) -> float:
    """Sum of the log-probabilities of all words, each from the words on both sides."""
    own, total = classes[ids], float(shares[ids].sum())
    for first in range(0, len(ids), BATCH):
        at = np.arange(first, min(first + BATCH, len(ids)))
        total += float(network.log_probabilities(surroundings_of(own, at), own[at], tables).sum(dtype=float))
    return total


def surroundings_of(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`surroundings` of consecutive places, without a copy of the whole text."""
    low = max(0, at[0] - SIDE)
    return surroundings(own[low : at[-1] + SIDE + 1], at - low)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood), one row per document.

    The mean is per word, NULL for texts without words (NULL, empty or blank), whose
    sum is 0. Copies have equal scores. Repeated rows stay rows; other columns are
    left out; an empty table gives an empty result.
    """
    rows = stored(tokens(docs, key, text))
    classes, shares = classes_of(count_numbers(rows))
    network = train(rows, classes, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((classes, shares, network.flat()))

    def run(batches):
        classes, shares, flat = shared.value
        network = Network(flat)
        tables = network.tables()
        for batch in batches:
            texts = [np.frombuffer(w, dtype="<u2") for w in batch["words"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_words": [len(ids) for ids in texts],
                "log_likelihood": [log_likelihood(ids, classes, shares, network, tables) for ids in texts],
            })

    scored = rows.mapInPandas(run, "doc_id long, n_words long, log_likelihood double")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
