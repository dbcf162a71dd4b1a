"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits in place of letters) and
matched by an Aho-Corasick automaton. A term counts at the beginning of a word;
exception phrases excuse the terms inside them. The weights found are normalised
by the length of the text, and a logistic curve turns them into a score.

The lexicon is learned from labelled documents: beginnings of words that are far
more frequent in toxic ones, chosen one after the other by the toxic documents
that earlier terms explain least. Exceptions are words and pairs of words that
hold a term and yet stand in clean documents.
"""

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, stored

SAMPLE = 20_000  # labelled documents learned from at most: those with the least hash of their id
CANDIDATES = 3_000  # beginnings of words that the choice starts from at most
TERMS = 400  # in the lexicon at most
EXCEPTIONS = 1_000  # learned at most
SHORTEST, LONGEST = 3, 12  # letters of a term
LEAST_DOCS = 4  # toxic documents that a term must stand in
LEAST_NEW = 2.5  # of them, each halved with every term that it already holds
LEAST_RATIO = 6.0  # how much more frequent a term is in toxic documents
_FLUSH = 100_000  # counted beginnings that a task keeps
_SLICE = 1 << 20  # characters that are folded at once

# Letters that look like Latin ones, by the Latin letter.
LOOK_ALIKES = {
    "a": "аɑαａ@", "b": "ьв", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ€", "g": "ɡ", "h": "һн", "i": "іıιｉ", "j": "јｊ", "k": "кκ",
    "l": "ⅼӏ", "m": "мｍ", "n": "пηｎ", "o": "оοσｏ", "p": "рρｐ", "s": "ѕｓ$", "t": "тτｔ", "u": "υｕ", "v": "ѵνｖ", "w": "ѡｗ",
    "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
# Digits written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}

_FOLDED = {ord(c): latin for latin, others in LOOK_ALIKES.items() for c in others if ord(c) > 127}
_GAPS = {c: " " for c in [*range(0x2000, 0x200B), *range(0x2010, 0x2060), 0x85, 0xA0, 0xA1, 0xAB, 0xBB, 0xBF, 0xB7, 0x3000, 0x3001, 0x3002]}
_NOTHING = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], "")
_WIDE = _FOLDED | _GAPS | _NOTHING
_ANY_WIDE = re.compile("[" + "".join(map(re.escape, map(chr, _WIDE))) + "]")
_ASCII = {c: latin for latin, others in LOOK_ALIKES.items() for c in others if ord(c) < 128} | DIGITS
_NARROW = bytes(
    b if b >= 128 or chr(b).isalpha() else ord(_ASCII.get(chr(b), " ")) for b in range(256)
)
_BLANK = re.compile(r"\s")


def folded(text: str) -> str:
    """Lower case, look-alikes and digits as Latin letters, words between blanks."""
    text = text.lower()
    if not text.isascii() and _ANY_WIDE.search(text):
        text = text.translate(_WIDE)
    return text.encode("utf-8", "replace").translate(_NARROW).decode("utf-8")


def slices(text: str | None, size: int = _SLICE) -> Iterator[str]:
    """The folded text in parts that end between words."""
    start = 0
    while text and start < len(text):
        found = _BLANK.search(text, start + size)
        end = found.start() if found else len(text)
        yield folded(text[start:end])
        start = end


class Matcher:
    """Terms with weights and exception phrases, in one automaton."""

    def __init__(self, terms: dict[str, float], exceptions=()):
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            self.automaton.add_word(f" {term}", (0, len(term), term, weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (1, len(phrase) + 1, phrase, 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, part: str) -> list[tuple[int, str, float]]:
        """(position of the first letter, term, weight); the longest term of a word counts."""
        if not len(self.automaton):
            return []
        found, excused = {}, []
        for end, (kind, length, term, weight) in self.automaton.iter(f" {part} "):
            start = end - length + 1
            if kind:
                excused.append((start, end))
            elif start not in found or len(term) > len(found[start][0]):
                found[start] = (term, weight)
        free = _outside(excused)
        return [(at, *hit) for at, hit in found.items() if free(at)]


def _outside(spans: list[tuple[int, int]]) -> Callable[[int], bool]:
    """Whether a place lies in none of the spans (low, high), which may overlap."""
    lows, highs = [], []
    for low, high in sorted(spans):
        if highs and low <= highs[-1]:
            highs[-1] = max(highs[-1], high)
        else:
            lows.append(low)
            highs.append(high)

    def free(at: int) -> bool:
        i = bisect_right(lows, at)
        return i == 0 or at >= highs[i - 1]

    return free


def _word_before(text: str, at: int) -> list[str]:
    """The last word before a place, looked for no further back than needed."""
    reach = 64
    while True:
        words = text[max(0, at - reach) : at].rsplit(None, 1)
        if len(words) > 1 or reach >= at:
            return words[-1:]
        reach *= 2


def features(text: str | None, matcher: Matcher) -> tuple[float, float]:
    """Weight of all hits: over the logarithm of the length, and on a scale of its own."""
    weight, words = 0.0, 0
    for part in slices(text):
        words += len(part.split())
        weight += sum(hit[2] for hit in matcher.hits(part))
    return weight / np.log2(2 + words), float(np.log1p(max(0.0, weight)))


def _sample(docs, labels, key, text, label_key, label, parts, left_out):
    """(text, toxic) of at most SAMPLE labelled documents."""
    labelled = (
        labels.filter((remainder(label_key, parts) != left_out) & F.col(label).isNotNull())
        .groupBy(F.col(label_key).alias("k")).agg((F.max(label) > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    )
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return stored(rows.join(F.broadcast(labelled), "k").select("t", "y"))  # SAMPLE rows of two numbers


def _beginnings(batches):
    """Beginnings of words with the numbers of clean and toxic documents that have them."""
    counts = (Counter(), Counter())
    for batch in batches:
        for content, toxic in zip(batch["t"], batch["y"], strict=True):
            words = {w[:LONGEST] for part in slices(content) for w in part.split()}
            counts[toxic].update({w[:n] for w in words for n in range(SHORTEST, len(w) + 1)})
            if len(counts[0]) + len(counts[1]) > _FLUSH:
                yield _table(counts)
                counts = (Counter(), Counter())
    yield _table(counts)


def _table(counts):
    terms = sorted(counts[0].keys() | counts[1].keys())
    return pd.DataFrame({"term": terms, "clean": [counts[0][t] for t in terms], "toxic": [counts[1][t] for t in terms]}).astype({"term": str, "clean": "int64", "toxic": "int64"})


def _ratio(toxic, clean, n_toxic, n_clean):
    return ((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1))


def _candidates(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    found = sample.mapInPandas(_beginnings, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    ratio = _ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    strong = found.filter((F.col("toxic") >= LEAST_DOCS) & (ratio >= LEAST_RATIO))
    rows = strong.orderBy(F.desc(F.col("toxic") * F.log(ratio)), "term").limit(CANDIDATES).collect()
    known = {r["term"]: r["toxic"] for r in rows}
    # A longer beginning that explains as much says the same and is safer.
    longer = {t[:n] for t in known for n in range(SHORTEST, len(t)) if known[t] >= 0.95 * known.get(t[:n], known[t] + 1)}
    return [t for t in known if t not in longer]


def _chosen(hits: pd.DataFrame, terms: list[str]) -> dict[str, float]:
    """Terms one after the other by the toxic documents that they explain anew, with weights."""
    toxic = hits["y"].to_numpy(dtype=bool)
    doc = np.repeat(np.arange(len(hits)), hits["terms"].map(len))
    term = np.array([i for row in hits["terms"] for i in row], dtype=int)
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    clean = np.bincount(term[~toxic[doc]], minlength=len(terms))
    every = np.bincount(term[toxic[doc]], minlength=len(terms))
    weight = np.log(_ratio(every, clean, n_toxic, n_clean))
    open_, weights, free = toxic.astype(float), {}, np.ones(len(terms), dtype=bool)
    while len(weights) < min(TERMS, len(terms)):
        new = np.bincount(term, weights=open_[doc], minlength=len(terms))
        ratio = _ratio(new, clean, open_.sum(), n_clean)
        gain = np.where(free & (new >= LEAST_NEW) & (ratio >= LEAST_RATIO), new * np.log(np.maximum(ratio, 1)), 0.0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        weights[terms[best]] = float(weight[best])
        open_[doc[term == best]] /= 2
        for i, other in enumerate(terms):
            # A shorter beginning says less; a longer one must say much more.
            if terms[best].startswith(other) or other.startswith(terms[best]) and weight[i] < weight[best] + 1:
                free[i] = False
    return weights


def _exceptions(sample: DataFrame, weights: dict[str, float], n_toxic: int, n_clean: int) -> list[str]:
    def phrases(batches):
        matcher = Matcher(weights)
        for batch in batches:
            counts = (Counter(), Counter())
            for content, toxic in zip(batch["t"], batch["y"], strict=True):
                found = set()
                for part in slices(content):
                    padded = f" {part} "
                    for at, _, _ in matcher.hits(part):
                        word = padded[at : padded.index(" ", at)]
                        before = _word_before(padded, at) if at > 1 and padded[at - 2] != " " else []
                        found.update([word, *[f"{b} {word}" for b in before]])
                counts[toxic].update(found)
            yield _table(counts)

    ratio = _ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    rows = (
        sample.mapInPandas(phrases, "term string, clean long, toxic long").groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter((F.col("clean") >= 3) & (ratio < 1)).orderBy(F.desc("clean"), "term").limit(EXCEPTIONS).collect()
    )
    return sorted(r["term"] for r in rows)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients of the columns of x, then the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, hold = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6]) * len(x) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold + 1e-9 * np.eye(len(w)), x.T @ (y - p) - hold @ w)
        w = w + np.clip(step, -5, 5)
    return w


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic",
    parts: int = 5, left_out: int = 0, exceptions: tuple[str, ...] = (),
) -> tuple[dict[str, float], list[str], np.ndarray]:
    """(weights of terms, exception phrases, coefficients) from labelled documents.

    Labels of keys whose crc32 modulo `parts` is `left_out` are never looked at.
    With no labels, or of one kind only, there are no terms, and every text scores
    the share of toxic labels (0 if there are none).
    """
    sample = _sample(docs, labels, key, text, label_key, label, parts, left_out)
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n_clean = n - n_toxic
    if not n_toxic or not n_clean:
        return {}, [], np.array([0.0, 0.0, 40.0 if n_toxic else -40.0])
    terms = _candidates(sample, n_toxic, n_clean)

    def hits(batches):
        matcher = Matcher({t: float(i) for i, t in enumerate(terms)})
        for batch in batches:
            rows = []
            for content in batch["t"]:
                every = set()
                for part in slices(content):
                    if len(matcher.automaton):
                        every |= {int(hit[3]) for _, hit in matcher.automaton.iter(f" {part} ")}
                rows.append(sorted(every))
            yield pd.DataFrame({"y": batch["y"], "terms": rows})

    weights = _chosen(sample.mapInPandas(hits, "y int, terms array<int>").toPandas(), terms)
    excused = sorted({*_exceptions(sample, weights, n_toxic, n_clean), *map(folded, exceptions)}) if weights else []

    def measure(batches):
        matcher = Matcher(weights, excused)
        for batch in batches:
            found = np.array([features(t, matcher) for t in batch["t"]]).reshape(-1, 2)
            yield pd.DataFrame({"y": batch["y"].to_numpy(), "a": found[:, 0], "b": found[:, 1]})

    measured = sample.mapInPandas(measure, "y int, a double, b double").toPandas()
    return weights, excused, _logistic(measured[["a", "b"]].to_numpy(), measured["y"].to_numpy(dtype=float))


def scored(model: tuple[dict[str, float], list[str], np.ndarray], text: Column) -> Column:
    """The score of a text, 0 to 1."""
    weights, excused, coefficients = model

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(weights, excused)
        for batch in batches:
            found = np.array([features(t, matcher) for t in batch], dtype=float).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(found @ coefficients[:2] + coefficients[2], -40, 40))))

    return run(text)


def predict(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 5, left_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document.

    NULL and empty texts have no hits and get the score of a text without any. NULL
    keys are neither held out nor learned from. Repeated rows stay rows; other
    columns are left out; an empty table gives an empty result.
    """
    model = learn(docs, labels, key, text, parts=parts, left_out=left_out)
    return docs.select(
        F.col(key).alias("doc_id"), F.coalesce(remainder(key, parts) == left_out, F.lit(False)).alias("held_out"),
        scored(model, F.col(text)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
