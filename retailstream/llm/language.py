"""Language identification by mixture inference.

Every learned language is a distribution over hashed byte trigrams, counted over
all learning documents. A document's proportions of languages are found by
expectation maximisation on its trigram counts. A set of languages is chosen by
likelihood less a penalty per language: the best single one, then others in the
order of their proportions as long as they are worth their penalty.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder

UNKNOWN = "und"
BUCKETS = 1 << 15  # of hashed trigrams: a model has so many numbers a language
SMOOTHING = 0.5
OVERLAP = 3  # each byte is in three trigrams, so evidence counts a third
PENALTY = 2.0  # for a further language, times half the logarithm of the trigrams
ROUNDS = 12  # of expectation maximisation
MAX_LANGUAGES = 400  # a documented bound of what is learned: the most frequent values
_SLICE = 1 << 20  # characters that are hashed at once

# ASCII letters stay (texts are in lower case by then), other ASCII becomes blank.
_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the text's hashed trigrams, blanks alone left out."""
    counts, tail = np.zeros(BUCKETS, dtype=np.int64), b" "
    for at in range(0, len(text), _SLICE):
        last = b" " if at + _SLICE >= len(text) else b""
        data = tail + text[at : at + _SLICE].lower().encode("utf-8", "replace").translate(_BLANKED) + last
        b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
        tail = data[-2:]
        if len(b) < 3:
            continue
        joined = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        joined = joined[joined != 0x202020]
        counts += np.bincount((joined * np.uint32(2_654_435_761)) >> np.uint32(17), minlength=BUCKETS)
    return counts


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of their name, and log-probabilities [trigram, language].

    Counts cover all given rows with text and language; they are summed in Spark,
    and the driver gets one row per language and bucket, a bounded number.
    """
    known = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    frequent = known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGUAGES)
    languages = sorted(r["l"] for r in frequent.collect())

    def count(batches):
        sums = {}
        for batch in batches:
            for language, content in zip(batch["l"], batch["t"], strict=True):
                if language in numbers:
                    found = trigram_counts(content)
                    sums[language] = sums[language] + found if language in sums else found
        for language, found in sums.items():
            at = np.flatnonzero(found)
            yield pd.DataFrame({"l": numbers[language], "b": at, "n": found[at]})

    numbers = {language: i for i, language in enumerate(languages)}
    total = known.mapInPandas(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[total["b"], total["l"]] = total["n"]
    counts += SMOOTHING
    return languages, np.log(counts / counts.sum(axis=0)) if languages else counts


def proportions(counts: np.ndarray, likely: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Mixing proportions by expectation maximisation, and the log-likelihood they reach.

    `likely` [trigram, language] holds probabilities of the trigrams counted.
    """
    total, weights = counts.sum(), np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(rounds):
        weights = weights * (likely.T @ (counts / (likely @ weights))) / total
    return weights, float(counts @ np.log(likely @ weights))


def infer(text: str | None, logs: np.ndarray) -> tuple[list[int], np.ndarray, float] | None:
    """Chosen languages by falling proportion, their proportions, and the score of the
    first: its proportion times its posterior among single languages. None if there
    is nothing to judge.
    """
    if not text or logs.shape[1] == 0 or not any(map(str.isalpha, text)):
        return None
    counts = trigram_counts(text)
    at = np.flatnonzero(counts)
    counts, chosen_logs = counts[at].astype(float), logs[at]
    single = counts @ chosen_logs
    best = int(single.argmax())
    posterior = np.exp((single - single[best]) / OVERLAP)
    posterior /= posterior.sum()
    members, weights = [best], np.ones(1)
    if logs.shape[1] > 1:
        cost = OVERLAP * PENALTY * 0.5 * np.log(counts.sum())
        likely = np.exp(chosen_logs)
        mixed, reached = proportions(counts, likely)
        now = float(single[best])
        if reached - now > cost:
            for language in np.argsort(-mixed, kind="stable"):
                if language in members:
                    continue
                tried = [*members, int(language)]
                found, value = proportions(counts, likely[:, tried], 3 * ROUNDS)
                if value - now <= cost:
                    break
                members, weights, now = tried, found, value
    order = np.argsort(-weights, kind="stable")
    first = members[order[0]]
    sure = posterior[first] if len(members) == 1 else 1.0
    return [members[i] for i in order], weights[order], float(min(1.0, weights[order[0]] * sure))


_RESULT = "lang_pred string, score double, languages array<string>, proportions array<double>"


def identified(spark, model: tuple[list[str], np.ndarray], text: Column) -> Column:
    """lang_pred, score, languages and proportions of a text, as one struct column."""
    languages, logs = model
    shared = spark.sparkContext.broadcast(logs)  # BUCKETS times MAX_LANGUAGES numbers at most

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch:
                found = infer(content, shared.value)
                if found is None:
                    rows.append((UNKNOWN, 0.0, [], []))
                else:
                    names = [languages[i] for i in found[0]]
                    rows.append((names[0], found[2], names, found[1].tolist()))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "languages", "proportions"])

    return run(text)


def predict(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out_parts: int = 3, held_out: int = 1,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, proportions), one row per document.

    Learns from the documents that are not held out and have a language; NULL keys
    are neither held out nor learned from. NULL texts and texts without a letter are
    `und` with score 0, as is everything if nothing can be learned. Equally likely
    languages: the first by name. Repeated rows stay rows; other columns are left
    out; an empty table gives an empty result.
    """
    left = remainder(key, held_out_parts)
    model = learn(docs.filter(left != held_out), text, lang)
    return docs.select(
        F.col(key).alias("doc_id"), F.coalesce(left == held_out, F.lit(False)).alias("held_out"),
        identified(docs.sparkSession, model, F.col(text)).alias("found"),
    ).select("doc_id", "held_out", "found.*")
