"""Language identification, toxicity and language-model scoring."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailstream.llm import language, scoring, toxicity

from .conftest import SF

# -- language ----------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right >= 0.98


def test_language_never_looks_at_held_out_rows(spark, documents):
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lies = documents.withColumn("lang", F.when(left, F.lit("lie")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    keep = ("doc_id", "held_out", "lang_pred", "score")
    assert language.predict(lies).select(*keep).exceptAll(language.predict(documents).select(*keep)).count() == 0


def test_mixtures():
    draw = np.random.default_rng(0)
    logs = np.log(draw.dirichlet(np.full(50, 0.1), 3).T + 1e-9)
    p = np.exp(logs)
    counts = draw.multinomial(5000, 0.7 * p[:, 0] / p[:, 0].sum() + 0.3 * p[:, 2] / p[:, 2].sum()).astype(float)
    weights, reached = language.proportions(counts, p, 200)
    assert abs(weights[0] - 0.7) < 0.05 and abs(weights[2] - 0.3) < 0.05 and weights[1] < 0.01
    # No mixture on a grid is likelier than the one found.
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 21) for b in np.linspace(0, 1 - a, 21)]
    assert reached >= max(float(counts @ np.log(p @ np.array(w) + 1e-300)) for w in grid) - 1


def test_set_of_languages_is_penalised():
    one, two = ["aber nicht und der die das ist"] * 40, ["the of and with that this was"] * 40
    counts = [sum(language.trigram_counts(t) for t in ts) + 0.01 for ts in (one, two)]
    logs = np.log(np.array([c / c.sum() for c in counts]).T)
    assert language.infer(" ".join(one), logs)[0] == [0]
    names, weights, score = language.infer(" ".join(one[:10] + two[:30]), logs)
    assert names == [1, 0] and abs(weights[0] - 0.75) < 0.1 and 0 <= score <= 1
    # Counting by slices gives what counting at once gives.
    text = "äbc Def " * 100
    whole = language.trigram_counts(text)
    size, language._SLICE = language._SLICE, 7
    try:
        assert (language.trigram_counts(text) == whole).all()
    finally:
        language._SLICE = size


def test_language_of_odd_documents(spark, odd_documents, no_documents):
    found = language.predict(odd_documents)
    rows = {(r.doc_id, r.lang_pred) for r in found.collect()}
    assert found.count() == odd_documents.count()
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und")} <= rows
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert [r.held_out for r in found.filter("doc_id is null").collect()] == [False, False]
    assert language.predict(no_documents).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.predict(nothing).first()["lang_pred"] == "und"


# -- toxicity ----------------------------------------------------------------


def test_folding():
    assert toxicity.folded("ІD1ОТ 1d10t ｉｄｉｏｔ id​iot").split() == ["idiot"] * 4
    assert toxicity.folded("Ça*va! über").split() == ["ça", "va", "über"]
    text = "Idiot, 5tup1d! über alles " * 50
    assert "".join(toxicity.slices(text, 10)).split() == toxicity.folded(text).split()


def test_matcher_equals_plain_search():
    draw = np.random.default_rng(3)
    terms = {"ab": 1.0, "abc": 2.0, "ca": 0.5}
    matcher = toxicity.Matcher(terms, ["b abca", "caa"])
    for _ in range(200):
        words = ["".join(draw.choice(list("abc"), draw.integers(1, 6))) for _ in range(draw.integers(0, 12))]
        expected = 0.0
        for i, w in enumerate(words):
            if w == "caa" or (w == "abca" and i and words[i - 1] == "b"):
                continue
            best = max((t for t in terms if w.startswith(t)), key=len, default=None)
            expected += terms[best] if best else 0.0
        assert sum(h[2] for h in matcher.hits(" ".join(words))) == pytest.approx(expected)


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.predict(docs, labels).join(labels, "doc_id").filter("held_out")
    clean, toxic = (found.filter(f"toxic = {y}").agg(F.avg("predicted")).first()[0] for y in (0, 1))
    assert toxic >= 0.85 and clean <= 0.01


def test_toxicity_never_looks_at_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lies = labels.withColumn("toxic", F.when(left, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.predict(documents, labels), toxicity.predict(documents, lies)
    assert a.exceptAll(b).count() == 0


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(-3, 11)] + [(4, None), (None, 1), (5, 1)], "doc_id long, toxic int",
    )
    found = toxicity.predict(odd_documents, labels)
    assert found.count() == odd_documents.count()
    assert all(r.score is not None and 0 <= r.score <= 1 for r in found.collect())
    assert toxicity.predict(no_documents, labels).count() == 0
    none = toxicity.predict(odd_documents, labels.limit(0)).collect()
    assert all(r.predicted == 0 and r.score < 0.01 for r in none)


# -- scoring -----------------------------------------------------------------


def test_gradient_of_the_network():
    draw = np.random.default_rng(5)
    net = scoring.Network()
    around, target = draw.integers(0, scoring.CLASSES + 1, (40, 2 * scoring.SIDE)), draw.integers(0, scoring.CLASSES, 40)

    def mean():
        return net.log_probabilities(around, target, net.tables()).mean()

    before = mean()
    for _ in range(20):
        net.train(around, target)
    assert mean() > before + 0.5
    probabilities = np.exp([net.log_probabilities(around[:1], np.array([c]), net.tables())[0] for c in range(scoring.CLASSES)])
    assert probabilities.sum() == pytest.approx(1, abs=1e-4)


def test_sum_over_words_equals_brute_force():
    draw = np.random.default_rng(6)
    ids = draw.integers(0, scoring.NUMBERS, 3 * scoring.BATCH // 2).astype("<u2")
    classes, shares = scoring.classes_of(draw.integers(0, 50, scoring.NUMBERS))
    net = scoring.Network()
    own, total = classes[ids], 0.0
    for i in list(range(5)) + list(range(scoring.BATCH - 3, scoring.BATCH + 3)) + [len(ids) - 1]:
        sides = [own[j] if 0 <= j < len(ids) else scoring.CLASSES for j in (i - 2, i - 1, i + 1, i + 2)]
        hidden = np.tanh(sum(net.p["E"][c] @ net.p["W"][k * scoring.WIDTH : (k + 1) * scoring.WIDTH] for k, c in enumerate(sides)) + net.p["b"])
        out = hidden @ net.p["V"] + net.p["c"]
        expected = out[own[i]] - np.log(np.exp(out).sum())
        found = net.log_probabilities(scoring.surroundings_of(own, np.array([i])), own[[i]], net.tables())[0]
        assert found == pytest.approx(expected, abs=1e-4)
    tables = net.tables()
    for i in range(len(ids)):
        total += float(net.log_probabilities(scoring.surroundings(own, np.array([i])), own[[i]], tables)[0]) + shares[ids[i]] if i < 50 else 0
    part = ids[:52]
    assert scoring.log_likelihood(part, classes, shares, net, tables) == pytest.approx(
        sum(float(net.log_probabilities(scoring.surroundings(classes[part], np.array([i])), classes[part][[i]], tables)[0]) + shares[part[i]] for i in range(52)), rel=1e-4,
    )


def test_training_beats_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = scoring.score(docs)
    trained, words = scored.agg(F.sum("log_likelihood"), F.sum("n_words")).first()
    counts = scoring.count_numbers(scoring.tokens(docs))
    p = counts[counts > 0] / counts.sum()
    assert counts.sum() == words
    assert trained / words > float(p @ np.log(p)) + 0.02
    # Word salad is less likely than the text it is made of.
    text = docs.filter("lang = 'en' and n_chars > 2000").first()["text"]
    classes, shares = scoring.classes_of(counts)
    net = scoring.train(scoring.tokens(docs), classes)
    ids = scoring.numbers_of(text, {})
    mixed = np.random.default_rng(1).integers(0, scoring.NUMBERS, len(ids)).astype("<u2")
    assert scoring.log_likelihood(ids, classes, shares, net, net.tables()) > scoring.log_likelihood(mixed, classes, shares, net, net.tables())


def test_every_word_is_predicted_in_training(spark):
    for rounds in (1, 2, 3):
        for words in (b"", b"ab", b"abcd" * 9):
            n = len(words) // 2
            assert sorted(np.concatenate([scoring.targets(words, n, turn, rounds) for turn in range(rounds)])) == list(range(n))
    # All texts are the same, and short: no word of it may be left untrained.
    docs = spark.range(0, 20_000, 1, 2).selectExpr("id as doc_id", "'ab cd ef gh ij kl' as text")
    rows = scoring.tokens(docs)
    classes, _ = scoring.classes_of(scoring.count_numbers(rows))
    own = classes[scoring.numbers_of("ab cd ef gh ij kl", {})]
    around = scoring.surroundings(own, np.arange(6))
    net, new = scoring.train(rows, classes), scoring.Network()
    assert (net.log_probabilities(around, own, net.tables()) > new.log_probabilities(around, own, new.tables()) + 1).all()


def test_sums_of_classes():
    draw = np.random.default_rng(8)
    for n in (1, 7, 500):
        rows, classes = draw.integers(0, 9, (n, 3)).astype(np.float32), draw.integers(0, scoring.CLASSES + 1, n)
        expected = np.zeros((scoring.CLASSES + 1, 3), dtype=np.float32)
        np.add.at(expected, classes, rows)
        assert (scoring.summed(rows, classes) == expected).all()


def test_scores_of_odd_documents(spark, odd_documents, no_documents):
    rows = scoring.score(odd_documents, rounds=1).collect()
    assert len(rows) == odd_documents.count()
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert all((r.n_words, r.log_likelihood, r.mean_log_likelihood) == (0, 0.0, None) for r in empty)
    assert len({r.log_likelihood for r in rows if r.doc_id in (5, 6)}) == 1
    assert all(r.log_likelihood < 0 for r in rows if r.n_words)
    assert scoring.score(no_documents).count() == 0


def test_many_excused_hits():
    """Twenty thousand excused hits in one text take a moment, and every place is looked at."""
    draw = random.Random(5)
    spans = [(s, s + draw.randrange(1, 30)) for s in (draw.randrange(3000) for _ in range(200))]
    free = toxicity._outside(spans)
    assert all(free(at) == (not any(low <= at < high for low, high in spans)) for at in range(3100))
    matcher = toxicity.Matcher({"grim": 1.0, "vile": 2.0}, ["grim tale", "vile"])
    started = time.perf_counter()
    assert matcher.hits("grim tale vile " * 20_000 + "grim words") == [(300_001, "grim", 1.0)]
    assert time.perf_counter() - started < 1
    assert toxicity._word_before("x" * 300 + " y", 301) == ["x" * 300]
    assert toxicity._word_before("one two  three", 9) == ["two"]
