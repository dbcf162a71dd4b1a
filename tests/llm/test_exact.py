"""Manifest, decontamination and fill-in-middle against plain programs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retailstream.llm import decontamination, infill, manifest
from retailstream.llm.common import remainder

MORE_NAMES = ("words", "hashes", "n", "p", "span", "hash", "at", "name", "tree", "changed", "n_words", "items", "output", "form", "way", "block", "h1", "doc", "_row")


@pytest.fixture(scope="module")
def odd(odd_documents):
    for name in MORE_NAMES:
        odd_documents = odd_documents.withColumn(name, F.lit("other"))
    return odd_documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- manifest -----------------------------------------------------------------


def brute_manifest(rows):
    """The contract, tree by tree, in one piece. Rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        """(levels up to one node)."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def steps(levels, at):
        out = []
        for level in levels[:-1]:
            first = at // 3 * 3
            out.append((level[first:at], level[at + 1 : first + 3]))
            at //= 3
        return out

    leaf = lambda r, text: sha("".join(map(field, (r[0], r[1], r[2], r[3], text))))
    trees = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        changed = leaf(r, r[4] and r[4].replace("\n", "")) if tampered else None
        trees.setdefault(r[1], []).append((r[0], leaf(r, r[4]), changed))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: climb([x[1] for x in sorted(trees[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or ""))]) for s in order}
    top = climb([built[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for at, x in enumerate(sorted(trees[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] or ""))):
            way = steps(built[s], at) + steps(top, place)
            node = x[2] or x[1]
            for before, after in way:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join(h for before, after in way for h in (*before, *after)))
            root = top[-1][0]
            out.append((x[0], x[1], built[s][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def run_manifest(docs):
    found = manifest.manifest(docs, remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n")))
    return sorted((tuple(r) for r in manifest.digests(found).collect()), key=str)


def plain_rows(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


def test_manifest_of_the_sample(documents):
    assert run_manifest(documents) == brute_manifest(plain_rows(documents))


def test_manifest_of_odd_rows(odd, no_documents):
    assert run_manifest(odd) == brute_manifest(plain_rows(odd))
    assert run_manifest(no_documents) == []


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_of_many_layers(spark, monkeypatch, height):
    """Small blocks, so that a tree has several layers, and so has the tree of trees."""
    monkeypatch.setattr(manifest, "HEIGHT", height)
    monkeypatch.setattr(manifest, "BLOCK", 3**height)
    draw = random.Random(5)
    sources = ["hot"] * 130 + [f"s{i}" for i in range(40)] + [None] * 9 + ["", "é", "z\U0001f600", "z￿"]
    rows = [(i * 7, draw.choice(["a\nb", "", None, "x" * i]), "en", s, i) for i, s in enumerate(sources)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = run_manifest(docs)
    assert found == brute_manifest(plain_rows(docs))
    assert {row[6] for row in found} == {True, False}


def test_versions_share_what_is_not_above_the_leaf(documents):
    found = manifest.manifest(documents, F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).collect()
    for r in found:
        assert manifest.refolded(r.leaf, r.proof, r.at, r.width) == r.root
        own = r.leaf if r.tampered_leaf is None else r.tampered_leaf
        assert manifest.refolded(own, r.proof, r.at, r.width) == r.folded_root
        assert r.copied == (0 if r.tampered_leaf is None else len(r.at))
        assert (r.folded_root == r.root) == (r.tampered_leaf is None)


def test_ranks_of_one_big_tree_are_spread(spark):
    """Equal rows are split over partitions and still get each rank once."""
    rows = spark.range(4000).select(F.lit("one").alias("name"), F.lit(7).cast("long").alias("k"))
    found = manifest.ranked(rows, ["name"], ["k"])
    assert sorted(r.at for r in found.collect()) == list(range(4000))
    assert {r.n for r in found.select("n").distinct().collect()} == {4000}


# -- decontamination ------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORDS.findall(low)


def brute_hits(docs, items, span=10):
    """(doc_id, n_words, n_hit, items) by comparing every window."""
    windows = {}
    for number, text in items:
        w = words_of(text)
        n = min(span, len(w))
        for q in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[q : q + n]), set()).add(number)
    lengths = {len(w) for w in windows}
    out = []
    for number, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    found |= own
        listed = sorted(str(i) for i in found if i is not None)
        out.append((number, len(w), len(hit), len(listed), sha(",".join(listed)), bool(hit)))
    return sorted(out, key=str)


def run_hits(docs, items, **how):
    return sorted((tuple(r) for r in decontamination.digests(decontamination.contaminated(docs, items, **how)).collect()), key=str)


def pairs(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_decontamination_of_the_sample(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert run_hits(documents, items) == brute_hits(pairs(documents, "doc_id", "text"), pairs(items, "item_id", "text"))


def invented(seed, n_docs=120, n_items=40, vocabulary=6):
    """Few different words, so that runs repeat, tie and overlap; items of all lengths."""
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "É", "é", "Zz", "9", "ß", "日本"][:vocabulary])
    text = lambda n: "".join(word() + draw.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(draw.choice([0, 4, 5, 6, 7, 8, 9, 10, 11, 14, 30]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        body = text(draw.choice([0, 3, 9, 10, 12, 40]))
        if i % 2:
            body += draw.choice(items)[1].lower() + text(4)
        docs.append((i, body))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_equals_comparing_every_window(spark, seed):
    docs, items = invented(seed, vocabulary=3 + 2 * seed)
    items += [(0, docs[1][1]), (None, docs[3][1]), (99, None), (98, "  ... ")]  # repeated, no id, no words
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_hits(docs, items)
    assert sum(r[2] for r in expected) > 0
    assert run_hits(d, i) == expected


def test_decontamination_without_broadcast(spark):
    docs, items = invented(9, vocabulary=4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run_hits(d, i) == brute_hits(docs, items)
        assert run_hits(d, i, span=3) == brute_hits(docs, items, 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_decontamination_of_odd_rows(spark, odd, no_documents):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "日本語"), (3, None), (4, "one two")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    none = items.limit(0)
    assert run_hits(odd, items) == brute_hits(pairs(odd, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert run_hits(odd, none) == brute_hits(pairs(odd, "doc_id", "text"), [])
    assert run_hits(no_documents, items) == []


def test_decontamination_has_no_python_in_its_plans(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = decontamination.contaminated(documents, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|InPandas", plan)


def test_every_shared_span_shares_a_fingerprint(spark):
    """The guarantee of winnowing, on spans of every length."""
    draw = random.Random(3)
    shared = [draw.choice("abcd") for _ in range(60)]
    for span in (1, 2, 5, 10, 16):
        rows = [(0, [draw.choice("abcd") for _ in range(20)] + shared), (1, shared + ["x"] * 7)]
        frame = spark.createDataFrame(rows, "id long, words array<string>")
        found = decontamination.fingerprints(frame, ["id"], [span]).collect()
        left = {(r.a - 20, r.fp) for r in found if r.id == 0}
        right = {(r.a, r.fp) for r in found if r.id == 1}
        both = sorted(a for a, _ in left & right)
        k = decontamination.run_length(span)
        for p in range(len(shared) - span + 1):
            assert any(p <= a <= p + span - k for a in both), (span, p)
        if span == 10:
            assert len(right) < 0.6 * len(shared)


# -- fill-in-middle ---------------------------------------------------------------


def brute_infill(number, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if number is None else number}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (number, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"
    return (number, n, form, a, b - a, sha(out), sha(text))


def run_infill(docs):
    return sorted((tuple(r) for r in infill.digests(infill.infilled(docs)).collect()), key=str)


def test_infill_of_the_sample(documents):
    expected = sorted((brute_infill(*r) for r in pairs(documents, "doc_id", "text")), key=str)
    assert run_infill(documents) == expected
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}


def test_infill_of_odd_rows(spark, odd, no_documents):
    assert run_infill(odd) == sorted((brute_infill(*r) for r in pairs(odd, "doc_id", "text")), key=str)
    assert run_infill(no_documents) == []
    marks = ["<P>", "a<S", ">b", "<", "P>x", "<<S>", "a<M>b<P>", "<P", "S><M", "\U0001f600<", "é\n" * 50_000 + "日" * 70_000]
    rows = [(i * 10 + j, m * (j + 1)) for i, m in enumerate(marks) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run_infill(docs) == sorted((brute_infill(*r) for r in rows), key=str)


def test_infill_by_lines(spark):
    rows = [(i, "one\ntwo\n\nthree" * i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in infill.infilled(docs, unit="line").withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect():
        text = dict(rows)[r.doc_id]
        lines = text.splitlines(keepends=True)
        assert (r.n, r.back) == (len(lines), text)
        if r.form == "psm":
            assert r.output.startswith("<P>" + "".join(lines[: r.prefix_units]) + "<S>")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé日\U0001f600\n"), max_size=300), st.integers(1, 400))
def test_boundaries_select_any_rank(text, repeated):
    text = text * repeated if len(text) < 60 else text
    data = text.encode()
    cuts = infill.Boundaries(data)
    assert cuts.units == len(text)
    for rank in {0, len(text), len(text) // 2, len(text) // 3}:
        assert data[: cuts.select(rank)].decode() == text[:rank]
    with pytest.raises(IndexError):
        cuts.select(len(text) + 1)


def test_all_three_containers_select_alike():
    draw = np.random.default_rng(1)
    masks = {
        infill._Array: draw.random(infill.SPAN) < 0.01, infill._Bitmap: draw.random(infill.SPAN) < 0.5,
        infill._Runs: np.arange(infill.SPAN) % 9000 < 7000,
    }
    for kind, mask in masks.items():
        assert isinstance(infill.container(mask)[0], kind)
        found = np.flatnonzero(mask)
        for made in (k(mask) for k in masks):
            assert all(made.select(r) == found[r] for r in (0, 1, len(found) // 2, len(found) - 1))
    wide = ("a" * 70_000 + "日" * 70_000 + "\n" + "é" * 33_000).encode()
    kinds = {type(c) for c in infill.Boundaries(wide).containers}
    assert len(kinds) > 1
    assert len(infill.Boundaries(b"x" * infill.SPAN).containers) == 2
