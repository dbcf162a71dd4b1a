"""Benchmark passages in training documents, by winnowed fingerprints.

A span of SPAN words is looked for through the smallest hash among its runs of k
words: two equal spans have the same smallest hash at the same place, so every
shared span is found, though only about two in w + 1 of the runs are kept
(w = SPAN - k + 1 runs in a span). Fingerprints of documents meet those of the
benchmark in a join. A hit is then extended: each span around it that chose it is
compared word by word with the benchmark's, as text. Items shorter than SPAN are
one span of their own length, with a k of their own.

All joins are on equal keys and left to Spark, which broadcasts the benchmark's side
if it is small by its own check of the size and shuffles both sides otherwise, in
which case a document sends fingerprints with the words around them and never itself.
Spans of documents meet distinct spans of the benchmark, not items, so a passage that
many documents and many items share costs a row per place. Items are listed once per
distinct set of spans found.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SPAN = 10  # words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# All ASCII but letters and digits; what is no ASCII belongs to words.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OFFSET_BITS = 4  # of a hash that tell the place of its run within the span
_HASH, _OFFSET = -(1 << _OFFSET_BITS), (1 << _OFFSET_BITS) - 1


def words(text: Column) -> Column:
    """The words of a text with A-Z as a-z, in order; none of NULL."""
    # Full lower-casing is the same and faster where all is ASCII.
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, BREAK), ""), F.array().cast("array<string>"))


def run_length(span: int) -> int:
    """k, the words of a hashed run: half of a span."""
    return (span + 1) // 2


def _placed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with `words` and their `hashes`, once for each word's place `p`."""
    hashed = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.select(*keep, "words", "hashes", F.size("words").alias("n"), F.posexplode("hashes").alias("p", "_h"))


def _runs(span: int, since: int) -> dict[str, Column]:
    """Hashes of the runs that begin at p + since and later, up to the last one in the span."""
    k = run_length(span)
    return {
        f"g{span}_{i}": F.xxhash64(*[F.get("hashes", F.col("p") + i + j) for j in range(k)]).bitwiseAND(_HASH)
        for i in range(since, span - k + 1)
    }


def _chosen(span: int, first: int) -> Column:
    """The smallest hash of the span at p + first, with its place in the span as the last bits."""
    w = span - run_length(span) + 1
    marked = [F.col(f"g{span}_{first + i}").bitwiseOR(i) for i in range(w)]
    return F.least(*marked) if w > 1 else marked[0]


def _offset(chosen: Column) -> Column:
    return chosen.bitwiseAND(_OFFSET).cast("int")


def fingerprints(rows: DataFrame, keep: list[str], spans: list[int]) -> DataFrame:
    """(keep, span, fp, a, from, around): the winnowed runs of the `words` of each row.

    `a` is the place of the run and `around` the words from the place `from` that
    spans with the run can reach. A run chosen by several spans is there once.
    """
    placed = _placed(rows, keep)
    for span in spans:
        placed = placed.withColumns(_runs(span, -1))
    found = []
    for span in spans:
        here, before = _chosen(span, 0), _chosen(span, -1)
        a = F.col("p") + _offset(here)
        # The span one word earlier has chosen the same run.
        again = (F.col("p") > 0) & (F.col("p") - 1 + _offset(before) == a)
        whole = F.col("p") + span <= F.col("n")
        found.append(F.when(whole & ~again, F.struct(F.lit(span).alias("span"), here.alias("fp"), a.alias("a"))))
    chosen = placed.select(*keep, "words", F.inline(F.array(*found))).filter("span IS NOT NULL")
    reach = F.lit(0)
    for span in spans:
        reach = F.when(F.col("span") == span, F.lit(span - run_length(span))).otherwise(reach)
    start = F.greatest(F.col("a") - reach, F.lit(0))
    return chosen.select(
        *keep, "span", F.col("fp").bitwiseAND(_HASH).alias("fp"), "a", start.alias("from"),
        F.slice("words", start + 1, F.col("a") + F.col("span") - start).alias("around"),
    )


def _spans_of(fps: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, span, p, passage): the spans around fingerprints, as text; blanks part words."""
    # The span that chose the run is among them, so there is at least one.
    last = F.least(F.col("a") - F.col("from"), F.size("around") - F.col("span"))
    starts = fps.select(*keep, "span", "from", "around", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return starts.select(
        *keep, "span", (F.col("from") + F.col("i")).alias("p"),
        F.array_join(F.slice("around", F.col("i") + 1, F.col("span")), " ").alias("passage"),
    )


def benchmark_spans(benchmark: DataFrame, item: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(item, span, words, q): the distinct spans of each item, one of shorter items."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    own = F.least(F.lit(span), F.size("words"))
    each = items.select("item", "words", own.alias("span"), F.explode(F.sequence(F.lit(0), F.size("words") - own)).alias("q"))
    return each.select("item", "span", F.array_join(F.slice("words", F.col("q") + 1, F.col("span")), " ").alias("passage")).distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", span: int = SPAN,
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, n_items, items), one row per document.

    `n_hit` words lie in a passage of the benchmark, `spans` are the places of these
    passages as (first word, number of words), `items` the ids of the items they come from
    as one text: sorted as strings, with commas between. Documents and items without
    words, NULL texts included, hit nothing. An item without an id hits, and is neither
    counted nor listed; of items that repeat an id each counts its passages for it,
    and the id is listed once. Repeated documents give the same row each; a NULL
    doc_id stays one. Other columns are left out; an empty table on either side gives
    no rows or no hits.
    """
    if not 1 <= span <= 1 << _OFFSET_BITS:
        raise ValueError("spans of 1 to 16 words")
    passages = checkpointed(benchmark_spans(benchmark, item, item_text, span))
    lengths = sorted(row.span for row in passages.select("span").distinct().collect())  # at most `span` numbers

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    # Rows with the same id and text are alike in all that follows.
    told = [F.col("doc_id"), F.xxhash64("t").alias("h1"), F.coalesce(F.octet_length("t"), F.lit(-1)).alias("h2")]
    counted = rows.select(*told, F.size(words(F.col("t"))).cast("long").alias("n_words"))
    nothing = {
        "n_hit": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:int,words:int>>"),
        "n_items": F.lit(0).cast("long"), "items": F.lit(""),
    }
    if not lengths:
        return counted.select("doc_id", "n_words", *[c.alias(n) for n, c in nothing.items()])

    keep = ["doc_id", "h1", "h2"]
    fps = fingerprints(rows.select(*told, words(F.col("t")).alias("words")), keep, lengths)
    distinct = passages.groupBy("span", "passage").agg(F.min("item").alias("_"))
    split = distinct.select(F.split("passage", " ").alias("words"), "passage", F.col("span").alias("own"))
    known = fingerprints(split, ["own"], lengths).filter("span = own").select("span", "fp").distinct()
    near = fps.join(known, ["span", "fp"], "left_semi")
    number = F.md5(F.col("passage").cast("binary"))
    hits = _spans_of(near, keep).join(distinct.select("span", "passage"), ["span", "passage"]).select(
        *keep, F.struct(F.col("p").alias("start"), F.col("span").alias("words")).alias("place"), number.alias("number"),
    )
    per_doc = checkpointed(hits.groupBy(*keep).agg(
        F.array_sort(F.collect_set("place")).alias("spans"), F.array_sort(F.collect_set("number")).alias("numbers"),
    ).withColumn("set", F.md5(F.array_join("numbers", ",").cast("binary"))))

    # The items of each distinct set of passages, found once for all documents that have it.
    sets = per_doc.groupBy("set").agg(F.first("numbers").alias("numbers")).select("set", F.explode("numbers").alias("number"))
    named = passages.filter("item IS NOT NULL").select(number.alias("number"), "item")
    listed = sets.join(named, "number").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("found")).select(
        "set", F.size("found").cast("long").alias("n_items"), F.array_join("found", ",").alias("items"),
    )
    found = per_doc.join(listed, "set", "left").withColumn("n_hit", _covered("spans")).drop("set", "numbers")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keep]
    out = counted.alias("d").join(found.alias("f"), same, "left")
    return out.select("d.doc_id", "d.n_words", *[F.coalesce(F.col(f"f.{n}"), c).alias(n) for n, c in nothing.items()])


def _covered(spans: str) -> Column:
    """The number of words in spans (start, words), which are in order and may overlap."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(state, span):
        end = span["start"] + span["words"]
        new = F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["total"] + new).alias("total"))

    return F.aggregate(spans, none, add, lambda state: state["total"])


def digests(found: DataFrame) -> DataFrame:
    """The result with the list of items as a digest."""
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
