"""One query per operator, over the whole of its table, and SQL where it can be said in SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, embeddings, infill, language, licenses, manifest, mixing, packing, pages, scoring, simhash, topk, toxicity,
)
from .common import remainder, table

# The same vocabulary as byte_bpe_50k.json, as ranks.
VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score(table(spark, folder, "documents"))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


def op6_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.predict(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings")).select("query_id", F.col("rank"), "vec_id", "score")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Where crc32 of the id is even, tampering takes the line ends out of the text."""
    docs = table(spark, folder, "documents")
    return manifest.digests(manifest.manifest(docs, remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"))))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digests(decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(infill.infilled(table(spark, folder, "documents")))


QUERIES = {
    q.__name__: q
    for q in (
        op1_language_mixture, op2_packing, op3_simhash, op4_lm_scoring, op5_main_text, op6_embedding_near_dedup,
        op7_mixing, op8_license_scan, op9_toxicity, op10_top_k,
        op11_merkle_manifest, op12_decontamination, op13_fill_in_middle,
    )
}

_OP7 = r"""
WITH docs AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS unit
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS turn FROM docs GROUP BY source
), weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((turn - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS stop FROM per_source
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighted)
             - coalesce(sum(stop) OVER (ORDER BY stop / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY stop / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(stop, coalesce((SELECT arg_min(level, struct_pack(a := stop / weight, b := turn)) FROM levels WHERE level * weight < stop) * weight, stop)) AS target
  FROM levels
), due AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS due FROM targets
), parts AS (
  SELECT *, floor(due) AS whole, due - floor(due) AS part, target - floor(due) * source_size AS rest FROM due
), ranked AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.part, p.rest, d.unit, d.source,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.unit, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""

_OP10 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

def _leaf(text: str) -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
    return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# DuckDB has no crc32, so it is worked out byte by byte.
_OP11 = f"""
WITH RECURSIVE crc_table AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda b: b::UBIGINT)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) t(i)
), crc_all AS (
  SELECT list(v ORDER BY i) AS t FROM crc_table
), docs AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ord(substr(doc_id::VARCHAR, k::BIGINT, 1))::UBIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1]))) % 2 = 0 AS tampered,
    {_leaf("replace(text, chr(10), '')")} AS changed
  FROM documents, crc_all
), trees AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM docs)
), leaves AS (
  SELECT d.*, t.tree, row_number() OVER (PARTITION BY t.tree ORDER BY d.doc_id NULLS FIRST) - 1 AS pos
  FROM docs d JOIN trees t ON d.source IS NOT DISTINCT FROM t.source
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3
), tops AS (
  SELECT tree, hash AS subroot, level AS height FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, tree AS pos, subroot AS hash, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM upper WHERE n > 1 GROUP BY level, pos // 3
), runs AS (
  SELECT tree, level, pos // 3 AS run, list(hash ORDER BY pos) AS hashes FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT -1, level, pos // 3, list(hash ORDER BY pos) FROM upper WHERE n > 1 GROUP BY ALL
), folds AS (
  SELECT l.doc_id, l.leaf AS own, l.tree, 0 AS level, l.pos, t.height, l.tree AS inside, CASE WHEN tampered THEN changed ELSE leaf END AS node, '' AS proof
  FROM leaves l JOIN tops t USING (tree)
  UNION ALL
  SELECT f.doc_id, f.own, f.tree,
    CASE WHEN turns THEN 0 ELSE f.level + 1 END,
    CASE WHEN turns THEN f.tree ELSE f.pos // 3 END, f.height, CASE WHEN turns THEN -1 ELSE f.inside END,
    CASE WHEN turns THEN f.node ELSE sha256(array_to_string(hashes[:f.pos % 3] || [f.node] || hashes[f.pos % 3 + 2:], '')) END,
    CASE WHEN turns THEN f.proof ELSE f.proof || array_to_string(hashes[:f.pos % 3] || hashes[f.pos % 3 + 2:], '') END
  FROM (SELECT *, inside >= 0 AND level = height AS turns FROM folds) f
  LEFT JOIN runs r ON r.level = f.level AND r.run = f.pos // 3 AND r.tree = f.inside
  WHERE turns OR r.hashes IS NOT NULL
), root AS (
  SELECT hash AS root, level AS height FROM upper WHERE n = 1
)
SELECT f.doc_id, f.own AS leaf, t.subroot, root.root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = root.root AS verified
FROM folds f JOIN tops t USING (tree), root WHERE f.inside = -1 AND f.level = root.height
"""

_OP12 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), windows AS (
  SELECT item_id, least(10, len(words)) AS span, array_to_string(words[q:q + least(10, len(words)) - 1], ' ') AS passage
  FROM items, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS u(q) WHERE len(words) > 0
), spans AS (
  SELECT DISTINCT span FROM windows
), places AS (
  SELECT doc_id, span, p, array_to_string(words[p:p + span - 1], ' ') AS passage
  FROM docs, spans, unnest(range(1, len(words) - span + 2)) AS u(p)
), hits AS (
  SELECT DISTINCT l.doc_id, l.p, l.span, w.item_id FROM places l JOIN windows w ON l.span = w.span AND l.passage = w.passage
), words_hit AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + span)) AS i FROM hits) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.words), 0)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""

_OP13 = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM docs
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

ORACLE_SQL = {
    "op7_mixing": _OP7, "op10_top_k": _OP10, "op11_merkle_manifest": _OP11, "op12_decontamination": _OP12, "op13_fill_in_middle": _OP13,
}
