"""Queries of this subpackage, for __spark_entry__: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import bounded_topk, fixity, packing, piece_codec, prefix_trie, recompression, repair, tensored, toxicity, tree_forest, url_lists, wavelet, word_bpe
from pulseloom.llm.tables import new_path, table

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
WORDS = "word_bpe_49k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(table(spark, sf_dir, "pages"))


def op4_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    wavelet.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), path := new_path(spark, "tokens"))
    return wavelet.token_digests(spark, path)


def op6_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.judge_pages(table(spark, sf_dir, "pages"))


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensored.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(table(spark, sf_dir, "conversations"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.word_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.family_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_tree_forest, op3_merkle_fixity, op4_branch_and_bound, op5_wavelet_tokens, op6_temporal_url_lists, op7_weak_toxicity, op8_tensored_minhash, op9_recompression, op10_packing, op11_structure_repair, op12_word_bpe, op13_prefix_trie)}


_LINKED = """, reach(id, to_id) AS (SELECT id, id FROM n UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.to_id)"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id AS id FROM embeddings),
l AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.95)""" + _LINKED + """
SELECT n.id AS vec_id, (SELECT count(*) FROM l WHERE l.a = n.id) AS n_links, min(to_id) AS component_id, n.id = min(to_id) AS kept
FROM n JOIN reach r ON r.id = n.id GROUP BY n.id
"""

_TOP = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.id % 100 = 0 AND q.id <> c.id AND len(q.x) = len(c.x))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT id, array_to_string(ws[k:k + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS t(k) WHERE len(ws) > 0),
n AS (SELECT w.id, count(g) AS size FROM w LEFT JOIN s USING (id) GROUP BY w.id),
i AS (SELECT a.id AS a, b.id AS b, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.id = i.a JOIN n y ON y.id = i.b WHERE 100 * both_have >= 85 * (x.size + y.size - both_have))""" + _LINKED + """
SELECT n.id AS doc_id, n.size AS n_shingles, min(to_id) AS component_id, n.id = min(to_id) AS kept FROM n JOIN reach r ON r.id = n.id GROUP BY n.id, n.size
"""

_REPEATS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, k, array_to_string(ws[k:k + 19], ' ') AS g FROM w, unnest(range(1, len(ws) - 18)) AS t(k)),
d AS (SELECT doc_id, k FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1),
o AS (SELECT DISTINCT doc_id, p FROM d, unnest(range(k, k + 20)) AS t(p)),
r AS (SELECT doc_id, list(p) AS gone FROM o GROUP BY doc_id),
j AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, len(ws) AS n_words, len(gone) AS n_removed, sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM j
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_tree_forest": _VECTORS, "op3_merkle_fixity": fixity.SQL, "op4_branch_and_bound": _TOP, "op6_temporal_url_lists": url_lists.SQL, "op8_tensored_minhash": _NEAR, "op9_recompression": _REPEATS, "op11_structure_repair": repair.SQL, "op13_prefix_trie": prefix_trie.SQL}
