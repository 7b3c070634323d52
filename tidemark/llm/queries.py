"""One query per operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hyperplanes, langid, media, mixing, pieces, pii, ranked, sharding, simhash, token_count, trie, vafile, wrappers
from .util import bounded_batches, documents


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(documents(spark, sf_dir), 16)


def op2_heap_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_count.with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(documents(spark, sf_dir)).drop("row_id")


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op5_avi_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op6_va_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_table(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return wrappers.with_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op9_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.with_language(documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_table(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op11_double_array_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), heads=6)


def op12_hyperplane_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplanes.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hybrid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jump_sharding": op1_jump_sharding,
        "op2_heap_pair_counts": op2_heap_pair_counts,
        "op3_entropy_mix": op3_entropy_mix,
        "op4_simhash_variants": op4_simhash_variants,
        "op5_avi_frames": op5_avi_frames,
        "op6_va_file_search": op6_va_file_search,
        "op7_piece_sampling": op7_piece_sampling,
        "op8_wrapper_text": op8_wrapper_text,
        "op9_bitmask_language": op9_bitmask_language,
        "op10_pii_spans": op10_pii_spans,
        "op11_double_array_trie": op11_double_array_trie,
        "op12_hyperplane_neighbours": op12_hyperplane_neighbours,
        "op13_hybrid_ranking": op13_hybrid_ranking,
    }


VA_FILE_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


TRIE_SQL = """
WITH c AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), k AS (
  -- crc32 of the decimal id, byte by byte and bit by bit
  SELECT *, xor(list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda s, b: list_reduce([CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7], lambda z, i: xor(z >> 1, 3988292384 * (z & 1)), xor(s, b)), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM c
), b AS (
  SELECT k.conv_id, list_concat(coalesce(r.t[1:CAST(k.crc % 6 AS INTEGER)], []), k.t[CAST(k.crc % 6 AS INTEGER) + 1:]) AS t FROM k LEFT JOIN c r ON r.conv_id = k.conv_id - k.conv_id % 100
), p AS (SELECT conv_id, len(t) AS length, t[1:d] AS node, d AS depth FROM b, unnest(range(0, len(t) + 1)) u(d)),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends,
         CASE WHEN depth > 0 THEN (count(*) - 1) * length(node[-1].x) ELSE 0 END AS own
  FROM p GROUP BY node, depth
), kids AS (SELECT node[1:depth - 1] AS up, count(*) AS n FROM n WHERE depth > 0 GROUP BY up),
t AS (
  SELECT n.node[1:d] AS top, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(own) AS saved
  FROM n LEFT JOIN kids ON kids.up = n.node, unnest(range(0, depth + 1)) u(d) GROUP BY top
)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN t ON t.top = n.node LEFT JOIN kids ON kids.up = n.node LEFT JOIN n o ON n.depth > 0 AND o.node = n.node[1:n.depth - 1]
"""

NEAR_VECTORS_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS v,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS sound
  FROM embeddings
), l AS (
  SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.sound AND b.sound AND a.r < b.r AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (
  SELECT r AS a, r AS b FROM e
  UNION
  SELECT x.a, y.b FROM reach x JOIN both_ways y ON x.b = y.a
), c AS (SELECT x.a AS r, min(e.vec_id) AS component_id FROM reach x JOIN e ON e.r = x.b GROUP BY x.a),
n AS (SELECT a AS r, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, false) AS kept
FROM e JOIN c USING (r) LEFT JOIN n USING (r)
"""

RANKED_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), h AS (SELECT doc_id, r, t, len(t) AS n FROM d WHERE len(t) > 0),
a AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM h),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM h) GROUP BY ALL),
i AS (
  SELECT q, item_id, term, count(*) AS qtf FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL
),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(all_docs) + 2)::DOUBLE / (2.0 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM f, a GROUP BY term),
p AS (
  SELECT q, item_id, f.r, sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms)))) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN h USING (r), a GROUP BY ALL
),
s AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
  FROM p JOIN h USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM s WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_va_file_search": VA_FILE_SQL, "op11_double_array_trie": TRIE_SQL, "op12_hyperplane_neighbours": NEAR_VECTORS_SQL, "op13_hybrid_ranking": RANKED_SQL}
