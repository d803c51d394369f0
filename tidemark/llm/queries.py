"""The thin queries opN_<name> over the operators of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ego_join, exact_dedup, mixing, near_dedup, pu_quality, sharding, substring_dedup, surrogates, tag_paths


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = pu_quality.learn(docs, _table(spark, sf_dir, "labels"))
    out = pu_quality.scored(docs, model)
    return out.select("doc_id", F.coalesce(pu_quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = sharding.shuffle_into_shards(rows, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), given AS (
  SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM sources
), ranked AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM given
), held AS (
  SELECT arg_min(level, place) AS level FROM ranked WHERE level < cap / w
), goals AS (
  SELECT r.source, r.source_size, least(r.cap, coalesce(h.level * r.w, r.cap)) AS target FROM ranked r LEFT JOIN held h ON true
), aims AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS per,
         ('0x' || substr(md5('7:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' END || ':' || coalesce(source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS off FROM goals
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS rank FROM sized
)
SELECT p.doc_id, p.size, a.source_size, a.target,
       CAST(least(floor(a.off + a.per * p.rank) - floor(a.off + a.per * (p.rank - 1)), ceil(a.per)) AS BIGINT) * p.size AS taken
FROM placed p JOIN aims a ON p.source IS NOT DISTINCT FROM a.source
"""


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_embeddings(_table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links,
       (SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id) AS component_id,
       (SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id) = v.vec_id AS kept
FROM v
"""


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(_table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM split WHERE len(ws) >= 20)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM grams) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM late
), marks AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
)
SELECT s.doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda w, k: NOT list_contains(ks, k)) END, ' '), '')) AS kept_sha256
FROM split s LEFT JOIN marks m ON s.doc_id = m.doc_id
"""


#: The key of the query where the session has none in spark.tidemark.pii.key: for invented test tables only.
TEST_KEY = "for invented test tables only"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.tidemark.pii.key", TEST_KEY)
    return surrogates.surrogate_texts(_table(spark, sf_dir, "documents"), key.encode())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pu_quality": op2_pu_quality,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_near_dedup": op9_near_dedup,
    "op10_bpe": op10_bpe,
}
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op4_mixing": OP4_SQL, "op5_embedding_near_dedup": OP5_SQL, "op7_substring_dedup": OP7_SQL}
