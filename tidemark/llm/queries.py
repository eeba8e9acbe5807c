"""Registered queries of this folder: one ``opN_<name>`` per operator.

Each reads its whole table and applies its operator with production
parameters; the digest columns come from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizers package keeps a file (each machine has it installed)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann_partitions import nearest_by_partitions
    return nearest_by_partitions(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pfor import token_id_files
    return token_id_files(read_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxic_segments import toxicity
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"))


def op4_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.impact_topk import impact_top_k
    return impact_top_k(read_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import source_mix
    return source_mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeats=3).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.kd_shards import kd_shards
    return kd_shards(read_table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import token_counts
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op8_covering_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.covering_lsh import near_duplicate_components
    return near_duplicate_components(read_table(spark, sf_dir, "documents"), shingle=3, radius=2).select(
        "doc_id", "fingerprint", "component_id")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spec_bpe import bpe_round_trip
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_ledger import digest, secret_findings
    found, _ = secret_findings(read_table(spark, sf_dir, "documents"))
    return digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.whitening import component_rows, whiten
    return component_rows(*whiten(read_table(spark, sf_dir, "embeddings"), components=8))


def op12_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hard_negatives import hard_negatives
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), every=100, positives=5, negatives=10)


def op13_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.bottom_k import edited_fingerprints
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_learned_partitions, op2_token_id_files, op3_toxic_segments, op4_impact_top_k, op5_source_mix, op6_kd_shards,
    op7_token_counts, op8_covering_lsh, op9_bpe_round_trip, op10_secret_ledger, op11_block_whitening,
    op12_segment_negatives, op13_bottom_k_fingerprints)}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op4_impact_top_k": """WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_segment_negatives": """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (
      PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
