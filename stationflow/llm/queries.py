"""The registered queries of this subpackage: thin calls with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import (
    alignment,
    bpe,
    code_compression,
    gated_lm,
    language_id,
    license_scan,
    near_embeddings,
    packing,
    secret_scan,
    simhash,
    token_files,
    topk,
    toxicity,
)
from stationflow.llm.common import fold, held_out, table
from stationflow.session import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Limits of a packed sequence beside its 4,096 tokens: the last third of a document bears loss, at most 2,048 such tokens, 16 segments.
PACKING = {"loss_share": 1 / 3, "max_loss": 2_048, "max_segments": 16}
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.where(fold() != 0))
    found = language_id.identify(docs.select("doc_id", "text"), profiles, drop_text=True)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, VOCABULARY, digests_only=True)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, VOCABULARY)
    rows = token_files.read_token_files(spark, path)
    return token_files.with_crc(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, drop_text=True).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, **PACKING)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    found = gated_lm.score(table(spark, sf_dir, "documents"), remainder != 2)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_MODEL)


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_embeddings": op4_near_embeddings,
    "op5_bpe": op5_bpe,
    "op6_token_files": op6_token_files,
    "op7_topk": op7_topk,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_alignment": op12_alignment,
    "op13_code_compression": op13_code_compression,
}
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

ORACLE: dict[str, str] = {
    "op2_license_scan": license_scan.oracle_sql(),
    "op3_secret_scan": secret_scan.oracle_sql(),
    "op7_topk": TOP_K_SQL,
}
