"""The queries of the operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, embeddings, media, minhash, packing, quality, sentencepieces, suffixes, toolcalls, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the public vocabulary files are; ``LUMENRANK_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("LUMENRANK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.turns_as_calls(_table(spark, sf_dir, "conversations"))
    linked = toolcalls.link(calls, results, {"reply": toolcalls.REPLY})
    return linked.withColumn("errors", F.concat_ws("; ", "errors"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, evidence=True)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.describe_media(media.store_media(_table(spark, sf_dir, "documents")), digests=True)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tracks")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    back = sentencepieces.decode(sentencepieces.encode(docs, path), path)
    return back.select("doc_id", "n_ids", "ids_crc32", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_tool_call_linking": op3_tool_call_linking,
        "op4_toxicity": op4_toxicity,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_media_columns": op7_media_columns,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_sentencepiece": op10_sentencepiece,
    }


#: Linked calls of the dialogue turns. Rows are unique by (conv_id, turn) in the tables that SQL is run on.
OP3_SQL = """
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.turn - 1) AS t, u.turn AS turn, a.turn AS result_turn,
    u.text AS prompt, a.text AS content, EXISTS (SELECT 1 FROM u AS b WHERE b.conv_id = u.conv_id AND b.turn = u.turn - 2) AS dep
  FROM u FULL OUTER JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
),
e AS (
  SELECT *, conv_id || ':' || t AS call_id, CASE WHEN length(prompt) < 100 THEN 'prompt: shorter than 100' ELSE '' END AS errors,
    CASE WHEN result_turn IS NULL THEN 'null' ELSE '{"content":' || CAST(to_json(content) AS VARCHAR) || ',"turn":' || result_turn || '}' END AS res
  FROM j
)
SELECT conv_id, call_id, turn, coalesce(turn, result_turn) AS topo_order, result_turn, CAST(result_turn IS NOT NULL AS BIGINT) AS n_results,
  CASE WHEN turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'open' ELSE 'linked' END AS status,
  CASE WHEN turn IS NULL THEN NULL ELSE errors = '' END AS valid, CASE WHEN turn IS NULL THEN '' ELSE errors END AS errors,
  CASE WHEN turn IS NULL THEN '{"id":"' || call_id || '","result":' || res || '}'
    ELSE '{"arguments":{"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',"turn":' || turn || '},"depends_on":['
      || CASE WHEN dep THEN '"' || conv_id || ':' || (turn - 2) || '"' ELSE '' END || '],"errors":['
      || CASE WHEN errors = '' THEN '' ELSE '"' || errors || '"' END || '],"id":"' || call_id || '","name":"reply","result":' || res || '}' END AS json
FROM e
"""


#: WARC records of the pages: digests as base32 of SHA-1's 160 bits, five at a time. Page ids are unique and not null in the tables that SQL is run on.
OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, unhex(sha1(html))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS first,
    CASE WHEN coalesce(url, '') = '' THEN 'urn:page:' || page_id ELSE url END AS url
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT
    + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, url
FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_tool_call_linking": OP3_SQL}
