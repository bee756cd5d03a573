"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import archives, license_sql, licenses, lines, mih, packing, pieces, quality, ring, scoring, simhash
from sievelake.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mih_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), query_every=20, k=20)


def op2_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, sf_dir, "documents"), removed_col="n_removed")
    return cleaned.select("doc_id", "n_removed", F.sha2("text", 256).alias("text_sha256"))


#: Distinct sites of each line are counted exactly; the first occurrence of a line on 10 or more stays.
OP5_SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), trimmed AS (
  SELECT doc_id, source, pos, line, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS kernel FROM lines
), spread AS (
  SELECT kernel FROM trimmed WHERE kernel <> '' GROUP BY kernel HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT t.doc_id, t.pos, t.line,
         s.kernel IS NOT NULL AND row_number() OVER (PARTITION BY t.kernel ORDER BY t.doc_id, t.pos) > 1 AS gone
  FROM trimmed t LEFT JOIN spread s ON t.kernel = s.kernel
)
SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""


def op6_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.language_model_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "reason"
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_pack_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = archives.archive_pages(table(spark, sf_dir, "pages"))
    records = archives.read_archives(written, keep_payload=False)
    return records.filter("record_type != 'gap'").select(
        archives.page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        archives.page_number(F.col("refers_to")).alias("refers_to"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_mih_neighbours": op1_mih_neighbours,
        "op2_shard_ring": op2_shard_ring,
        "op3_license_digests": op3_license_digests,
        "op4_simhash": op4_simhash,
        "op5_line_spread": op5_line_spread,
        "op6_attention_scores": op6_attention_scores,
        "op7_compression_bands": op7_compression_bands,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_pack_pieces": op9_pack_pieces,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_digests": license_sql.scan_sql(),
        "op5_line_spread": OP5_SQL,
    }
