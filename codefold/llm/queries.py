"""The registered queries of the training-data operators, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codefold.llm.chat import format_chats
from codefold.llm.common import work_dir
from codefold.llm.decontaminate import benchmark_leaks
from codefold.llm.exact_dedup import exact_duplicates
from codefold.llm.packing import pack
from codefold.llm.pii import detect_pii
from codefold.llm.quality import classify_quality
from codefold.llm.simhash import near_duplicates
from codefold.llm.token_counts import count_tokens
from codefold.llm.token_shards import read_documents, write_token_shards
from codefold.llm.warc import read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_pii(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json", limit=2048)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_shards(table(spark, sf_dir, "documents"), work_dir(spark, "token-shards"), "byte_bpe_50k.json", end=0)
    return read_documents(spark, manifest)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    return read_warc(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
    SELECT html, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.last_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.last_id <> p.page_id THEN g.last_id END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND p.payload_bytes >= 1000
"""

OP6_SQL = r"""
WITH t AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_token_counts": op2_token_counts,
        "op3_near_dedup": op3_near_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_token_shards": op7_token_shards,
        "op8_quality": op8_quality,
        "op9_warc": op9_warc,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op9_warc": OP9_SQL}
