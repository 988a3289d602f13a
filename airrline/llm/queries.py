"""The registered queries of this folder and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from airrline.llm import bpe, chat, decontaminate, near_dup, ppm, quality, secrets, sharding, site_tree, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.score", "leak.question", "leak.answer")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    out = bpe.encode(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


# CRC-32 from its rule: a table of 256 entries, then a fold over the bytes.
ORACLE["op5_sharding"] = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (
  SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(text), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM texts),
sized AS (
  SELECT doc_id, size, CAST(xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) AS BIGINT) AS text_crc32
  FROM bytes, crc),
placed AS (
  SELECT *, row_number() OVER w AS row, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS reach, sum(size) OVER () AS total
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
cut AS (SELECT *, CAST(least(15, ((2 * reach - size) * 16) // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row - min(row) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut"""


@query
def op6_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_tree.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    number = F.col("id")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), number.alias("turn"), F.when(number == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digest(chat.format_chats(rows))


# Reading back gives the source turns, so their digests are those of the source.
ORACLE["op7_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, 16 + length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(10), '%0A'))
         + length(CASE WHEN contains(text, '</turn>') OR contains(text, '<turn ') OR regexp_matches(text, '<\\+/?turn')
                       THEN regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g') ELSE text END) AS n
  FROM turns),
chats AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM chats"""


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("long") for k in ("assign", "access", "hex")]
    counts = [(F.size("spans") - n).alias(f"n_{k}") for n, k in zip(counts, ("assign", "access", "hex"), strict=True)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_verified")


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# Bytes as pairs of hexadecimal digits: all strings of 50 bytes, the first owner of each, and what lies between the runs that go.
ORACLE["op9_suffix_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n
  FROM documents),
strings AS (SELECT r, id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
firsts AS (SELECT s, min(id) AS first FROM strings GROUP BY s),
late AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM strings JOIN firsts USING (s) WHERE first < id),
runs AS (
  SELECT r, k, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT r, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM late) GROUP BY r, k),
gaps AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS past FROM runs),
gone AS (
  SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS reach, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY k) AS kept
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN reach IS NULL THEN h ELSE kept || substr(h, 2 * reach + 1) END)) AS kept_sha256
FROM d LEFT JOIN gone USING (r)"""
