"""Sharding by jump consistent hashing, with DataFrame functions only.

A key's shard follows from the key and the number of shards alone, by the published generator
(key = key * 2862933555777941757 + 1 modulo 2**64); there is no ring table, and when a shard is appended only the rows
that move into it move at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import numbered
from . import common

#: A key jumps ln(shards) times on average; more than this many jumps have a probability below 1e-60.
MOST_JUMPS = 128


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit integer key; a null key counts as -1."""
    if shards < 1:
        raise ValueError("there must be one shard at least")
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    signed = F.coalesce(key.cast("long"), F.lit(-1))
    unsigned = F.when(signed < 0, signed.cast("decimal(20,0)") + two64).otherwise(signed.cast("decimal(20,0)")).cast("decimal(20,0)")

    def following(k: Column) -> Column:
        return ((k * F.lit("2862933555777941757").cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % two64).cast("decimal(20,0)")

    def jump(s: Column, _: Column) -> Column:
        draw = (F.floor(s["k"] / F.lit(1 << 33).cast("decimal(10,0)")).cast("long") + 1).cast("double")
        to = ((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")
        on = F.struct(s["j"].alias("b"), to.alias("j"), following(s["k"]).alias("k"))
        return F.when(s["j"] < shards, on).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), following(unsigned).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, jump, lambda s: s["b"]).cast("int")


def assign_shards(spark: SparkSession, docs: DataFrame, shards: int) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes and 8 more; a null text has none and the CRC of the empty text. Rows with equal
    doc_id share a shard; a null doc_id counts as -1. Slots are gapless from 0 in each shard, in order of doc_id (null
    first), CRC and size at every number of rows: shards are numbered by ranges of these, whose counts are summed first,
    so a large shard is no single task. Further columns are not read; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", jump_hash(F.col("doc_id"), shards)).withColumn("grown_shard", jump_hash(F.col("doc_id"), shards + 1))
    placed = numbered(rows, "shard", ["doc_id", "text_crc32", "size"], "place")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") - 1).alias("slot"), "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark, common.read(spark, sf_dir, "documents"), 24)


#: The jumps by a recursive query; CRC-32 byte by byte, with its table made from the polynomial.
OP3_SQL = r"""
WITH RECURSIVE
jumps AS (
  SELECT k AS doc_id, n, -1::BIGINT AS b, 0::BIGINT AS j, ((CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616 ELSE k::HUGEINT END) * 2862933555777941757 + 1) % 18446744073709551616 AS s
  FROM (SELECT DISTINCT coalesce(doc_id, -1) AS k FROM documents), (VALUES (24), (25)) v(n)
  UNION ALL
  SELECT doc_id, n, j, trunc((j + 1) * (2147483648::DOUBLE / ((s // 8589934592) + 1)::DOUBLE))::BIGINT, (s * 2862933555777941757 + 1) % 18446744073709551616 FROM jumps WHERE j < n),
shards AS (SELECT doc_id, max(b) FILTER (n = 24)::INT AS shard, max(b) FILTER (n = 25)::INT AS grown_shard FROM jumps GROUP BY doc_id),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(b))),
bytes AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(size - 8), lambda i: (position(h[2 * i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(h[2 * i + 2] IN '0123456789ABCDEF') - 1)),
                   lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM bytes, crc_table)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY c.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM crcs c JOIN shards s ON coalesce(c.doc_id, -1) = s.doc_id
"""
