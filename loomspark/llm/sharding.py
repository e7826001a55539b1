"""Operator 1: weighted rendezvous sharding, in DataFrame functions only.

Each record key draws one number for each shard from a hash of (key, shard); with u the draw in (0, 1) and w the shard's
weight, the shard with the smallest -ln(u) / w takes the record. A shard's share is its part of all weights, and a shard
more takes records only into itself, because the other shards' draws stay as they were.

Defined cases: a null key is a key like any other; rows that share a key share a shard; a null text has no bytes (size 1,
CRC 0); an empty table gives no rows; other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import same, table

#: Draws are the first 13 hexadecimal digits of an MD5: 52 bits, which a double holds exactly.
DRAW_DIGITS, DRAW_RANGE = 13, float(16**13)


def draw(key: Column, shard: int) -> Column:
    """The record's draw for a shard: a long from 0 to 2**52 - 1."""
    named = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))
    return F.conv(F.substring(F.md5(named), 1, DRAW_DIGITS), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 to len(weights) - 1) that takes `key`; equal scores go to the smaller shard number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    score = lambda i, w: -F.log((draw(key, i) + F.lit(0.5)) / F.lit(DRAW_RANGE)) / F.lit(float(w))
    runs = F.array(*[F.struct(score(i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)])
    return F.array_min(runs)["shard"]


def assign_shards(df: DataFrame, key: str, weights: list[float], grown_weight: float | None = None, shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """Adds the shard of each row and, with `grown_weight`, the shard it would have with one more of that weight.

    One projection, no shuffle.
    """
    out = df.withColumn(shard_col, rendezvous(F.col(key), weights))
    if grown_weight is not None:
        out = out.withColumn(grown_col, rendezvous(F.col(key), [*weights, grown_weight]))
    return out


def number_slots(df: DataFrame, shard: str, key: str, slot: str = "slot", buckets: int = 1024) -> DataFrame:
    """Adds a gapless number from 0 within each shard, in order of (bucket of the key's hash, key, other columns).

    Equal rows are counted before the shuffle, rows are numbered within (shard, bucket), and a shard's `buckets` totals
    give each bucket its start; so a shard isn't one task's work, nor is a row that makes up a third of the table.
    """
    cols = df.columns
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 6), 16, 10).cast("long") % buckets
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket)
    totals = rows.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_total"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(up_to(Window.partitionBy(shard).orderBy("_bucket"))), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(key, *[c for c in cols if c not in (key, shard)])
    placed = rows.withColumn("_before", F.coalesce(F.sum("_n").over(up_to(inside)), F.lit(0)))
    placed = placed.join(starts, same([F.col(shard), F.col("_bucket")], [F.col("_shard"), F.col("_b")]))
    chunk = 65536  # a row repeated without end is unrolled in pieces
    placed = placed.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1).cast("long"), F.lit(chunk).cast("long"))))
    placed = placed.withColumn("_copy", F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + chunk, F.col("_n")) - 1)))
    return placed.select(*cols, (F.col("_start") + F.col("_before") + F.col("_copy")).cast("long").alias(slot))


SHARDS = 16


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards under the law `key`, and in 17."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", [1.0] * SHARDS, grown_weight=1.0)
    rows = number_slots(rows, "shard", "doc_id")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# CRC-32 by half bytes: the steps of the reflected polynomial for 0 to 15. Fixed values.
_STEPS = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]
_DRAW = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT"
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(coalesce(text, '')) AS h,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::BIGINT % 1024 AS bucket
  FROM documents
), crc AS (
  SELECT *, xor(list_reduce(
    list_transform(range(0, length(h)), lambda i: instr('0123456789ABCDEF', substr(h, (i // 2) * 2 + 2 - i % 2, 1)) - 1),
    lambda c, x: xor(c >> 4, ({_STEPS}::BIGINT[])[(xor(c, x) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM d
), draws AS (
  SELECT doc_id, arg_max(i, ({_DRAW}, -i)) FILTER (WHERE i < {SHARDS}) AS shard, arg_max(i, ({_DRAW}, -i)) AS grown_shard
  FROM (SELECT DISTINCT doc_id FROM documents), range(0, {SHARDS} + 1) AS r(i) GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM crc JOIN draws USING (doc_id)
"""
