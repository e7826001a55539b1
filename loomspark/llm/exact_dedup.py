"""Operator 2: exact deduplication by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and take their place as an
integer name; then adjacent pairs of names are sorted and named in turn, level by level, until each document has one name.
Two documents of the same level have the same name just when their bytes are equal: names stand for contents, not hashes.
Blocks travel under a hash, and blocks of different content that share a hash are told apart by their content.

Defined cases: a null text counts as empty, and empty texts are copies of one another; of equal texts the row with the
smallest doc_id stays (a null id comes last); rows that repeat an id and a text share their verdict; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..naming import fresh
from .common import SPACE, one_row_each, same, sort_names, staged, table, unstage

BLOCK_BYTES = 16384


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def _blocks(norm: Column, size: int) -> Column:
    """The text's bytes in blocks of `size`, one empty block for an empty text; linear in the text."""
    data = norm.cast("binary")
    last = F.greatest(F.floor((F.octet_length(norm) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def block_names(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and the identity (levels, name) of every normalised text; a row stands for _n equal rows.

    `hash_bits` shortens the hash under which blocks travel, for tests of equal hashes. Shuffles: each distinct block
    once, then rows of a few integers for each level; levels grow with the logarithm of the longest text.
    """
    spark = docs.sparkSession
    hashed = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - hash_bits)
    base = docs.select("doc_id", normalised(F.col(text)).alias("_norm"))
    length = F.floor(F.greatest(F.octet_length("_norm") - 1, F.lit(0)) / block_bytes).cast("int")
    rows = base.select("doc_id", F.sha2("_norm", 256).alias("text_sha256"), length.alias("_last"), F.posexplode(_blocks(F.col("_norm"), block_bytes)).alias("_i", "_block"))
    # Which hashes stand for two contents or more? Contents meet once, each distinct one a single time.
    told = base.select(F.explode(_blocks(F.col("_norm"), block_bytes)).alias("_block")).select(hashed(F.col("_block")).alias("_hash"), "_block").distinct()
    seen = staged(told.groupBy("_hash").agg(F.count(F.lit(1)).alias("_contents")), "hashes")
    rows = rows.withColumn("_hash", hashed(F.col("_block")))
    if seen.where("_contents > 1").isEmpty():
        rows, keys = rows.drop("_block"), ["_hash"]
        names = sort_names(seen, keys, "_name")
    else:
        shared = seen.where("_contents > 1").select("_hash", F.lit(1).alias("_shared"))
        rows = rows.join(shared, "_hash", "left").withColumn("_block", F.when(F.col("_shared").isNotNull(), F.col("_block")))
        rows, keys = rows.drop("_shared"), ["_hash", "_block"]
        names = sort_names(rows, keys, "_name")
    named = rows.join(names, same([rows[k] for k in keys], [names[k] for k in keys])).select("doc_id", "text_sha256", "_last", "_i", "_name", F.lit(1).cast("long").alias("_n"))
    level, level_rows = 0, staged(named, "named")
    unstage(seen, names)
    done = level_rows.where("_last = 0").select("doc_id", "text_sha256", F.lit(0).alias("levels"), F.col("_name").alias("name"), "_n")
    live = level_rows.where("_last > 0")
    while not live.isEmpty():
        level += 1
        # A document's key is (doc_id, text_sha256); rows that repeat both are counted in _n and come back at the end.
        pair = live.groupBy("doc_id", "text_sha256", (F.col("_last") / 2).cast("int").alias("_last"), (F.col("_i") / 2).cast("int").alias("_i")).agg(
            F.max(F.when(F.col("_i") % 2 == 0, F.col("_name"))).alias("_a"), F.coalesce(F.max(F.when(F.col("_i") % 2 == 1, F.col("_name"))), F.lit(-1).cast("long")).alias("_b"), F.sum(F.when(F.col("_i") % 2 == 0, F.col("_n"))).alias("_n")
        )
        names = sort_names(pair, ["_a", "_b"], "_name")
        halved = staged(pair.join(names, ["_a", "_b"]).select("doc_id", "text_sha256", "_last", "_i", "_name", "_n"), "named")
        unstage(names)
        done = done.unionByName(halved.where("_last = 0").select("doc_id", "text_sha256", F.lit(level).alias("levels"), F.col("_name").alias("name"), "_n"))
        live = halved.where("_last > 0")
    return done


def exact_dedup(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document; copies beyond the kept one included."""
    ids = block_names(docs, text, **how)
    groups = ids.groupBy("levels", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    out = ids.join(groups, ["levels", "name"])
    chunk = 65536
    out = out.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), "_n", F.lit(chunk).cast("long"))))
    out = out.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + (chunk - 1), F.col("_n")))))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of equal texts one row with all its columns, that of the smallest id (null ids last).

    Rows are told by id and text together, so a row that shares its id with another text, or has none, isn't kept for it.
    """
    proof = fresh("_proof", docs)
    kept = exact_dedup(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_rows"))
    kept = staged(kept.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text"), "_rows"), "kept")
    return one_row_each(docs.withColumn(proof, F.sha2(normalised(F.col("text")), 256)), proof, kept).drop(proof)


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
