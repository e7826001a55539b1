"""Operator 11: importance resampling of documents towards a target distribution.

Words and their runs of up to LONGEST are features, hashed into buckets by CRC-32. A bucket's gain is the logarithm of how
much likelier it is among the target's features than among the corpus's, add-one smoothed; a document's weight is the mean
gain of its features. Weights plus Gumbel noise, drawn from the id alone, give the scores whose highest share is a draw
without replacement in proportion to exp(weight / 1000).

All of it is DataFrame work: n-gram arrays are exploded and hashed in the JVM, counts combine before the shuffle into one row
a bucket and task, the table of gains has one row a bucket and is broadcast, sums combine into one row a document. Ranks
come of a sort by ranges whose counts tell where each range's ranks begin, so no task sees all documents.

Defined cases: a null text has no words; a document without words weighs 0 and isn't drawn, as any with fewer than LEAST_WORDS;
a null id draws its noise as an empty one and comes last among equal scores; rows that repeat an id are documents of their
own and share its noise; equal scores and ids rank in the order of the scan; an empty target or corpus gives every bucket the
gain of its smoothed counts alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_place
from .common import staged, table, unstage

LONGEST, BUCKETS, PERCENT, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: What stands between words: ASCII but for digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The text's words, A-Z lower-cased. lower() is the faster for texts that are all ASCII, where it does the same."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def features(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """A row of `rows` (with an array `words`) for each feature, with its `bucket`; one with a null bucket if it has none."""
    keep = [c for c in rows.columns if c != "words"]
    runs = F.arrays_zip(*[F.slice("words", k + 1, F.size("words")).alias(f"w{k}") for k in range(longest)])
    at = rows.select(*keep, F.inline_outer(runs).alias(*[f"w{k}" for k in range(longest)]))
    # A run that would pass the end has a null word, and so is null: concat, not concat_ws.
    grams = F.array(*[F.concat(*[x for j in range(k + 1) for x in ((F.lit(" "),) if j else ()) + (F.col(f"w{j}"),)]) for k in range(longest)])
    each = at.select(*keep, F.explode(F.when(F.col("w0").isNull(), F.array(F.lit(None).cast("string"))).otherwise(grams)).alias("gram"), F.col("w0").isNull().alias("none"))
    return each.where(F.col("gram").isNotNull() | F.col("none")).select(*keep, F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).alias("bucket"))


def bucket_counts(docs: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all the texts fall into each bucket."""
    got = features(docs.select(words(F.col(text)).alias("words")), longest, buckets)
    return got.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gain_table(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket, of two tables of counts."""
    both = raw.withColumn("target", F.lit(0).cast("long")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("n"), F.col("n").alias("target")))
    empty = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("target"))
    each = staged(both.unionByName(empty).groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("target").alias("t")), "counts")
    total = each.agg(F.sum("s"), F.sum("t")).first()
    x = lambda c: c.cast("double")
    ratio = x(F.col("t") + 1) * x(F.lit(total[0] + buckets)) / (x(F.col("s") + 1) * x(F.lit(total[1] + buckets)))
    return each.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a standard Gumbel draw, floored, from the seed and the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; those drawn are the ones with a rank."""
    gains = gain_table(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    rows = docs.select("doc_id", words(F.col(text)).alias("words"), F.monotonically_increasing_id().alias("row")).withColumn("n_words", F.size("words"))
    each = features(rows, longest, buckets).join(F.broadcast(gains), "bucket", "left")  # as many rows as buckets
    summed = each.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gains"))
    n = F.greatest("n_features", F.lit(1))
    weight = ((F.col("gains") - F.pmod("gains", n)) / n).cast("long")  # exact: the remainder is taken off first
    scored = summed.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = staged(scored.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("fit")), "scored")
    fit = scored.where("fit").count()
    placed = with_place(scored, [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    unstage(gains, scored)
    drawn = F.col("fit") & (F.col("place") < percent * fit // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the texts of `benchmark`."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 by half bytes: the steps of the reflected polynomial for 0 to 15. Fixed values.
_STEPS = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]


def _sql_features(name: str, key: str) -> str:
    split = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""{name}_words AS MATERIALIZED (SELECT {key} AS id, {split} AS w FROM {name}),
{name}_grams AS MATERIALIZED (
  SELECT id, gram, count(*) AS n FROM (
    SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM {name}_words
  ) GROUP BY ALL)"""


SQL = f"""
WITH {_sql_features("documents", "doc_id")},
{_sql_features("benchmark", "item_id")},
crc AS MATERIALIZED (
  SELECT gram, xor(list_reduce(
    list_transform(range(0, length(h)), lambda i: instr('0123456789ABCDEF', substr(h, (i // 2) * 2 + 2 - i % 2, 1)) - 1),
    lambda c, x: xor(c >> 4, ({_STEPS}::BIGINT[])[(xor(c, x) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM (SELECT gram, hex(gram) AS h FROM (SELECT gram FROM documents_grams UNION SELECT gram FROM benchmark_grams))
), s AS (SELECT bucket, sum(n)::BIGINT AS s FROM documents_grams JOIN crc USING (gram) GROUP BY 1),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM benchmark_grams JOIN crc USING (gram) GROUP BY 1),
gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (tt + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), (SELECT sum(s)::BIGINT AS ss FROM s), (SELECT coalesce(sum(t), 0)::BIGINT AS tt FROM t)
), weighed AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS gains FROM documents_grams JOIN crc USING (gram) JOIN gains USING (bucket) GROUP BY 1
), scored AS (
  SELECT d.id AS doc_id, len(d.w) >= {LEAST_WORDS} AS fit, coalesce(n_features, 0) AS n_features,
         coalesce((gains - ((gains % n_features) + n_features) % n_features) // n_features, 0) AS weight,
         ('0x' || substr(sha256('{SEED}:' || d.id), 1, 8))::BIGINT AS h
  FROM documents_words d LEFT JOIN weighed USING (id)
), final AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY fit) AS n FROM final
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN fit AND r <= {PERCENT} * n // 100 THEN r END::BIGINT AS rank
FROM ranked
"""
