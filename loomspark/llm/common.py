"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..naming import fresh
from ..staging import shared_dir, staged, unstage

__all__ = ["SPACE", "one_row_each", "same", "shared_dir", "sort_names", "staged", "table", "unstage"]

#: The white space of every contract here: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sort_names(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct `keys`, each with an integer name; names ascend in the sort order of the keys.

    The range sort spreads the keys over tasks; a name is the task's number and the place in its sorted run, so
    that no global counter passes through one task. The result is staged, which fixes the names.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = df.select(*keys).distinct().repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return staged(ranked.withColumn(name, F.monotonically_increasing_id()), "names")


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of two lists of columns."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def one_row_each(docs: DataFrame, proof: str, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose id and text (by the digest in `proof`) are in `kept` (_id, _text, _rows), one row for each there."""
    names = {c: fresh(c, docs) for c in ("_id", "_text", "_rows")}
    some = kept.select(*[F.col(c).alias(n) for c, n in names.items()])
    on = F.col("doc_id").eqNullSafe(F.col(names["_id"])) & (F.col(proof) == F.col(names["_text"]))
    if kept.where("_rows > 1").isEmpty():
        return docs.join(some, on, "left_semi")
    once = docs.join(some.where(F.col(names["_rows"]) == 1), on, "left_semi")
    many = docs.join(some.where(F.col(names["_rows"]) > 1), on, "left_semi")
    return once.unionByName(many.dropDuplicates(["doc_id", proof]))
