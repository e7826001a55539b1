"""Global order as data: each row's place in a total order of all rows, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..naming import fresh
from ..staging import staged

#: monotonically_increasing_id() holds the task's number above this bit and the row's within it below.
_ROW_BITS = 33


def with_place(df: DataFrame, keys: Sequence[Column], place: str = "place", parts: int | None = None) -> DataFrame:
    """`df` with `place` (0, 1, 2, ... by `keys`); rows alike in them keep the order of the scan.

    Rows go to tasks by ranges of the keys and are sorted there. The sorted rows are written, and the rows of each range
    counted; the sum of the counts before a range is where its places begin. What reaches the driver is one count a range.
    The scan's order is part of the key by which ranges are cut, so that one key which most rows have is spread over many.
    The input is read twice, once for a sample that cuts the ranges: stage it if that is dear, or if it isn't repeatable.
    An empty table gives no rows; `place` takes the place of a column of that name.
    """
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen, at = fresh("_seen", df), fresh("_at", df)
    order = [*keys, F.col(seen).asc()]
    ranged = df.withColumn(seen, F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = staged(ranged.drop(seen).withColumn(at, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(F.col(at), _ROW_BITS)
    counts = dict(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = [counts.get(k, 0) for k in range(max(counts, default=0) + 1)]
    starts = F.lit([0, *accumulate(sizes[:-1])]).cast("array<long>")
    number = F.element_at(starts, part.cast("int") + 1) + F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.withColumn(place, number).drop(at)
