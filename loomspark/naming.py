"""Names for the columns that an operator adds on its way and drops again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(base: str, *frames: DataFrame) -> str:
    """`base`, or `base` with a number, which no column of the frames has, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}{k}"
    return name
