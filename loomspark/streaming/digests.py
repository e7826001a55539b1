"""Snapshots compared by digests: only buckets of keys whose rows differ are joined.

Rows are dealt into leaves by a hash of their key. A leaf's digest doesn't depend on the order of its rows: their number, and
sums and exclusive ors of two independent row hashes. Inner nodes digest FANOUT children, up to one root. Two trees are compared
from the root down, and a branch that agrees is never looked into. The tree of a snapshot is small and can be kept, so that the
old snapshot isn't read again but for the leaves that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..naming import fresh
from ..staging import staged
from .incremental import snapshot_changes

#: Leaves of a tree, and children of an inner node.
LEAVES, FANOUT = 1 << 12, 1 << 4
#: Up to so many differing leaves go with the join as a broadcast; a tree may have more.
FEW = 1 << 16


def leaf_of(keys: list[str], leaves: int) -> Column:
    """The leaf of a row. Null isn't skipped, as a hash of the values alone would do."""
    return F.pmod(F.xxhash64(*[x for k in keys for x in (F.col(f"`{k}`"), F.col(f"`{k}`").isNull())]), F.lit(leaves))


def _row_hash(columns: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def tree(df: DataFrame, keys: list[str], columns: list[str] | None = None, leaves: int = LEAVES) -> DataFrame:
    """(level, node, rows, digest_sum, digest_xor), level 0 the leaves that have rows, staged. Columns are taken in the order
    given, or by name."""
    columns = columns or sorted(df.columns)
    hashed = df.select(leaf_of(keys, leaves).alias("node"), _row_hash(columns, 1).alias("h1"), _row_hash(columns, 2).alias("h2"))
    level = hashed.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("h1").cast("decimal(38,0)")).alias("digest_sum"), F.bit_xor("h2").alias("digest_xor"))
    base = staged(level.select(F.lit(0).alias("level"), "node", "rows", "digest_sum", "digest_xor"), "leaves")
    out, number, size = base, 0, leaves
    while size > 1:
        number, size = number + 1, -(-size // FANOUT)
        # A sum over the leaves below, with each leaf's number mixed in, so that what changes places is seen.
        own = F.xxhash64("node", "rows", "digest_sum", "digest_xor")
        up = base.groupBy(F.floor(F.col("node") / FANOUT**number).alias("up")).agg(F.sum("rows").alias("rows"), F.sum(own.cast("decimal(38,0)")).alias("digest_sum"), F.bit_xor(own).alias("digest_xor"))
        out = out.unionByName(up.select(F.lit(number).alias("level"), F.col("up").alias("node"), "rows", "digest_sum", "digest_xor"))
    return staged(out, "tree")


@dataclass
class Comparison:
    """leaves: those that differ (one column, `node`); compared: nodes looked at on each level, from the root."""

    leaves: DataFrame
    count: int
    compared: list[int]


def differing(old: DataFrame, new: DataFrame) -> Comparison:
    """Walks down two trees of the same shape, level by level; below a node that agrees nothing is read."""
    top = max(r or 0 for df in (old, new) for r in df.agg(F.max("level")).first())
    live, compared = None, []
    for level in range(top, -1, -1):
        side = lambda df, level=level: df.where(F.col("level") == level).drop("level")
        a, b = side(old), side(new)
        if live is not None:
            below = live.select(F.col("node").alias("above"))
            keep = lambda df, below=below: df.join(below, F.floor(F.col("node") / FANOUT) == F.col("above"), "left_semi")
            a, b = keep(a), keep(b)
        both = a.alias("a").join(b.alias("b"), F.col("a.node") == F.col("b.node"), "full")
        same = F.lit(True)
        for c in ("rows", "digest_sum", "digest_xor"):
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        nodes = staged(both.select(F.coalesce("a.node", "b.node").alias("node"), same.alias("same")), "nodes")
        compared.append(nodes.count())
        live = nodes.where(~F.col("same")).select("node")
    return Comparison(live, live.count(), compared)


def digest_changes(old: DataFrame, new: DataFrame, keys: list[str], table: str = "", leaves: int = LEAVES, old_tree: DataFrame | None = None, new_tree: DataFrame | None = None) -> tuple[DataFrame, Comparison]:
    """The rows of snapshot_changes(old, new, keys), and how the trees compared. Trees that are kept from earlier are taken as given:
    they are of the columns that both snapshots have, by name, and of as many leaves."""
    shared = sorted(c for c in new.columns if c in old.columns)
    old_tree = old_tree if old_tree is not None else tree(old, keys, shared, leaves)
    new_tree = new_tree if new_tree is not None else tree(new, keys, shared, leaves)
    found = differing(old_tree, new_tree)
    name = fresh("_leaf", old, new)
    some = found.leaves.select(F.col("node").alias(name))
    some = F.broadcast(some) if found.count <= FEW else some
    cut = lambda df: df.join(some, leaf_of(keys, leaves) == F.col(name), "left_semi")
    return snapshot_changes(cut(old), cut(new), keys, table), found
