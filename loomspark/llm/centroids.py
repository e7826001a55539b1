"""Operator 12: k-means on integer vectors, exact, by filtering centroids down kd-trees.

Vectors are cut into blocks where they are read, and each block becomes a kd-tree that is written once: its vectors in the
tree's order, and for each node its range of them, its box and the integer sums of its components. A round sends the
centroids to all blocks. Down each tree a node keeps the centroids that may be nearest for some point of its box; one is
pruned if another is strictly nearer everywhere in the box, which whole-number arithmetic on the box's corners decides. A node
with one centroid left is assigned whole, by its count and sums; a leaf with several is resolved vector by vector. Each task
returns one row of counts and sums a centroid; no vector moves between tasks, so that many equal ones make no task larger.

Defined cases: a vector that is null, has another number of components or one that is null or not finite is left out; vectors
equally near two centroids go to the smaller number; components beyond 2^18 either way (far outside of embeddings) count
as 2^18, so that all distances fit 64 bits; with fewer vectors than clusters each is a centroid; equal ids are told apart by
their vectors when centroids start, a null id hashes as an empty one; no vectors give no rows; other columns are not read.
Sums over a cluster that pass 64 bits are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged, table, unstage

COMPONENTS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a block and of a leaf, at most; nodes that are looked at together.
BLOCK, LEAF, FRONT = 4096, 16, 1024
_LIMIT = 1 << 26
_PARTS = ("points", "start", "stop", "left", "lo", "hi", "sums")


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), within +-2^26."""
    return np.clip(np.floor(scale * x.astype(np.float64)), -_LIMIT, _LIMIT).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integers, exactly: in doubles where no sum can pass 2^53."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64)


@dataclass
class Tree:
    """A kd-tree: points in its order; node i holds points start[i]:stop[i], with children left[i] and left[i] + 1 (0: none)."""

    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree, and the points' order in it. A node is halved at the median of its widest component."""
        order, nodes, left, boxes = np.arange(len(points)), [(0, len(points))], [], []
        for i, (a, b) in enumerate(nodes):  # grows on the way
            own = points[order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            boxes.append((lo, hi, own.sum(axis=0)))
            wide = int(np.argmax(hi - lo))
            left.append(0)
            if b - a > leaf and hi[wide] > lo[wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
                left[i] = len(nodes)
                nodes += [(a, a + middle), (a + middle, b)]
        start, stop = np.array(nodes).T
        return cls(points[order], start, stop, np.array(left), *(np.array(x) for x in zip(*boxes, strict=True))), order

    def packed(self) -> list[bytes]:
        small = np.int16 if np.abs(self.points).max(initial=0) < 1 << 15 else np.int32
        kinds = {"points": small, "lo": small, "hi": small, "sums": np.int64}
        return [getattr(self, k).astype(kinds.get(k, np.int32)).tobytes() for k in _PARTS]

    @classmethod
    def unpacked(cls, raw: list[bytes], n: int, components: int) -> Tree:
        small = np.dtype(f"i{len(raw[0]) // (n * components)}")
        kinds = {"points": small, "lo": small, "hi": small, "sums": np.int64}
        got = {k: np.frombuffer(b, kinds.get(k, np.int32)) for k, b in zip(_PARTS, raw, strict=True)}
        return cls(**{k: x.reshape(-1, components) if k in kinds else x for k, x in got.items()})

    def filtered(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """(nodes, centroid of each) that are assigned whole, and (leaves, one set of candidates) to be resolved."""
        square = (centroids**2).sum(axis=1)
        assigned, open_leaves, open_sets = [], [], []
        front, may = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(front):
            next_front, next_may = [], []
            for a in range(0, len(front), FRONT):
                node, live = front[a : a + FRONT], may[a : a + FRONT]
                lo, hi = self.lo[node].astype(np.int64), self.hi[node].astype(np.int64)
                # Distances to the box's middle, all doubled, less what all have in common.
                near = np.where(live, square - product(lo + hi, centroids.T), np.iinfo(np.int64).max).argmin(axis=1)
                live = live.copy()
                for best in np.unique(near):
                    at = np.flatnonzero(near == best)
                    # How much farther, at most in the box, the best is than each other: p at a corner makes 2 p w least.
                    w = centroids[best] - centroids
                    least = product(lo[at], np.maximum(w, 0).T) + product(hi[at], np.minimum(w, 0).T)
                    live[at] &= square[best] - square - 2 * least >= 0
                one = live.sum(axis=1) == 1
                assigned.append((node[one], near[one]))
                leaf = ~one & (self.left[node] == 0)
                open_leaves.append(node[leaf])
                open_sets.append(live[leaf])
                inner = ~one & ~leaf
                children = self.left[node[inner]]
                next_front += [children, children + 1]
                next_may += [live[inner], live[inner]]
            front, may = np.concatenate(next_front), np.concatenate(next_may)
        leaves, sets = np.concatenate(open_leaves), np.concatenate(open_sets)
        groups = []
        if len(leaves):
            kinds, of = np.unique(sets, axis=0, return_inverse=True)
            groups = [(leaves[of.ravel() == g], np.flatnonzero(kinds[g])) for g in range(len(kinds))]
        return assigned, groups

    def _rows(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes' points, and how many each has."""
        size = self.stop[nodes] - self.start[nodes]
        ends = np.cumsum(size)
        return np.repeat(self.start[nodes] - (ends - size), size) + np.arange(int(size.sum())), size

    def _resolved(self, groups: list, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, centroid of each) of the leaves' points."""
        square = (centroids**2).sum(axis=1)
        for leaves, some in groups:
            rows, _ = self._rows(leaves)
            yield rows, some[(square[some] - 2 * product(self.points[rows], centroids[some].T)).argmin(axis=1)]

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points of each centroid, and their sums."""
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        assigned, groups = self.filtered(centroids)
        for nodes, best in assigned:
            np.add.at(count, best, self.stop[nodes] - self.start[nodes])
            np.add.at(sums, best, self.sums[nodes])
        for rows, best in self._resolved(groups, centroids):
            count += np.bincount(best, minlength=len(centroids))
            np.add.at(sums, best, self.points[rows].astype(np.int64))
        return count, sums

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's centroid and its squared distance to it."""
        out = np.zeros(len(self.points), np.int64)
        assigned, groups = self.filtered(centroids)
        for nodes, best in assigned:
            rows, size = self._rows(nodes)
            out[rows] = np.repeat(best, size)
        for rows, best in self._resolved(groups, centroids):
            out[rows] = best
        return out, ((self.points.astype(np.int64) - centroids[out]) ** 2).sum(axis=1)


def kept(vectors: DataFrame, key: str, values: str, components: int) -> DataFrame:
    """(id, x) of the vectors that count, x in doubles."""
    x = F.col(values).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(key).alias("id"), x.alias("x")).where((F.size("x") == components) & F.coalesce(~odd, F.lit(False)))


def trees(rows: DataFrame, components: int, scale: int, block: int = BLOCK) -> DataFrame:
    """Staged: a row a block, with the ids in the tree's order, their number and the tree."""
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def row(ids: list[pa.Array], values: list[np.ndarray]) -> pa.RecordBatch:
        tree, order = Tree.of(whole(np.concatenate(values), scale))
        own = pa.concat_arrays(ids).cast(id_type).take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.array([own.to_pylist()], pa.list_(id_type)), pa.array([len(order)], pa.int32()), *[pa.array([b], pa.binary()) for b in tree.packed()]], names=["ids", "n", *_PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - held)
                ids.append(part.column(0))
                values.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components))
                at, held = at + part.num_rows, held + part.num_rows
                if held == block:
                    yield row(ids, values)
                    ids, values, held = [], [], 0
        if held:
            yield row(ids, values)

    kind = rows.schema["id"].dataType.simpleString()
    return staged(rows.mapInArrow(run, f"ids array<{kind}>, n int, {', '.join(f'{p} binary' for p in _PARTS)}"), "trees")


def _trees(batch: pa.RecordBatch, components: int) -> Iterator[tuple[pa.Array | None, Tree]]:
    for k in range(batch.num_rows):
        raw = [batch.column(p)[k].as_py() for p in _PARTS]
        yield batch.column("ids")[k].values if "ids" in batch.schema.names else None, Tree.unpacked(raw, batch.column("n")[k].as_py(), components)


def _id_hash(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; those that no vector is nearest to stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, tree in _trees(batch, centroids.shape[1]):
                more, added = tree.totals(centroids)
                count, sums = count + more, sums + added
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    each = blocks.drop("ids").mapInArrow(run, "cluster long, n long, sums array<long>")
    total = each.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = centroids.copy()
    for r in total.collect():  # clusters times components
        out[r.cluster, r.i] = int(r.x) // r.n
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray, id_type: T.DataType) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, centroids.shape[1]):
                best, distance = tree.nearest(centroids)
                yield pa.RecordBatch.from_arrays([ids.cast(kind), pa.array(best.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return blocks.mapInArrow(run, T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster(vectors: DataFrame, key: str = "vec_id", values: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every vector that counts, staged, and the centroids."""
    rows = kept(vectors, key, values, components)
    first = rows.orderBy(_id_hash(F.col("id"), seed), "x").limit(clusters).collect()
    centroids = whole(np.array([r.x for r in first]).reshape(-1, components), scale)
    blocks = trees(rows, components, scale, block)
    for _ in range(rounds if first else 0):
        centroids = means(blocks, centroids)
    out = staged(assigned(blocks, centroids, rows.schema["id"].dataType).withColumnRenamed("id", key), "assigned")
    unstage(blocks)
    return out, centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`found` with each cluster's and the whole sum of distances, and its centroid's digest."""
    got = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row a cluster
    fits = lambda x: x if x < 1 << 63 else None
    own = {r.cluster: int(r.own) for r in got}
    sums = F.lit([fits(own.get(k, 0)) for k in range(len(centroids))]).cast("array<long>")
    digests = F.lit([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]).cast("array<string>")
    at = F.col("cluster") + 1
    return found.select("*", F.element_at(sums, at).alias("cluster_inertia"), F.lit(fits(sum(own.values()))).cast("long").alias("inertia"), F.element_at(digests, at).alias("centroid_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_inertia(*cluster(table(spark, sf_dir, "embeddings")))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_round(k: int) -> str:
    """Assigns to centroids c{k}; squared distances in doubles, exact below 2^53."""
    near = f"""a{k} AS MATERIALIZED (
  SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d)::BIGINT AS distance
  FROM (SELECT v.id, c.cluster, v.xx - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x) AS d FROM v, c{k} c) GROUP BY id)"""
    if k == ROUNDS:
        return near
    return f"""{near},
c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT cluster, list(floor(s / n) ORDER BY i) AS x FROM (
      SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT a.cluster, generate_subscripts(v.x, 1) AS i, unnest(v.x) AS x FROM a{k} a JOIN v USING (id)) GROUP BY 1, 2
    ) GROUP BY 1) m USING (cluster))"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT id, x, list_dot_product(x, x) AS xx FROM (
    SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda e: floor({SCALE} * e)) AS x FROM embeddings
    WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda e: isfinite(e))) = {COMPONENTS})
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS cluster, x FROM (SELECT sha256('{SEED}:' || id) AS h, x FROM v ORDER BY h LIMIT {CLUSTERS})
), {", ".join(_sql_round(k) for k in range(ROUNDS + 1))}
SELECT id AS vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda e: e::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c USING (cluster)
"""
