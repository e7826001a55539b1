import hashlib
import math
import random

import numpy as np
import pytest

from loomspark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, id string, x string"


def by_hand(rows, components, k, rounds, scale=256, seed=2):
    """{id: (cluster, distance)} and the centroids, by comparing each vector with all centroids."""
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in x]) for i, x in rows if x is not None and len(x) == components and all(c is not None and math.isfinite(c) for c in x)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    z = [x for _, x in first]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(z))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        z = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else z[j] for j in range(len(z))]
    return sorted(((i, *reversed(nearest(x))) for i, x in kept), key=repr), z


def vectors(n, components, seed):
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-1, 1) for _ in range(components)] for _ in range(6)]
    out = [(i, [rnd.gauss(c, 0.05) for c in rnd.choice(middles)]) for i in range(n)]
    return out + [(n + i, middles[0]) for i in range(n // 3)] + [(2 * n + i, [rnd.choice((0.0, 1 / 256)) for _ in range(components)]) for i in range(n // 4)]


@pytest.mark.parametrize(("components", "block", "leaf"), [(64, 4096, 16), (3, 50, 4), (2, 7, 1)])
def test_equals_brute_force(spark, monkeypatch, components, block, leaf):
    monkeypatch.setattr(centroids, "LEAF", leaf)
    monkeypatch.setattr(centroids.Tree.of.__func__, "__defaults__", (leaf,))
    rows = vectors(120, components, components)
    odd = [(900, None), (901, [0.5] * (components + 1)), (902, [None] + [0.1] * (components - 1)), (903, [math.nan] * components), (904, [math.inf] * components), (905, []), (5, rows[5][1]), (None, rows[9][1]), (5, rows[7][1])]
    df = spark.createDataFrame([(i, x, 1, "c", "i", "x") for i, x in rows + odd], SCHEMA).repartition(3)
    got, z = centroids.cluster(df, components=components, clusters=11, rounds=3, block=block)
    want, at = by_hand(rows + odd, components, 11, 3)
    assert z.tolist() == at and sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    out = centroids.with_inertia(got, z).collect()
    total = sum(d for *_, d in want)
    for r in out:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()


def test_few_none_and_huge(spark):
    df = spark.createDataFrame([(1, [0.5, -0.5], 1, "c", "i", "x"), (2, [3e38, -3e38], 1, "c", "i", "x")], SCHEMA)
    got, z = centroids.cluster(df, components=2, clusters=5)
    assert sorted(r.distance for r in centroids.with_inertia(got, z).collect()) == [0, 0] and len(z) == 2
    assert centroids.with_inertia(*centroids.cluster(df.limit(0), components=2)).collect() == []


def test_pruning_does_the_work():
    """Of well-parted clusters most nodes are assigned whole; of any points the result is the one of comparing all."""
    rng = np.random.default_rng(3)
    z = rng.integers(-1000, 1000, (30, 8))
    points = (z[rng.integers(0, 30, 5000)] + rng.integers(-20, 20, (5000, 8))).astype(np.int64)
    tree, order = centroids.Tree.of(points)
    whole, groups = tree.filtered(z)
    held = lambda nodes: int((tree.stop[nodes] - tree.start[nodes]).sum())
    assigned, resolved = sum(held(n) for n, _ in whole), sum(held(n) for n, _ in groups)
    assert assigned + resolved == 5000 and assigned > 10 * resolved and max(len(n) for n, _ in whole) < 500
    again = centroids.Tree.unpacked(tree.packed(), len(points), 8)
    for t in (tree, again):
        best, distance = t.nearest(z)
        all_of = ((points[order][:, None, :] - z[None]) ** 2).sum(axis=2)
        assert (best == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()
        count, sums = t.totals(z)
        assert (count == np.bincount(best, minlength=30)).all() and all((sums[k] == points[order][best == k].sum(axis=0)).all() for k in range(30))


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[(1 << 26) - 1, 3]]), np.array([[1 << 26], [1]])
    assert centroids.product(a, b).tolist() == [[((1 << 26) - 1 << 26) + 3]]
    big = np.full((1, 64), (1 << 26) - 1)
    assert centroids.product(big, big.T).tolist() == [[64 * ((1 << 26) - 1) ** 2]]
