import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomspark.llm import components, jaccard, simhash

from .odd import odd, texts


def fingerprint_by_hand(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(ids_fps, radius=2):
    at = list(range(len(ids_fps)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, (_, a) in enumerate(ids_fps):
        for j in range(i):
            if (a ^ ids_fps[j][1]).bit_count() <= radius:
                at[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(ids_fps):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(ids_fps))]


def test_odd_documents(spark):
    near = "the quick brown fox jumps over the lazy dog and runs away " * 40
    df = odd(spark, [(30 + k, near + f" tail{k}" * (k > 0)) for k in range(5)])
    rows = [(i, fingerprint_by_hand(t)) for i, t in texts(df)]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(rows, components_by_hand(rows), strict=True)), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


PLANS = {
    "planned": None, "one": [(list(range(64)), 2)], "two": [(list(range(0, 64, 2)), 1), (list(range(1, 64, 2)), 0)], "three": [(list(range(k, 64, 3)), 0) for k in range(3)],
    "four": [(list(range(k, 64, 4)), -1 if k == 1 else 0) for k in range(4)],
}


@pytest.mark.parametrize("crowd", [0, 128])
@pytest.mark.parametrize("plan", PLANS)
def test_no_link_is_lost(spark, plan, crowd):
    rnd, fps = random.Random(5), {0, (1 << 64) - 1}
    for _ in range(25):
        f = rnd.getrandbits(64)
        for _ in range(6):  # chains of close fingerprints
            fps.add(f)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 2, 3])):
                f ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.links(df, crowd=crowd, plan=PLANS[plan])
    for r in links.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2
    labels = {r.node: r.label for r in components.components(links).collect()}
    want = components_by_hand([(k, f) for k, f in enumerate(fps)])
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = [labels.get(s, s) for s in signed]
    assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


def test_allocation_is_the_cheapest():
    cost = [{-1: 0.0, 0: 5.0, 1: 9.0, 2: 50.0}, {-1: 0.0, 0: 1.0, 1: 20.0, 2: 60.0}, {-1: 0.0, 0: 2.0, 1: 4.0, 2: 5.0}]
    best = min((sum(c[t] for c, t in zip(cost, ts, strict=True)), list(ts)) for ts in __import__("itertools").product([-1, 0, 1, 2], repeat=3) if sum(ts) == 0)
    assert simhash.allocate(cost, 0)[0] == best[0]


def test_bits_that_go_together_share_a_partition():
    ties = np.eye(64)
    for a, b in ((0, 40), (1, 41), (2, 42)):
        ties[a, b] = ties[b, a] = 0.9
    groups = simhash.group_bits(ties, 3)
    assert sorted(sum(groups, [])) == list(range(64))
    assert all(any({a, b} <= set(g) for g in groups) for a, b in ((0, 40), (1, 41), (2, 42)))


def test_no_plan_of_the_pipeline_stage_holds_all_partitions(spark, monkeypatch):
    rnd, joins = random.Random(8), []
    rows = [(i, " ".join(f"w{rnd.randrange(300)}" for _ in range(40))) for i in range(60)]
    rows += [(100 + i, f"{rows[i % 9][1]} {'end' * (i % 3)}") for i in range(40)]
    counted = lambda df, label, keep=False, put=simhash.staged: joins.append(len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString()))) or put(df, label, keep)
    monkeypatch.setattr(simhash, "staged", counted)
    monkeypatch.setattr(jaccard, "staged", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.keep_one_per_component(spark, docs, "").count() == 60
    assert len(joins) > 5 and max(joins) <= 5


def test_links_apart_are_the_same(spark):
    rnd = random.Random(9)
    base = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(30)]
    fps = {b ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for b in base for _ in range(12)} | {*base}
    fps = spark.createDataFrame([(x,) for x in sorted(fps)], "fp long")
    for crowd in (3, 1000):  # with and without crowded values
        plan = simhash.plan_probes(fps)
        whole, apart = (Counter(simhash.links(fps, crowd=crowd, plan=plan, apart=x).collect()) for x in (False, True))
        assert whole == apart and len(whole) > 100
