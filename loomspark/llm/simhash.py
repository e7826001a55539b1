"""Operator 4: near-duplicates by SimHash, linked by the generalised pigeonhole principle.

Fingerprints: 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's 3-word shingles.
Links: fingerprints that differ in at most `radius` bits. Correlated bits are grouped into m partitions; partition i gets a
threshold t_i of -1 (not probed) or more, with the sum of all t_i equal to radius - m + 1. Two fingerprints within the radius
then agree within t_i on some partition i. A dynamic program chooses m and the thresholds that cost least by the number of
candidates that the value counts of all fingerprints lead one to expect. Each fingerprint probes the values within t_i of
its own and candidates are verified by their exact distance.

A value that many fingerprints share would pair them all. There the exact way is linear: members of the bucket meet at the
centres within radius / 2 bits of them, for two of them are within the radius just if they share such a centre; each links
to the least member of its centre.

Defined cases: null or wordless texts have fingerprint zero, which links like any other; fewer than three words make one
shingle; rows that repeat an id belong to one document, whose component is the least of its rows' components' ids; a null id
never names a component unless no other id is in it; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import release
from . import jaccard
from .common import staged, table, unstage
from .components import components

RADIUS, SEED, SHINGLE, BITS = 2, 42, 3, 64
#: Buckets of more members than this go by centres; a member has BITS + 1 of those.
CROWD = 128
PARTS = (1, 2, 3, 4)
#: The work of making and shuffling a probe row, in candidate pairs.
PROBE_COST = 4.0
_MASK = (1 << BITS) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both of bytes: ASCII letters and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, starts, at = b" ".join(words), [], 0
    view = memoryview(joined)
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*[s - 1 for s in starts[shingle:]], len(joined)]
    of = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, n, 65536):  # bounded memory for texts of any length
        hashes = np.array([of(view[a:b], SEED) for a, b in zip(starts[lo : min(n, lo + 65536)], ends[lo:], strict=False)], dtype=np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), or another key: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many fingerprints, how often each bit is set, and the correlation of each two bits: 64 x 64 sums whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram, n = np.zeros(BITS), np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, gram, n = total + bits.sum(axis=0), gram + bits.T @ bits, n + len(bits)
        if n:
            at = [(-1, -1, float(n)), *[(i, -1, float(total[i])) for i in range(BITS)], *[(i, j, float(gram[i, j])) for i in range(BITS) for j in range(BITS)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*at, strict=True)], names=["i", "j", "v"])

    got = {(r.i, r.j): r.v for r in fps.select("fp").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    n = int(got.get((-1, -1), 0))
    if not n:
        return 0, np.zeros(BITS), np.eye(BITS)
    p = np.array([got[i, -1] / n for i in range(BITS)])
    cov = np.array([[got[i, j] / n - p[i] * p[j] for j in range(BITS)] for i in range(BITS)])
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, p, cov / np.outer(sd, sd)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of even size; each starts at the free bit most tied to the others and takes the bits most tied to it."""
    free, out, ties = set(range(BITS)), [], np.abs(correlation)
    for k in range(m):
        size = (BITS * (k + 1)) // m - (BITS * k) // m
        first = max(sorted(free), key=lambda b: sum(ties[b, x] for x in free))
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: sum(ties[b, x] for x in group))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds, one for each partition and of the given sum, that cost least: a dynamic program over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, more in own.items():
                if used + t not in step or c + more < step[used + t][0]:
                    step[used + t] = (c + more, [*chosen, t])
        best = step
    return best[total]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def plan_probes(fps: DataFrame, radius: int = RADIUS, parts: tuple[int, ...] = PARTS) -> list[tuple[list[int], int]]:
    """The partitions' bits and thresholds. Candidates with equal values are counted over all fingerprints; with t more
    bits they are scaled by the bits' own chances to differ."""
    n, p, correlation = bit_statistics(fps)
    layouts = {m: group_bits(correlation, m) for m in parts}
    keyed = [(m, i, _mask(bits)) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    values = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for k, (_, _, mask) in enumerate(keyed)])).alias("x"))
    pairs = {r.k: r.pairs for r in values.groupBy("x.k", "x.v").count().groupBy("k").agg(F.sum(F.least(F.col("count").cast("double") * F.col("count") / 2, F.col("count") * float(CROWD))).alias("pairs")).collect()}
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m, groups in layouts.items():
        cost = []
        for i, bits in enumerate(groups):
            odds = [(2 * p[b] * (1 - p[b])) / max(1 - 2 * p[b] * (1 - p[b]), 1e-9) for b in bits]
            ways = np.zeros(radius + 1)
            ways[0] = 1.0
            for o in odds:
                ways[1:] = ways[1:] + o * ways[:-1]
            same_value = pairs.get(next(k for k, (mm, ii, _) in enumerate(keyed) if (mm, ii) == (m, i)), 0.0)
            own, probes = {-1: 0.0}, 0
            for t in range(radius + 1):
                probes += _choose(len(bits), t)
                own[t] = max(same_value, n / 2) * ways[: t + 1].sum() + PROBE_COST * n * probes
            cost.append(own)
        c, chosen = allocate(cost, radius - m + 1)
        if best is None or c < best[0]:
            best = (c, list(zip(groups, chosen, strict=True)))
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _flips(bits: list[int], t: int) -> list[int]:
    """Masks that flip up to t of the bits."""
    out = [0]
    last = [(0, -1)]
    for _ in range(t):
        last = [(m | 1 << bits[j], j) for m, at in last for j in range(at + 1, len(bits))]
        out += [m for m, _ in last]
    return [_signed(m) for m in out]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD, plan: list[tuple[list[int], int]] | None = None, apart: bool = False) -> DataFrame:
    """(a, b): enough pairs of distinct fingerprints within `radius` to join all that any such pair joins. `apart`: they are
    staged, and each partition's first, so that no plan that the driver holds has more than one partition's joins."""
    if radius % 2:
        raise ValueError("centres need an even radius: those of an odd one would reach a bit too far")
    plan = plan or plan_probes(fps, radius)
    out, parts = None, []
    for k, (bits, t) in enumerate(plan):
        if t < 0:
            continue
        mask = F.lit(_mask(bits))
        value = F.col("fp").bitwiseAND(mask)
        held = fps.select("fp", value.alias("v"))
        sizes = held.groupBy("v").agg(F.count(F.lit(1)).alias("_size"))
        crowded = sizes.where(F.col("_size") > crowd).select("v")
        crowded = staged(crowded, "crowded") if apart else crowded
        thin = held.join(crowded, "v", "left_anti")
        if t == 0:
            found = thin.alias("x").join(thin.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.fp") < F.col("y.fp")))
            dense = held.join(crowded, "v")
        else:
            flips = F.array(*[F.lit(f) for f in _flips(bits, t)])
            probes = fps.select(F.col("fp"), F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseAND(mask).bitwiseXOR(f))).alias("v"))
            found = probes.alias("x").join(thin.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.fp") != F.col("y.fp")))
            dense = probes.join(crowded, "v")
        found = found.where(distance(F.col("x.fp"), F.col("y.fp")) <= radius).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))
        # In a crowded bucket the members meet at centres instead.
        centres = F.array(*[F.lit(f) for f in _flips(list(range(BITS)), radius // 2)])
        met = dense.select(F.lit(k).alias("_k"), "fp").distinct().select("fp", F.explode(F.transform(centres, lambda f: F.col("fp").bitwiseXOR(f))).alias("c"))
        least = met.groupBy("c").agg(F.min("fp").alias("_least"), F.count(F.lit(1)).alias("_met")).where("_met > 1").select("c", "_least")
        starred = met.join(least, "c").where("fp <> _least").select(F.col("_least").alias("a"), F.col("fp").alias("b"))
        if apart:
            parts.append(found := staged(found, "thin"))
            if not crowded.isEmpty():
                parts.append(starred := staged(starred, "starred"))
                found = found.unionByName(starred)
            unstage(crowded)
        else:
            found = found.unionByName(starred)
        out = found if out is None else out.unionByName(found)
    if not apart:
        return out.distinct()
    out = staged(out.distinct(), "links")
    unstage(*parts)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document row."""
    rows = staged(fingerprints(docs, text), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("_least_id")), "distinct")
    labels = components(links(fps, radius))
    # Least id of each component, from one row for each fingerprint.
    placed = fps.join(labels, fps.fp == labels.node, "left").select("fp", "_least_id", F.coalesce("label", "fp").alias("_label"))
    ids = placed.groupBy("_label").agg(F.min("_least_id").alias("component_id"))
    of = placed.join(ids, "_label").select(F.col("fp").alias("_fp"), "component_id")
    out = rows.join(of, rows.fp == of._fp)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def candidate_pairs(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(a, b), a < b, staged: texts, by hash, that have one fingerprint or that links() joins."""
    texts = docs.select(jaccard.node(text).alias("node"), text)
    rows = staged(fingerprints(texts, text, "node", shingle), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("_last")), "distinct")
    # Texts of one fingerprint meet at the first of them, and linked fingerprints at the first text of each.
    alike = rows.join(fps.where("first <> _last").select(F.col("fp").alias("_fp"), "first"), F.col("fp") == F.col("_fp")).where("node <> first").select("first", "node")
    of = lambda end: fps.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}"))
    joined = links(fps.select("fp"), apart=True)
    linked = joined.join(of("a"), "a").join(of("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    out = staged(alike.select(F.col("first").alias("a"), F.col("node").alias("b")).unionByName(linked), "candidates")
    unstage(rows, fps, joined)
    release(docs.sparkSession)
    return out


def keep_one_per_component(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies the document with the smallest id stays. Near copies are those of
    the general rule, a Jaccard similarity of 0.8 or more over 5-word shingles, verified on whole sets: of texts that fingerprints
    link, and of texts that fingerprints are too coarse for and that meet at a rare shingle."""
    pairs = candidate_pairs(docs)
    out = jaccard.without_near_copies(docs, candidates=pairs)
    unstage(pairs)
    return out
