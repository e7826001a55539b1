"""Operator 5: removal of every byte that a repeated 400-byte string covers, by a distributed cover-and-merge suffix method.

A difference cover of fixed period makes rows of two thirds of all suffixes, at each level again; on Spark that is over ten
times the text in shuffles. This is the same scheme with a cover that the content chooses:

* Sample: position p is assigned the leftmost least k-gram hash among the k-grams that start in [p, p + 256). With k = 145
  that choice depends on the 400 bytes at p alone, so equal strings have their sampled position at the same distance: the
  property that makes a difference cover work. About one position in 128 is sampled.
* Sampled positions are named by the triple (bytes before, k-gram, bytes after): first by the k-gram, and only those whose
  name occurs twice go on.
* Recursion on names: the strings that share a sampled position are a range of distances. Two names tell a range: that of
  the bytes all its strings have in common, and that of the bytes they cover together. If the latter occurs twice, all its
  strings repeat; if the former occurs once, none does; else the range is split in four and named again, down to one string.
* Merge: all other suffixes are thus placed by (distance, name) of their sampled position, and equal neighbours are removed.

Names are MD5 digests of the bytes (128 bits), grouped by Spark; equal ranges are counted map-side before they are shuffled,
so a passage that a third of all documents share is a few rows, and one of each set of equal ranges stands for all of it in
deeper levels. Nothing pairs documents.

Defined cases: null counts as empty; texts under 400 bytes lose nothing; a row that repeats an id and a text is a second
occurrence of its strings; matches never cross documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import same, staged, table, unstage

LENGTH, REACH = 400, 256
GRAM = LENGTH - REACH + 1
SPLIT = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 19
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            _POWERS[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])
    return _POWERS["up"], _POWERS["down"]


def samples(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of positions that share a sampled position: (sampled, its k-gram's hash, first, last), in order."""
    out: list[tuple[np.ndarray, ...]] = []
    last_start = len(data) - LENGTH
    for base in range(0, last_start + 1, _PIECE):
        n = min(_PIECE, last_start + 1 - base)  # positions judged here
        x = np.frombuffer(data, np.uint8, n + LENGTH - 1, base).astype(np.uint64) + np.uint64(1)
        up, down = _powers(len(x) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(x * up[: len(x)], dtype=np.uint64)])
        h = (total[GRAM:] - total[:-GRAM]) * down[: len(x) - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        # Least in each window of REACH, the leftmost of equals: the place is in the low bits.
        key = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(key) // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        blocks = padded.reshape(-1, REACH)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:n], ahead[REACH - 1 : REACH - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        out.append((at[first] + base, h[at[first]].view(np.int64), first + base, last + base))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at, name, first, last = (np.concatenate(c) for c in zip(*out, strict=True))
    # A run that crosses the edge of a piece came out in two.
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.concatenate([starts[1:] - 1, [len(at) - 1]])
    return at[starts], name[starts], first[starts], last[ends]


def _bytes(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", F.xxhash64(body).alias("print"), body.cast("binary").alias("data"))


def _sampled(rows: DataFrame, id_type: pa.DataType, id_sql: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, prints, ats, names = [], [], [], []
                for doc_id, print_, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    at, name, _, _ = samples(data)
                    ids += [doc_id] * len(at)
                    prints += [print_] * len(at)
                    ats.append(at)
                    names.append(name)
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(prints, pa.int64()), pa.array(np.concatenate(ats)), pa.array(np.concatenate(names))], names=["doc_id", "print", "at", "name"])

    return rows.mapInArrow(run, f"doc_id {id_sql}, print long, at long, name long")


def _names(part: bytes, left: int, d1: int, d2: int) -> tuple[bytes | None, bytes | None]:
    """Digests of what the strings at distances d1 to d2 before the sampled position cover, and of what they share."""
    right = len(part) - left
    if d1 > left or LENGTH - d2 > right:
        return None, None
    common = hashlib.md5(part[left - d1 : left - d2 + LENGTH]).digest()
    if d2 > left or LENGTH - d1 > right:
        return None, common
    return hashlib.md5(part[left - d2 : left - d1 + LENGTH]).digest(), common


_TOLD = "struct<lo:int,hi:int,open:boolean,whole:binary,common:binary>"


def _fragments(rows: DataFrame, id_type: pa.DataType, id_sql: str) -> DataFrame:
    """One row for each sampled position of `hot` (equal ones of a document share a row): the bytes around it, its place(s)
    in the document, the distances of its run, and the whole range's names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            size = 0
            for doc_id, print_, data, hot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, _, first, last = samples(data)
                use = np.isin(at, np.array(hot, np.int64))
                alike: dict[tuple, list[int]] = {}
                for a, lo, hi in zip(at[use].tolist(), first[use].tolist(), last[use].tolist(), strict=True):
                    left = min(REACH - 1, a)
                    alike.setdefault((data[a - left : a + LENGTH], left, a - hi, a - lo), []).append(a)
                for (part, left, near, far), places in alike.items():
                    whole, common = _names(part, left, 0, REACH - 1)
                    for c, v in zip(out, (doc_id, print_, part, left, near, far, places, len(places), whole, common), strict=True):
                        c.append(v)
                    size += len(part)
                if size > 8 << 20:
                    yield _fragment_batch(out, id_type)
                    out, size = [[] for _ in range(10)], 0
            yield _fragment_batch(out, id_type)

    return rows.mapInArrow(run, f"doc_id {id_sql}, print long, part binary, left int, near int, far int, places array<long>, times long, whole binary, common binary")


def _fragment_batch(out: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "print", "part", "left", "near", "far", "places", "times", "whole", "common"])


def _split(rows: DataFrame) -> DataFrame:
    """(part_id, part, left, near, far, jobs) with jobs array<struct<lo, hi, open>>: each job's range in SPLIT, with names.

    Ranges that the run doesn't reach are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for part, left, near, far, jobs in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                own = []
                for job in jobs:
                    step = (job["hi"] - job["lo"] + 1) // SPLIT
                    for lo in range(job["lo"], job["hi"] + 1, step):
                        if lo <= far and lo + step - 1 >= near:
                            whole, common = _names(part, left, lo, lo + step - 1)
                            if common is not None:
                                own.append({"lo": lo, "hi": lo + step - 1, "open": job["open"], "whole": whole, "common": common})
                told.append(own)
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("open", pa.bool_()), ("whole", pa.binary()), ("common", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(told, kind)], names=["part_id", "part", "left", "near", "far", "told"])

    return rows.mapInArrow(run, f"part_id long, part binary, left int, near int, far int, told array<{_TOLD}>")


def repeated_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, print, starts array<struct<start, stop>>): for each text with repeats, the first and last positions of
    strings of LENGTH bytes that also start elsewhere. `print` is the text's XXH64."""
    id_sql = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    rows = _bytes(docs, text).where(F.octet_length("data") >= LENGTH)
    sampled = staged(_sampled(rows, id_type, id_sql), "sampled")
    # Staged, as are the counts below: a join with a plain table can split a name that very many rows have.
    twice = staged(sampled.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("name").alias("_name")), "twice")
    hot = sampled.join(twice, sampled.name == twice._name).groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).agg(F.collect_set("at").alias("hot"))
    cut = rows.join(hot, same([F.col("doc_id"), F.col("print")], [F.col("_id"), F.col("_print")])).select("doc_id", "print", "data", "hot")
    parts = staged(_fragments(cut, id_type, id_sql).withColumn("part_id", F.monotonically_increasing_id()), "parts")
    unstage(sampled, twice)
    where = parts.select("part_id", "doc_id", "print", "near", "far", "places")
    nodes = parts.select("part_id", F.lit(0).alias("lo"), F.lit(REACH - 1).alias("hi"), F.lit(True).alias("open"), "times", "whole", "common")
    source, old, found = parts.select("part_id", "part", "left", "near", "far"), [], []
    while True:
        # One pass counts equal wholes; one of them then stands for all in the count of equal commons.
        wholes = nodes.where("whole IS NOT NULL").groupBy("lo", "whole").agg(F.sum("times").alias("n"), F.min("part_id").alias("keeper")).where("n > 1")
        wholes = staged(wholes.select(F.col("lo").alias("_lo"), F.col("whole").alias("_whole"), "keeper"), "wholes")
        fate = nodes.join(wholes, (F.col("lo") == F.col("_lo")) & (F.col("whole") == F.col("_whole")), "left")
        fate = fate.select("part_id", "lo", "hi", "open", "times", "common", F.col("keeper").isNotNull().alias("repeats"), (F.col("keeper").isNull() | (F.col("keeper") == F.col("part_id"))).alias("keeps"))
        fate = staged(fate, "fate")
        found.append(fate.where("open AND repeats").select("part_id", "lo", "hi"))
        still = F.col("open") & ~F.col("repeats")
        groups = fate.groupBy("lo", "common").agg(F.sum(F.when(F.col("keeps"), F.col("times"))).alias("members"), F.max(still).alias("asked")).where("members > 1 AND asked")
        groups = staged(groups.select(F.col("lo").alias("_lo"), F.col("common").alias("_common")), "groups")
        more = fate.join(groups, (F.col("lo") == F.col("_lo")) & (F.col("common") == F.col("_common")), "left_semi")
        more = more.where((F.col("hi") > F.col("lo")) & (still | F.col("keeps"))).select("part_id", "lo", "hi", still.alias("open"))
        jobs = more.groupBy(F.col("part_id").alias("_part_id")).agg(F.collect_list(F.struct("lo", "hi", "open")).alias("jobs"))
        ready = source.join(jobs, source.part_id == jobs._part_id).select("part_id", "part", "left", "near", "far", "jobs")
        told = staged(_split(ready), "told")
        old += [fate, wholes, groups]
        if told.isEmpty():
            old.append(told)
            break
        nodes = told.select("part_id", F.explode("told").alias("t")).select("part_id", "t.lo", "t.hi", "t.open", F.lit(1).cast("long").alias("times"), "t.whole", "t.common")
        source = told.select("part_id", "part", "left", "near", "far")
        old.append(told)
    marks = found[0]
    for f in found[1:]:
        marks = marks.unionByName(f)
    marks = marks.groupBy(F.col("part_id").alias("_part_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    spread = where.join(marks, where.part_id == marks._part_id).select("doc_id", "print", "near", "far", "places", F.explode("ranges").alias("r"))
    spread = spread.select("doc_id", "print", F.greatest("near", "r.lo").alias("d1"), F.least("far", "r.hi").alias("d2"), F.explode("places").alias("at")).where("d1 <= d2")
    out = spread.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set(F.struct((F.col("at") - F.col("d2")).alias("start"), (F.col("at") - F.col("d1")).alias("stop")))).alias("starts"))
    out = staged(out, "runs")
    unstage(parts, *old)
    return out


def merged(starts: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed runs (first byte, end) from sorted ranges of positions at which repeated strings start."""
    out: list[tuple[int, int]] = []
    for s in starts:
        lo, hi = s["start"], s["stop"] + LENGTH
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, data, n_bytes, spans): the remaining bytes and the removed runs of every document row."""
    runs = repeated_runs(docs, text)
    rows = _bytes(docs, text)
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "starts")
    both = rows.join(runs, same([F.col("doc_id"), F.col("print")], [F.col("_id"), F.col("_print")]), "left").select("doc_id", "data", "starts")
    id_sql = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            left, sizes, gone = [], [], []
            for data, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans, kept, at = merged(starts or []), [], 0
                for lo, hi in spans:
                    kept.append(data[at:lo])
                    at = hi
                left.append(b"".join([*kept, data[at:]]))
                sizes.append(len(data))
                gone.append([{"start": lo, "stop": hi} for lo, hi in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, kind)], names=["doc_id", "data", "n_bytes", "spans"])

    return both.mapInArrow(run, f"doc_id {id_sql}, data binary, n_bytes long, spans array<struct<start:long,stop:long>>")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))
