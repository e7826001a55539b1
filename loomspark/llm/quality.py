"""Operator 10: quality rules and a target-against-corpus likelihood ratio.

Base rules count words, symbols, repeated lines and words in repeated 3-word windows. The method's verdict compares two
multinomials over hashed word n-grams (of the lengths in ORDERS): one of trusted documents (labels: quality 1, toxic 0), one
of the whole raw corpus. A document's score is the log of its likelihood ratio over its number of n-grams. It is kept if the
score reaches the threshold, which comes from trusted documents that the counts don't have (one in CALIBRATION): the KEEP_SHARE
quantile of their scores, less a margin of standard deviations that shrinks as their number grows. The verdict is a fixed
function of text and model, with no draw. Corpus counts come from all documents, trusted counts and the threshold from all trusted
ones, each on its side of that split: one pass counts both. Only texts whose ids may be trusted, by a bit map of hashed ids, meet their
labels in a join that moves texts; all others are counted where they are read.

Single words in many buckets separate best: 2-word sequences that trusted documents happen not to have, and buckets that rare
words share with common ones, hide what a few telling words show.

Defined cases: null and wordless texts have counts of zero, fail the base rules and aren't kept; without trusted documents
the verdict is the base rules'; repeated rows are judged alike; unlabelled and null ids are judged like any other; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_place
from ..staging import scratch, staged
from .common import table

BITS = 18
BUCKETS = 1 << BITS
ORDERS = (1,)
#: One in so many trusted documents sets the threshold, the others are counted.
CALIBRATION = 5
#: Bits of the map of trusted ids: 2^MAP_BITS words of 64. A wrong hit only moves a text that need not be moved.
MAP_BITS = 18
KEEP_SHARE, MARGIN, SMOOTHING = 0.003, 1.0, 1.0
LEAST_WORDS, MOST_REPEATED = 50, 50
_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOLS = "#*$%&|<>"
_HASHED: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """XXH64 of each word, lower-cased; a bounded memo holds the common ones."""
    if len(_HASHED) > 500_000:
        _HASHED.clear()
    memo, of = _HASHED, xxhash.xxh64_intdigest
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = memo[w] = of(w.lower().encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, np.uint64)


def ngrams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the word sequences of each length in ORDERS."""
    key, parts = hashes, []
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            key = key[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            parts.append(key)
    return (np.concatenate(parts) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BITS)).astype(np.int64)


def repeated_words(hashes: np.ndarray, words: list[str]) -> int:
    """Words in 3-word windows that the text has twice or more, by the exact words."""
    n = len(words)
    if n < 4:
        return 0
    at: dict[str, int] = {}
    ids = np.array([at.setdefault(w, len(at)) for w in words], np.int64)
    # Two steps of dense naming keep the window's key exact for any number of words.
    pair = ids[:-1] * len(at) + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)
    triple = pair[:-1].astype(np.int64) * len(at) + ids[2:]
    _, inverse, counts = np.unique(triple, return_inverse=True, return_counts=True)
    twice = counts[inverse] >= 2
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    seen, out = set(), 0
    for line in text.split("\n"):
        if _WORD.search(line):
            out += line in seen
            seen.add(line)
    return out


@dataclass
class Ratio:
    """Log ratio of each bucket and the least score that is kept (None: no trusted documents)."""

    log_ratio: np.ndarray
    threshold: float | None

    def score(self, hashes: np.ndarray) -> float:
        grams = ngrams(hashes)
        return float(self.log_ratio[grams].mean()) if len(grams) else 0.0


def _counted(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of the texts that are `trusted`, and of all: each task adds up its own, Spark adds up the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        waiting: tuple[list, list] = ([], [])

        def add(side: int) -> None:
            if waiting[side]:
                totals[side] += np.bincount(np.concatenate(waiting[side]), minlength=BUCKETS)
                waiting[side].clear()

        size = 0
        for batch in batches:
            for text, trusted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = ngrams(word_hashes(_WORD.findall(text or "")))
                waiting[bool(trusted)].append(grams)
                size += len(grams)
                if size > BUCKETS:
                    size = 0
                    for side in (0, 1):
                        add(side)
        for side in (0, 1):
            add(side)
        at = np.flatnonzero(totals.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[1][at]), pa.array(totals.sum(0)[at])], names=["b", "t", "n"])

    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    got = docs.select("text", "trusted").mapInArrow(run, "b long, t long, n long").groupBy("b").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    target[got["b"].to_numpy()], raw[got["b"].to_numpy()] = got["t"].to_numpy(), got["n"].to_numpy()
    return target, raw


def maybe_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` with the column `maybe`: true where the row's doc_id is among `ids` (doc_id), and for some others; no shuffle of docs.

    The ids are one bit each in 2^MAP_BITS words of 64, by a hash; the words, so many at most for any number of ids, are broadcast.
    """
    hashed = F.xxhash64(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.lit("trusted map"))
    word, bit = F.shiftrightunsigned(hashed, 64 - MAP_BITS), F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(F.lit(63)).cast("int"))
    words = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = docs.join(F.broadcast(words), word == F.col("_word"), "left")
    return met.select(*docs.columns, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)).alias("maybe"))


def fit(docs: DataFrame, labels: DataFrame) -> Ratio:
    """The model, from all trusted documents. What reaches the driver is a row a bucket, two figures of the scores and one score."""
    apart = F.pmod(F.shiftright(F.xxhash64("doc_id", F.lit("trusted sample")), 20), F.lit(CALIBRATION)) == 0
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    counted = good.where(~apart).select(F.col("doc_id").alias("_id"), F.lit(True).alias("trusted"))
    texts = maybe_in(docs.select("doc_id", "text"), good)
    # The split goes by the id alone, so that each text meets one side's labels only. One kind of join at all sizes: labels that are
    # few enough to broadcast today wouldn't be in a larger table.
    joined = texts.where(F.col("maybe") & ~apart).join(counted.hint("merge"), F.col("doc_id") == F.col("_id"), "left").select("text", "trusted")
    target, raw = _counted(joined.union(texts.where(~F.col("maybe") | apart).select("text", F.lit(None).cast("boolean"))))
    if not target.sum():
        return Ratio(np.zeros(BUCKETS), None)
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    model = Ratio(np.log(p / q), None)
    with scratch():
        own = judge(texts.where(F.col("maybe") & apart).join(good.where(apart).hint("merge"), "doc_id", "left_semi"), model).where("NOT base_failed").select("score")
        own = staged(own, "calibration")
        n, spread = own.agg(F.count("score"), F.stddev_pop("score")).first()
        if n:
            at = KEEP_SHARE * n
            least = with_place(own, [F.col("score").asc()], "at").where(F.col("at") == int(at)).first().score
            model.threshold = float(least - MARGIN * spread / np.sqrt(1 + at))
    return model


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Ratio, text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = _WORD.findall(text)
                hashes = word_hashes(words)
                n, repeats = len(words), repeated_words(hashes, words)
                failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
                score = own.score(hashes)
                kept = not failed and (own.threshold is None or score >= own.threshold)
                for out, x in zip(rows, (n, sum(map(len, words)), sum(map(text.count, _SYMBOLS)), repeated_lines(text), repeats, failed, score, kept), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in rows[:5]], pa.array(rows[5], pa.bool_()), pa.array(rows[6], pa.float64()), pa.array(rows[7], pa.bool_())], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, score double, kept boolean")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
