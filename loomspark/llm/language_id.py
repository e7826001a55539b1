"""Operator 8: language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its lower-cased byte n-grams, spaces included, hashed into buckets; the text's vector is the mean of
their embeddings, and a softmax layer over it gives the language. Both are trained by stochastic gradient descent in numpy
on a bounded sample of labelled documents (TRAIN_ROWS in all, shared evenly among languages; the sample is by a hash of the
id, so it is the same in each run). A part of the sample is kept from training to fit the softmax temperature. Snippets of SNIPPETS
characters cut from that part have temperatures of their own, since few subwords say little however far the scores are apart: a
text's temperature goes by its number of subwords, between those of the snippets and that of whole texts. The score below which a prediction is rejected is a quantile of that part and of up to REJECT_ROWS more documents, none of them trained on.
Documents are scored in Arrow batches where they lie; nothing is shuffled.

Defined cases: a text that is null or has no letter is `und` with score 0 and rejected; with no labelled row at all every
text is `und`; a null id counts as the empty text in the hold-out rule; repeated rows are predicted alike; other columns
pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BUCKETS, WIDTH, ORDERS = 8192, 16, (1, 2, 3, 4)
#: The bound of the training sample, in documents.
TRAIN_ROWS = 4000
#: The bound of the documents that the rejection score is read from, so that its quantile exists; their scores alone are collected.
REJECT_ROWS = 20_000
EPOCHS, RATE, BATCH = 12, 40.0, 32
#: Of the calibration documents, so many may fall below the rejection score, which never exceeds REJECT_MOST.
REJECT_SHARE, REJECT_MOST = 0.001, 0.5
#: Lengths, in characters, of the snippets of calibration documents that give short texts their temperatures.
SNIPPETS = (1, 2, 4, 8, 16, 32, 64)
_GRID = tuple(2.0**e for e in np.arange(-4, 3.25, 0.25))
#: Short texts may need far more.
_SHORT_GRID = tuple(2.0**e for e in np.arange(-4, 10.25, 0.25))
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 20


def subwords(text: str) -> np.ndarray:
    """Counts of the text's hashed subwords, one for each bucket; works through long texts in pieces."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out, most = np.zeros(BUCKETS, np.int64), max(ORDERS)
    for lo in range(0, len(data), _PIECE):
        own = min(_PIECE, len(data) - lo)
        x = data[lo : lo + own + most - 1].astype(np.uint32)
        rolled = np.zeros(len(x), np.uint32)
        for n in range(1, most + 1):
            rolled = rolled[: len(x) - n + 1] * np.uint32(263) + x[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                slot = (rolled[:own] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
                out += np.bincount(slot, minlength=BUCKETS)
    return out


@dataclass
class Model:
    """Languages, the product of embeddings and softmax weights (BUCKETS x languages), bias, temperature, rejection score; for
    short texts, pairs of a number of subwords and a temperature, by rising number."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    short: tuple[tuple[float, float], ...] = ()

    def heat(self, sizes: np.ndarray) -> np.ndarray:
        """The temperature of texts of so many subwords, by straight lines between logarithms."""
        if not self.short:
            return np.full(len(sizes), self.temperature)
        at, heats = zip(*self.short, (2 * self.short[-1][0], self.temperature), strict=True)
        return np.exp(np.interp(np.log(np.maximum(sizes, 1)), np.log(at), np.log(heats)))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        sizes = counts.sum(axis=1, keepdims=True)
        mean = (counts / np.maximum(sizes, 1e-9)).astype(np.float32)
        z = (mean @ self.weights + self.bias) / self.heat(sizes[:, 0])[:, None]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        real = [i for i, t in enumerate(texts) if self.langs and t and _LETTER.search(t)]
        for lo in range(0, len(real), 64):
            some = real[lo : lo + 64]
            p = self.scores(np.stack([subwords(texts[i]) for i in some]))
            for i, k, s in zip(some, p.argmax(axis=1), p.max(axis=1), strict=True):
                lang[i], score[i], rejected[i] = self.langs[k], min(1.0, float(s)), bool(s < self.reject_below)
        return lang, score, rejected


class Shares:
    """The documents' shares of each bucket, held sparse; some rows at a time are made dense."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.rows = rows

    def __getitem__(self, some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), BUCKETS), np.float32)
        for row, k in zip(out, some, strict=True):
            at, counts = self.rows[k]
            row[at] = counts / max(counts.sum(), 1)
        return out


def reject_score(best: np.ndarray) -> float:
    """The REJECT_SHARE quantile of the scores, never over REJECT_MOST; of under 1 / REJECT_SHARE scores it is the least."""
    best = np.sort(best)
    return float(min(REJECT_MOST, best[int(REJECT_SHARE * len(best))]))


def likeliest(logits: np.ndarray, y: np.ndarray, grid: tuple[float, ...]) -> float:
    """The temperature of the grid under which the true languages y are likeliest."""

    def loss(t: float) -> float:
        e = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
        return float(-np.log(np.maximum(e[np.arange(len(y)), y] / e.sum(axis=1), 1e-12)).mean())

    return min(grid, key=loss)


def snippets(text: str) -> list[tuple[int, str]]:
    """(length, snippet) for each of the lengths that the text is longer than, from a place that goes by its hash; those without a
    letter are left out."""
    at = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    out = [(n, text[lo : lo + n]) for n in SNIPPETS if len(text) > n for lo in (at % (len(text) - n),)]
    return [(n, t) for n, t in out if _LETTER.search(t)]


def train(names: list[str], x: Shares, held: np.ndarray, seed: int = 7) -> Model:
    """names: the documents' languages; x: their shares of each bucket; held: which are for calibration."""
    langs = sorted(set(names))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng, at = np.random.default_rng(seed), {lang: i for i, lang in enumerate(langs)}
    y, held = np.array([at[lang] for lang in names]), held.copy()
    if held.all() or not held.any() or len(set(y[~held].tolist())) < len(langs):
        held[:] = False
    own = np.flatnonzero(~held)
    embed = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    soft, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(EPOCHS):
        step = RATE * (1 - epoch / EPOCHS)
        for some in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            dense = x[some]
            mean = dense @ embed
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ soft.T
            soft -= 0.05 * step * (mean.T @ p)
            bias -= 0.01 * step * p.sum(axis=0)
            embed -= step * (dense.T @ back)
    model = Model(langs, embed @ soft, bias, 1.0, 0.0)
    test = np.flatnonzero(held) if held.any() else own
    logits = np.concatenate([x[some] @ model.weights + model.bias for some in np.array_split(test, max(1, len(test) // 256))])

    model.temperature = likeliest(logits, y[test], _GRID)
    e = np.exp((logits - logits.max(axis=1, keepdims=True)) / model.temperature)
    model.reject_below = reject_score((e / e.sum(axis=1, keepdims=True)).max(axis=1))
    return model


def heated(model: Model, lengths: np.ndarray, names: list[str], x: Shares) -> tuple[tuple[float, float], ...]:
    """Model.short from snippets of so many characters, their languages and shares. Shorter ones never have a lower temperature."""
    out, y = [], np.array([model.langs.index(n) if n in model.langs else -1 for n in names])
    for n in sorted(set(lengths.tolist()), reverse=True):
        some = np.flatnonzero((lengths == n) & (y >= 0))
        if len(some):
            logits = np.concatenate([x[part] @ model.weights + model.bias for part in np.array_split(some, max(1, len(some) // 256))])
            size = float(np.median([x.rows[k][1].sum() for k in some]))
            if not out or size < out[-1][0]:
                out.append((size, max(likeliest(logits, y[some], _SHORT_GRID), out[-1][1] if out else model.temperature)))
    return tuple(reversed(out))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from text and lang of documents that aren't held out: at most about `rows` of them reach the driver, as counts."""
    named = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in named.groupBy("lang").count().collect()}
    if not sizes:
        return train([], Shares([]), np.zeros(0, bool))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, rows / len(sizes) / n)))])
    pick = F.xxhash64(F.col("doc_id"), F.lit("language sample"))
    draw, bound = F.pmod(pick, F.lit(1 << 20)), share[F.col("lang")] * (1 << 20)
    cal = F.pmod(F.shiftright(pick, 20), F.lit(5)) == 0
    some = named.where(draw < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text, cal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for length, piece in [(0, text), *(snippets(text) if cal else ())]:
                    counts = subwords(piece)
                    nz = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([cal]), pa.array([length], pa.int32()), pa.array([nz.astype("<u2").tobytes()], pa.binary()), pa.array([counts[nz].astype("<u4").tobytes()], pa.binary())], names=["lang", "cal", "length", "at", "n"])

    got = some.select("lang", "text", cal.alias("cal")).mapInArrow(run, "lang string, cal boolean, length int, at binary, n binary").collect()
    got.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.n)))

    def shares(rows: list) -> Shares:
        return Shares([(np.frombuffer(r.at, "<u2"), np.frombuffer(r.n, "<u4")) for r in rows])

    whole, cut = [r for r in got if not r.length], [r for r in got if r.length]
    model = train([r.lang for r in whole], shares(whole), np.array([r.cal for r in whole], bool))
    model.short = heated(model, np.array([r.length for r in cut], int), [r.lang for r in cut], shares(cut))
    del got, whole, cut  # tens of MB of the driver
    more = F.create_map(*[v for lang, n in sizes.items() for v in (F.lit(lang), F.lit(REJECT_ROWS / len(sizes) / n))])[F.col("lang")] * (1 << 20)
    unseen = named.where((draw >= bound) & (draw < bound + more) | (draw < bound) & cal)
    best = np.array([r.score for r in identify(unseen.select("text"), model).where("lang_pred <> 'und'").select("score").collect()])
    if len(best):
        model.reject_below = reject_score(best)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and rejected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages
    at = docs.columns.index(text)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lang, score, rejected = own.predict(batch.column(at).to_pylist())
            cols = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in ("lang_pred", "score", "rejected")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is accepted stay, unchanged."""
    return identify(docs, fit(docs)).where(~F.col("rejected")).select(*docs.columns)
