"""Operator 7: packing token sequences by lexical retrieval.

Documents are tokenised once and dealt into shards of about SHARD_TOKENS tokens by their rarest shared token (the one in
fewest documents, of those in two or more), so that texts on like matters meet. A shard is an inverted index with BM25 weights (term statistics are the whole corpus's; terms are
token ids, so the table of them has the vocabulary's size). Its documents are seeds in turn: the seed opens a window, and
its unused neighbours fill it by falling score; the one that overflows is cut, and its rest stays unused. Every window of a
shard is full but the last.

Words are tokenised through a memo of bounded size, since the tokenizer treats what stands between white space on its own.
The memo finds words by one 64-bit key and proves them by a second, independent one; a word that fails is tokenised for itself.

Defined cases: a null or empty text has the end id alone; rows that repeat an id are packed each for itself, and so are
copies; a document longer than a window fills windows of its own and its rest is packed; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import staged, table
from .hashed import Map, Runs, WordKeys, grown, word_edges

WINDOW, END_ID = 2048, 1
SHARD_TOKENS, SHARD_ROWS = 1_000_000, 4096
#: A task packs its shards one after the other, at most about so many.
TASK_SHARDS = 16
K1, B = 1.2, 0.75
#: Words that a worker remembers, half of 2^MEMO_BITS, and their ids in all; when there are more it begins anew.
MEMO_BITS, MEMO_IDS = 20, 4 << 20
#: Longer words are left to the tokenizer alone. Texts are taken so many bytes at a time; longer ones go word by word.
LONG_WORD, CHUNK = 200, 1 << 18
_LOADED: dict = {}
#: Words of letters up to U+017F, each of which is lower-cased to one of them (but for U+0130).
_SIMPLE = re.compile(rb"(?:[\x21-\x7e]|\xc2[\xa1-\xac\xae-\xbf]|[\xc3\xc5][\x80-\xbf]|\xc4[\x80-\xaf\xb1-\xbf])+")
_RANGE = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180))]
_LETTERS, _NUMBERS = ("".join(re.escape(c) for c in _RANGE if unicodedata.category(c)[0] == k) for k in "LN")
#: How the tokenizer splits such words; a line feed stands between them here.
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|\n|[^\\s{_LETTERS}{_NUMBERS}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """A tokenizer's byte-pair merges on parts that are normalised and split already, through ranks of byte strings.

    A zero byte after each part stands for the vocabulary's mark of a part's end. Merging by rank gives the tokenizer's own
    ids, as each token comes of one merge alone; ValueError for another sort of vocabulary.
    """

    def __init__(self, tok) -> None:
        import tiktoken

        model = json.loads(tok.to_str())["model"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(plain)))}
        mark = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not mark or any(c not in model["vocab"] or c + mark not in model["vocab"] for c in of):
            raise ValueError("not a byte-level vocabulary with marked ends")
        raw = lambda t: bytes(map(of.__getitem__, t.removesuffix(mark))) + b"\0" * t.endswith(mark)
        tokens = [*of, *(c + mark for c in of), *("".join(m) for m in model["merges"])]
        ranks = {raw(t): k for k, t in enumerate(tokens)}
        if len(ranks) < len(tokens):
            raise ValueError("several merges make one token")
        self.ids = np.array([model["vocab"][t] for t in tokens])
        self.last = np.array([t.endswith(mark) for t in tokens])
        self.coder = tiktoken.Encoding("merges", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All the parts' ids, and where each part's end."""
        got = np.array(self.coder.encode_ordinary("\0".join(parts) + "\0"))
        return self.ids[got], np.flatnonzero(self.last[got]) + 1


class Tokens:
    """The tokenizer behind a memo of words, since it treats what stands between white space on its own.

    The memo goes by 64-bit keys of the words' bytes and is a few flat arrays; the words of many texts are looked up at once.
    `key_bits` shortens the keys that it goes by, for tests of equal keys.
    """

    def __init__(self, path: str, key_bits: int = 64) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        try:
            self.merges = Merges(self.tok)
        except ValueError:
            self.merges = None
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.words, self.drop = WordKeys(2), np.uint64(64 - key_bits)
        self.forget()

    def forget(self) -> None:
        self.map, self.ids, self.proofs = Map(MEMO_BITS), Runs(self.dtype), np.zeros(1 << 14, np.uint64)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian numbers of 2 bytes where the vocabulary allows, else 4."""
        out, group, size = [], [], 0
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            if b"<|" not in data:  # which may be a special token, and those have a case
                data = data.lower()
            if size + len(data) + 1 > CHUNK:
                out += self._together(group)
                group, size = [], 0
            if len(data) >= CHUNK:
                out.append(self._alone(data))
            else:
                group.append(data)
                size += len(data) + 1
        return out + self._together(group)

    def _alone(self, data: bytes) -> bytes:
        words = data.split()
        known: dict[bytes, bytes] = {}
        for lo in range(0, len(words), 50_000):
            new = list(set(words[lo : lo + 50_000]).difference(known))
            ids, sizes = self._encode(new)
            stops = (np.cumsum(sizes) * self.dtype.itemsize).tolist()
            data = ids.tobytes()
            known.update((w, data[a:b]) for w, a, b in zip(new, [0, *stops], stops, strict=False))
        return b"".join([*map(known.__getitem__, words), self.end])

    def _together(self, group: list[bytes]) -> list[bytes]:
        if not group:
            return []
        if self.ids.used > MEMO_IDS or self.map.room() < CHUNK // 2:
            self.forget()
        data = b" ".join(group)
        x = np.frombuffer(data, np.uint8)
        starts, stops = word_edges(x)
        keys, proofs = self.words.keys(x, starts, stops)
        keys = keys >> self.drop << self.drop
        at = self.map.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            own, one, where = np.unique(keys[missing], return_index=True, return_inverse=True)
            one = missing[one]
            at[missing] = self._remember(data, starts[one], stops[one], proofs[one]) + where
            self.map.add(own, at[one])
        strange = np.flatnonzero(self.proofs[at] != proofs)
        if len(strange):  # the key of another word: its ids are added without the key
            at[strange] = self._remember(data, starts[strange], stops[strange], proofs[strange]) + np.arange(len(strange))
        ids, ends = self.ids.joined(at)
        lengths = np.array([len(d) for d in group]) + 1
        last = np.searchsorted(starts, np.cumsum(lengths))  # words up to the end of each text
        cuts = (np.concatenate([[0], ends])[last] * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[lo:hi] + self.end for lo, hi in zip([0, *cuts], cuts, strict=False)]

    def _remember(self, data: bytes, starts: np.ndarray, stops: np.ndarray, proofs: np.ndarray) -> int:
        """Adds the words' ids and proofs; the place of the first."""
        ids, sizes = self._encode([data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
        first = self.ids.add(ids, sizes)
        self.proofs = grown(self.proofs, first, len(proofs))
        self.proofs[first : first + len(proofs)] = proofs
        return first

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All the words' ids in order, and how many each has."""
        fit = np.array([self.merges is not None and len(w) <= LONG_WORD and b"<|" not in w and _SIMPLE.fullmatch(w) is not None for w in words])
        sizes, ids = np.zeros(len(words), np.int64), np.zeros(0, np.int64)
        simple, whole = np.flatnonzero(fit), np.flatnonzero(~fit).tolist()
        if len(simple):
            parts = _PART.findall(b"\n".join([words[k] for k in simple.tolist()]).decode().lower())
            feed = np.array([p == "\n" for p in parts])
            ids, stops = self.merges.encode([p for p in parts if p != "\n"])
            parts_so_far = np.cumsum(~feed)
            sizes[simple] = np.diff(stops[np.append(parts_so_far[feed], parts_so_far[-1]) - 1], prepend=0)
        if whole:
            more = [e.ids for e in self.tok.encode_batch_fast([words[k].decode("utf-8", "surrogatepass") for k in whole], add_special_tokens=False)]
            sizes[whole] = [len(x) for x in more]
            both = np.zeros(int(sizes.sum()), np.int64)
            own = np.repeat(~fit, sizes)
            both[~own], both[own] = ids, [i for x in more for i in x]
            ids = both
        return ids.astype(self.dtype), sizes


def _load(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


@lru_cache
def _vocabulary(path: str) -> int:
    """The number of ids, for the driver, which need not hold a tokenizer."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _dtype(path: str) -> str:
    return "<u2" if _vocabulary(path) <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Staged (row, doc_id, ids, n): each document's ids and their number; row numbers tell repeated ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = own.encode_all([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // own.dtype.itemsize for x in ids], pa.int64())], names=["doc_id", "ids", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, ids binary, n long")
    return staged(out.withColumn("row", F.monotonically_increasing_id()), "tokens")


def term_statistics(tokens: DataFrame, kind: str, size: int) -> np.ndarray:
    """In how many documents each of the vocabulary's `size` ids is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                own = np.frombuffer(ids, kind)
                at = np.arange(len(own))
                place[own] = at  # the last of equal ids
                total[own[place[own] == at]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "n"])

    rows = tokens.select("ids").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.t] = r.n
    return out


def rarity(df: np.ndarray) -> np.ndarray:
    """Each id's rank by the documents that it is in, those of one document alone last."""
    out = np.empty(len(df), np.int64)
    out[np.lexsort((np.arange(len(df)), df, df < 2))] = np.arange(len(df))
    return out


def keyed(tokens: DataFrame, kind: str, df: np.ndarray) -> DataFrame:
    """(doc_id, row, ids, key): key is the rank of each document's rarest shared id."""
    shared = tokens.sparkSession.sparkContext.broadcast(rarity(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            keys = [int(rank[np.frombuffer(ids, kind)].min()) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "key"])

    rows = tokens.select("doc_id", "row", "ids")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())]))


class Index:
    """BM25 over the pieces of one shard."""

    def __init__(self, pieces: list[np.ndarray], df: np.ndarray, n_docs: int) -> None:
        idf = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), 0)  # terms in over half of all documents weigh nothing
        self.terms: list[np.ndarray] = []
        docs, terms, tfs = [], [], []
        for i, p in enumerate(pieces):
            own, tf = np.unique(p, return_counts=True)
            use = idf[own] > 0
            self.terms.append(own[use])
            terms.append(own[use])
            tfs.append(tf[use].astype(np.int32))
            docs.append(np.full(int(use.sum()), i, np.int32))
        term, doc, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, docs, tfs))
        length = np.array([len(p) for p in pieces], float)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(length.mean() if len(length) else 1, 1)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(df) + 1))
        self.n = len(pieces)

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[seed]
        lo, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(terms) else np.zeros(0, np.int64)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(lengths: list[int], rests: list[np.ndarray], df: np.ndarray, n_docs: int, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (document, start, length). lengths: tokens of each document; rests: its ids past its own full windows."""
    for i, n in enumerate(lengths):
        for lo in range(0, n - n % window, window):
            yield [(i, lo, window)]
    live = [i for i, n in enumerate(lengths) if n % window]
    index = Index([rests[i] for i in live], df, n_docs)
    start = np.array([lengths[i] - lengths[i] % window for i in live])
    left = np.array([lengths[i] % window for i in live])
    at = 0
    while True:
        while at < len(live) and not left[at]:
            at += 1
        if at == len(live):
            return
        out, room = [], window

        def take(k: int) -> None:
            nonlocal room
            n = int(min(room, left[k]))
            out.append((live[k], int(start[k]), n))
            start[k] += n
            left[k] -= n
            room -= n

        score = index.scores(at)
        take(at)
        if room:
            score[left == 0] = -1
            near = np.flatnonzero(score > 0)
            for k in near[np.argsort(-score[near], kind="stable")]:
                if not room:
                    break
                take(k)
            k = at
            while room and k < len(live):  # no neighbour is left: the next seeds fill the window
                if left[k]:
                    take(k)
                k += 1
        yield out


def pack(docs: DataFrame, path: str | None = None, text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    path = path or default_tokenizer()
    spark = docs.sparkSession
    tokens = token_table(docs, path, text)
    kind = _dtype(path)
    df = term_statistics(tokens, kind, _vocabulary(path))
    got = tokens.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")).first()
    n_docs, shards = got.docs, max(1, math.ceil((got.tokens or 0) / SHARD_TOKENS), math.ceil(got.docs / SHARD_ROWS))
    shared = spark.sparkContext.broadcast(df)  # the vocabulary's size
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    dealt = keyed(tokens, kind, df)
    parts = max(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), math.ceil(shards / TASK_SHARDS))
    dealt = dealt.withColumn("mix", F.xxhash64("row")).repartitionByRange(parts, "key", "mix").sortWithinPartitions("key", "mix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _LOADED.values():
            own.forget()  # a worker that goes on from the tokens needs its memory now
        part, windows = TaskContext.get().partitionId() << 33, 0
        for ids_of, texts in _shards(batches, kind):
            lengths, rows = [len(x) for x in texts], []
            for pieces in pack_shard(lengths, [x[len(x) - len(x) % window :] for x in texts], shared.value, n_docs, window):
                offset = 0
                for i, start, n in pieces:
                    rows.append((ids_of[i], start, n, zlib.crc32(texts[i][start : start + n].astype("<u4").tobytes()), lengths[i], part + windows, offset))
                    offset += n
                windows += 1
                if len(rows) > 20_000:
                    yield _batch(rows, id_type)
                    rows = []
            if rows:
                yield _batch(rows, id_type)

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    out = dealt.select("doc_id", "ids").mapInArrow(run, f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out


def _shards(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The rows in order, cut where a shard is full."""
    ids_of, texts, size = [], [], 0
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids_of.append(doc_id)
            texts.append(np.frombuffer(data, kind))
            size += len(texts[-1])
            if size >= SHARD_TOKENS or len(texts) >= SHARD_ROWS:
                yield ids_of, texts
                ids_of, texts, size = [], [], 0
    if texts:
        yield ids_of, texts


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents that are left."""
    return pack(docs)
