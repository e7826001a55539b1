"""Operator 6: SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Words are segmented by byte-pair merges: an agenda holds adjacent pairs that make a piece, best score first and leftmost of
equals; each pair that comes up is merged, unless a keyed hash skips it for good. Skips are drawn for each occurrence of a
word: the hash of (seed, document key, the word's place in the text, skips so far) says how many candidates are merged before
the next one is skipped, a geometric number, so that each candidate is skipped with the probability `dropout` whatever the
others. Equal words of one text are thus cut in many ways, and a run can be repeated anywhere: a lost task gives the same ids
again. With dropout 0 the ids are those of the library's own encoder. The model file is read, never trained; only pieces and
scores are taken from it.

What a word becomes depends on its skips alone, so a bounded memo holds for each word a tree: its plain segmentation, and
below it those after a skip at one candidate or another. Segmentations that the memo lacks are made many at a time in numpy,
where the agenda of each word is a row and one step takes the best candidate of every row.

Segmentations decode to the text whatever was skipped: a literal U+2581, which stands for a space inside the model, is
written as bytes, and so is every character that has no piece.

Defined cases: a null text has null ids and decodes to null, an empty one has none and decodes to the empty text; repeated
rows of an id are encoded alike; words of any length are segmented whole; other columns pass through.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .hashed import SPREAD, Map, Runs, Spans, grown, mixed

SPACE_MARK = "▁"
DROPOUT, SEED = 0.1, 1
#: Words, and segmentations after skips, that a worker remembers, each half of 2^MEMO_BITS; when there are more it begins anew.
MEMO_BITS = 20
#: Words of up to so many characters are segmented many at a time; so many such rows at once.
SHORT_WORD, ROWS = 40, 4096
#: Texts are taken so many characters at a time, words so many at a time.
_CHUNK, _WORDS = 1 << 20, 1 << 17
_NONE, _SLOT_BITS = np.iinfo(np.int32).max, 19
#: More candidates than a short word can have: no skip.
_FAR = 63
#: Stands for a literal space mark between normalisation and pieces; twice, for a text's own U+E000. Both are written as bytes.
_LITERAL = "\ue000"
_LOADED: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_ALL, _BASE = (1 << 64) - 1, SPREAD[0]
_POWER = np.array([pow(int(_BASE), k, 1 << 64) for k in range(SHORT_WORD + 1)], np.uint64)


def _prints(texts: list[str]) -> np.ndarray:
    """Each text as a number to the base _BASE modulo 2^64."""
    out = []
    for t in texts:
        x = 0
        for c in t:
            x = (x * int(_BASE) + ord(c) + 1) & _ALL
        out.append(x)
    return np.array(out, np.uint64)


def _slot(prints: np.ndarray) -> np.ndarray:
    return prints * SPREAD[4] >> np.uint64(64 - _SLOT_BITS)


def _occurrence(keys: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """The hash that the skips of a word's occurrence are drawn from."""
    return mixed(mixed(keys ^ np.uint64(seed * int(SPREAD[1]) & _ALL)) + places * SPREAD[2])


def _gaps(own: np.ndarray, skips: int, dropout: float, most: int) -> np.ndarray:
    """How many candidates are merged before the next is skipped, after so many skips: geometric, and `most` at most."""
    left = np.array([min(_ALL, int((1 - dropout) ** k * 2.0**64)) for k in range(most, 0, -1)], np.uint64)
    x = mixed(own + np.uint64((skips + 1) * int(SPREAD[2]) & _ALL))
    return most - np.searchsorted(left, x, side="right")


def _each_gap(own: np.ndarray, dropout: float) -> Iterator[int]:
    skips = 0
    while dropout > 0:
        gap, far = 0, 1 << 10
        gap = int(_gaps(own, skips, dropout, far)[0])
        yield gap if gap < far else -1
        skips += 1


class Vocabulary:
    """Pieces by text, their ranks (0 is merged first), and the bytes that each id decodes to."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        score = {i: model.get_score(i) for i in plain}
        self.rank = {model.id_to_piece(i): -score[i] for i in plain}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte fallback: some texts would not decode")
        self.decoded: list[bytes] = [b""] * n
        for p, i in self.ids.items():
            self.decoded[i] = p.replace(SPACE_MARK, " ").encode()
        for b, i in self.byte.items():
            self.decoded[i] = bytes([b])
        # Where no merge can reach across, a word ends: before a space mark, at a line feed, and between a run of letters
        # or digits and a mark, where no piece has the mark after the run's last character.
        marks = re.escape(string.punctuation)
        behind: dict[str, set[str]] = {c: set() for c in string.punctuation}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                if b in behind and a not in string.punctuation + SPACE_MARK:
                    behind[b].add(a)
        ends = "".join(re.escape(c) for c, before in behind.items() if not before)
        some = "".join(f"|(?<![{''.join(map(re.escape, sorted(before)))}])(?={re.escape(c)})" for c, before in behind.items() if before)
        stop = f"(?:(?=[{SPACE_MARK}\n{_LITERAL}{ends}]|$){some})"
        self.word = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\n{_LITERAL}{marks}]+{stop}|{SPACE_MARK}*[^{SPACE_MARK}\n{_LITERAL}]+|{SPACE_MARK}+|\n|{_LITERAL}")
        _, level = np.unique([self.rank[t] for t in self.ids], return_inverse=True)
        self.level = dict(zip(self.ids, level.tolist(), strict=True))
        self.decoded_size = np.array([len(x) for x in self.decoded])
        self.decoded_start = np.cumsum(self.decoded_size) - self.decoded_size
        self.decoded_all = np.frombuffer(b"".join(self.decoded), np.uint8)
        self._index(_prints(list(self.ids)), level)
        self.spans = Spans(1 << 16)
        self.forget()

    def _index(self, prints: np.ndarray, level: np.ndarray) -> None:
        """A table of pieces by print: one to a slot, the rest sorted. An empty slot points to a piece of another slot."""
        ids = np.array(list(self.ids.values()), np.int32)
        slots = _slot(prints)
        order = np.argsort(slots, kind="stable")
        alone = np.concatenate([[True], np.diff(slots[order].astype(np.int64)) > 0])
        order = np.concatenate([order[alone], (rest := order[~alone])[np.argsort(prints[rest])]])
        self.prints, self.print_level, self.print_id = prints[order], level[order].astype(np.int32), ids[order]
        self.n_alone = int(alone.sum())
        self.table = np.zeros(1 << _SLOT_BITS, np.int32)
        self.table[slots[order[: self.n_alone]]] = np.arange(self.n_alone)
        self.crowded = np.zeros(1 << _SLOT_BITS, bool)
        self.crowded[slots[order[self.n_alone :]]] = True

    def _found(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each print's piece is, and whether there is one."""
        slot = _slot(prints)
        at = self.table[slot]
        hit = self.prints[at] == prints
        if len(more := np.flatnonzero(~hit & self.crowded[slot])):
            k = np.minimum(self.n_alone + np.searchsorted(self.prints[self.n_alone :], prints[more]), len(self.prints) - 1)
            at[more], hit[more] = k, self.prints[k] == prints[more]
        return at, hit

    def forget(self) -> None:
        """Begins a new memo. Nodes have a segmentation, the number of candidates after its last skip, and what they come of: -1
        for a plain one, else the node before the last skip, times 64, and the gap before it."""
        self.root, self.child = Map(MEMO_BITS), Map(MEMO_BITS)
        self.runs = Runs(np.dtype(np.int32))
        self.open, self.link = np.zeros(1 << 14, np.int16), np.zeros(1 << 14, np.int64)

    def segment(self, word: str, gaps: Iterator[int]) -> tuple[list[int], int]:
        """Ids of one word, and how many candidates came up after the last skip. gaps: how many candidates are merged before
        the next is skipped. Symbols are spans [i, end[i]) of the word; a merged span takes in its right neighbour."""
        if word in (_LITERAL, _LITERAL * 2):
            return [self.byte[b] for b in (SPACE_MARK if word == _LITERAL else _LITERAL).encode()], 0
        n, level = len(word), self.level
        end, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        agenda = [(level[p], i, i + 1, i + 2) for i in range(n - 1) if (p := word[i : i + 2]) in level]
        heapq.heapify(agenda)
        gap, since = next(gaps, -1), 0
        while agenda:
            _, i, m, stop = heapq.heappop(agenda)
            if dead[i] or end[i] != m or end[m] != stop:
                continue  # a neighbour was merged meanwhile
            if since == gap:
                gap, since = next(gaps, -1), 0
                continue
            since += 1
            end[i], dead[m] = stop, True
            if stop < n:
                before[stop] = i
                if (p := word[i : end[stop]]) in level:
                    heapq.heappush(agenda, (level[p], i, stop, end[stop]))
            if (j := before[i]) >= 0 and (p := word[j:stop]) in level:
                heapq.heappush(agenda, (level[p], j, i, stop))
        out, i = [], 0
        while i < n:  # what is no piece is written as bytes
            piece = word[i : end[i]]
            at = self.ids.get(piece)
            out += [at] if at is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
            i = end[i]
        return out, since

    def _segment_rows(self, words: list[str], gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """segment() of many short words at a time: all ids in order, how many each word has, and the candidates after its last
        skip. gaps: a row for each word, -1 where there is no further skip. Strings go by 64-bit prints here. Words with a
        character that has no piece are left to segment()."""
        n = np.array([len(w) for w in words])
        rows, width = len(words), int(n.max())
        chars = np.zeros((rows, width), np.uint64)
        cells = np.arange(width) < n[:, None]
        chars[cells] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        upto = np.zeros((rows, width + 1), np.uint64)
        for k in range(width):
            upto[:, k + 1] = upto[:, k] * _BASE + chars[:, k] + np.uint64(1)
        _, known = self._found((chars + np.uint64(1))[cells])
        whole = np.ones(rows, bool)
        whole[np.repeat(np.arange(rows), n)[~known]] = False
        def level_of(r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            at, hit = self._found(upto[r, hi] - upto[r, lo] * _POWER[hi - lo])
            return np.where(hit, self.print_level[at], _NONE)

        end = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        best = np.full((rows, width), _NONE, np.int32)
        r, i = np.nonzero(cells[:, 1:])
        best[r, i] = level_of(r, i, i + 2)
        turn, since, live = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.flatnonzero(whole & (n > 1))
        while len(live):
            i = best[live].argmin(axis=1)
            some = best[live, i] < _NONE
            live, i = live[some], i[some]
            skip = since[live] == gaps[live, turn[live]]
            r = live[skip]
            best[r, i[skip]] = _NONE
            turn[r] += 1
            since[r] = 0
            r, i = live[~skip], i[~skip]
            since[r] += 1
            m = end[r, i]
            stop = end[r, m]
            end[r, i] = stop
            best[r, m] = _NONE
            cells[r, m] = False
            best[r, i] = _NONE
            more = stop < n[r]
            a, b, c = r[more], i[more], stop[more]
            before[a, c] = b
            best[a, b] = level_of(a, b, end[a, c])
            j = before[r, i]
            more = j >= 0
            a, b, c = r[more], j[more], stop[more]
            best[a, b] = level_of(a, b, c)
        cells &= whole[:, None]
        r, i = np.nonzero(cells)
        hi = end[r, i]
        at, _ = self._found(upto[r, hi] - upto[r, i] * _POWER[hi - i])
        ids, sizes = self.print_id[at], cells.sum(axis=1)
        if not whole.all():
            more = []
            for k in np.flatnonzero(~whole).tolist():
                own, since[k] = self.segment(words[k], iter(gaps[k].tolist()))
                sizes[k] = len(own)
                more += own
            both, own = np.zeros(int(sizes.sum()), np.int32), np.repeat(whole, sizes)
            both[own], both[~own] = ids, more
            ids = both
        return ids, sizes, since

    def _nodes(self, words: list[str], links: np.ndarray, skips: int) -> np.ndarray:
        """The places of new nodes for words after so many skips; links: what they come of."""
        gaps, at = np.full((len(words), skips + 1), -1), links
        for k in range(skips - 1, -1, -1):
            gaps[:, k] = at & 63
            at = self.link[at >> 6]
        order, first = np.argsort(np.array(list(map(len, words))), kind="stable"), self.runs.n
        self.open, self.link = grown(self.open, first, len(words)), grown(self.link, first, len(words))
        self.link[first : first + len(words)] = links[order]
        for lo in range(0, len(order), ROWS):
            some = order[lo : lo + ROWS]
            ids, sizes, since = self._segment_rows([words[k] for k in some.tolist()], gaps[some])
            at = self.runs.add(ids, sizes)
            self.open[at : at + len(some)] = since
        out = np.empty(len(words), np.int64)
        out[order] = np.arange(first, first + len(words))
        return out

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in order, some at a time; a space is put first, as the library does."""
        for k, part in enumerate(re.split(f"({_LITERAL})", text) if _LITERAL in text else [text]):
            if k % 2:
                yield [_LITERAL * 2]
                continue
            marked = ("" if k else SPACE_MARK) + part.replace(SPACE_MARK, _LITERAL).replace(" ", SPACE_MARK)
            lo = 0
            while lo < len(marked):
                hi = lo + _CHUNK
                while 0 < hi < len(marked) and marked[hi - 1] == SPACE_MARK:
                    hi = marked.find(SPACE_MARK, hi + 1) if marked[hi] != SPACE_MARK else hi + 1
                hi = marked.find(SPACE_MARK, hi) if 0 < hi < len(marked) else len(marked)
                hi = len(marked) if hi < 0 else hi
                yield self.word.findall(marked, lo, hi)
                lo = hi

    def encode(self, text: str, dropout: float, seed: int, key: int) -> bytes:
        """Little-endian 4-byte ids; key: the document's."""
        return self.encode_all([text], [key], dropout, seed)[0]

    def encode_all(self, texts: list[str], keys: list[int], dropout: float, seed: int) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        words, of, places = [], [], []  # the words, and of runs of them the text, the first one's place in it, and the end
        for k, text in enumerate(texts):
            at = 0
            for own in self._words(text) if text else ():
                for lo in range(0, len(own), _WORDS):
                    some = own[lo : lo + _WORDS]
                    if len(words) + len(some) > _WORDS:
                        self._put(out, words, of, places, keys, dropout, seed)
                        words, of, places = [], [], []
                    words += some
                    of.append(k)
                    places.append((at, len(some)))
                    at += len(some)
        self._put(out, words, of, places, keys, dropout, seed)
        return [b"".join(x) for x in out]

    def _put(self, out: list[list[bytes]], words: list[str], of: list[int], places: list[tuple[int, int]], keys: list[int], dropout: float, seed: int) -> None:
        if not words:
            return
        first, sizes = np.array(places).T
        own = np.repeat(np.array([keys[k] & _ALL for k in of], np.uint64), sizes)
        at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)
        nodes = self._placed(words, _occurrence(own, at.astype(np.uint64), seed), dropout)  # may begin a new memo
        ids, stops = self.runs.joined(nodes)
        data, ends = ids.astype("<i4").tobytes(), (4 * stops[np.cumsum(sizes) - 1]).tolist()
        for k, lo, hi in zip(of, [0, *ends], ends, strict=False):
            out[k].append(data[lo:hi])

    def _placed(self, words: list[str], own: np.ndarray, dropout: float) -> np.ndarray:
        """The node of each word; own: the hashes of the occurrences."""
        if min(self.root.room(), self.child.room()) < len(words) or self.runs.used > 1 << 24:
            self.forget()
        size = np.array(list(map(len, words)))
        short = (size > 0) & (size <= SHORT_WORD)
        long = np.flatnonzero(~short).tolist()
        prints = self.spans.keys_in_a_row(np.frombuffer("".join(words if not long else [w for w, ok in zip(words, short.tolist(), strict=True) if ok]).encode("utf-32-le", "surrogatepass"), "<u4"), size[short])
        cur = np.full(len(words), -1, np.int64)
        cur[short] = self.root.find(prints)
        missing = np.flatnonzero(cur[short] < 0)
        if len(missing):
            new, one, where = np.unique(prints[missing], return_index=True, return_inverse=True)
            at = np.flatnonzero(short)[missing]
            made = self._nodes([words[k] for k in at[one].tolist()], np.full(len(new), -1), 0)
            self.root.add(new, made)
            cur[at] = made[where]
        live, skips = np.flatnonzero(short) if dropout > 0 else np.zeros(0, np.int64), 0
        while len(live):
            gap = _gaps(own[live], skips, dropout, _FAR)
            some = gap < self.open[cur[live]]
            live = live[some]
            if not len(live):
                break
            skips += 1
            links = cur[live] << 6 | gap[some]
            prints = mixed(links.astype(np.uint64) + np.uint64(1))
            below = self.child.find(prints).astype(np.int64)
            missing = np.flatnonzero(below < 0)
            if len(missing):
                new, one, where = np.unique(prints[missing], return_index=True, return_inverse=True)
                made = self._nodes([words[k] for k in live[missing[one]].tolist()], links[missing[one]], skips)
                if len(new) <= self.child.room():
                    self.child.add(new, made)
                below[missing] = made[where]
            cur[live] = below
        for k in long:  # each occurrence for itself
            ids = np.array(self.segment(words[k], _each_gap(own[k : k + 1], dropout))[0], np.int32)
            cur[k] = self.runs.add(ids, np.array([len(ids)]))
            self.open, self.link = grown(self.open, self.runs.n, 0), grown(self.link, self.runs.n, 0)
        return cur

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of so many ids each."""
        size = self.decoded_size[ids]
        stops = np.cumsum(size)
        at = np.repeat(self.decoded_start[ids] - (stops - size), size)
        at += np.arange(len(at))
        data, stops = self.decoded_all[at].tobytes(), np.concatenate([[0], stops])
        edges = stops[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        # Each without the space put first.
        return [data[lo:hi].decode("utf-8", "surrogatepass")[1:] for lo, hi in zip(edges, edges[1:], strict=False)]


def _load(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """`docs` with `ids` (array<int>). Skips are drawn by the hash of a document's key. No shuffle."""
    path = path or default_model()
    kept = [f for f in docs.schema.fields if f.name != "ids"]
    at = [f.name for f in kept].index(text)
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.xxhash64(F.col(f"`{key}`")).alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(at).to_pylist()
                coded = own.encode_all([t or "" for t in texts], part.column(part.num_columns - 1).to_pylist(), dropout, seed)
                values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, values, mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[f.name for f in kept] + ["ids"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """`rows` with the text that `ids` stand for."""
    path = path or default_model()
    kept = [f for f in rows.schema.fields if f.name != out]
    rows = rows.select(*[F.col(f"`{f.name}`") for f in kept])
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                lists = part.column(at)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                there = lists.is_valid().to_pylist()
                texts = [t if ok else None for t, ok in zip(own.decode_all(lists.flatten().to_numpy(zero_copy_only=False), sizes), there, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with dropout and decoded again: digests of both, and whether they agree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs))
    crc = lambda c: F.crc32(F.coalesce(c, F.lit("")).cast("binary"))
    return back.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        crc(F.col("text")).alias("text_crc32"), crc(F.col("decoded")).alias("decoded_crc32"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"),
    )
