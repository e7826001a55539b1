"""Lookups of many 64-bit keys at a time, in numpy: the memos of the tokenising operators."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd factors that spread bits.
SPREAD = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * SPREAD[4]
    x = (x ^ x >> np.uint64(29)) * SPREAD[3]
    return x ^ x >> np.uint64(32)


class Spans:
    """Keys of spans of a sequence of numbers: each span's number to an odd base modulo 2^64, its bits mixed."""

    def __init__(self, most: int) -> None:
        self.most = most
        inverse = np.uint64(pow(int(SPREAD[0]), -1, 1 << 64))
        self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(most, b, np.uint64))]) for b in (SPREAD[0], inverse))

    def keys(self, x: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """x: at most `most` numbers."""
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[: len(x)], out=total[1:])
        return mixed((total[stops] - total[starts]) * self.down[starts])

    def keys_in_a_row(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of spans that follow one another, of so many numbers each."""
        stops = np.cumsum(sizes)
        out, lo = np.zeros(len(sizes), np.uint64), 0
        while lo < len(sizes):
            at = int(stops[lo] - sizes[lo])
            hi = int(np.searchsorted(stops, at + self.most, side="right"))
            out[lo:hi] = self.keys(x[at : stops[hi - 1]], stops[lo:hi] - sizes[lo:hi] - at, stops[lo:hi] - at)
            lo = hi
        return out


#: Which bytes are no white space.
FILLED = np.ones(256, bool)
FILLED[list(b" \t\n\r\x0b\x0c")] = False


def word_edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's bytes begin and end."""
    edge = np.flatnonzero(np.diff(FILLED[x], prepend=False, append=False))
    return edge[::2], edge[1::2]


class WordKeys:
    """64-bit keys of words, `tables` independent ones of each: sums of random numbers, one for each byte at each place.

    Two words have one key with a chance of 2^-64 whatever they are, since a place where they differ adds a random difference.
    Words of more than PLACES bytes have XXH64 keys with a seed for each table.
    """

    PLACES = 64

    def __init__(self, tables: int = 1) -> None:
        random = np.random.Generator(np.random.PCG64(20))
        self.tables = [random.integers(0, 1 << 64, (self.PLACES, 256), np.uint64, endpoint=False) for _ in range(tables)]
        for t in self.tables:
            t[:, ~FILLED] = 0
        self.tables = [t.ravel() for t in self.tables]

    def keys(self, x: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
        """For each table, the keys of the words that word_edges() found in x; a few at a time, so that little is held."""
        out = [np.zeros(len(starts), np.uint64) for _ in self.tables]
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + (1 << 16), side="right")))
            begin = starts[lo:hi] - starts[lo]
            own = x[starts[lo] : stops[hi - 1]]
            place = np.arange(len(own), dtype=np.int32)
            place -= np.repeat(begin.astype(np.int32), np.diff(begin, append=len(own)))  # white space counts on, for nothing
            np.minimum(place, self.PLACES - 1, out=place)
            at = (place << 8) | own
            for k, t in enumerate(self.tables):
                out[k][lo:hi] = np.add.reduceat(t[at], begin)
            lo = hi
        for i in np.flatnonzero(stops - starts > self.PLACES).tolist():
            data = x[starts[i] : stops[i]].tobytes()
            for k in range(len(self.tables)):
                out[k][i] = xxhash.xxh64_intdigest(data, seed=k)
        return out


class Map:
    """Places of 64-bit keys, in a table of open addresses; up to half of its 2^bits slots may be used."""

    def __init__(self, bits: int) -> None:
        self.shift, self.mask, self.held = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def room(self) -> int:
        return (self.mask + 1) // 2 - self.held

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        keys = np.maximum(keys, np.uint64(1))  # 0 marks an empty slot
        slot = (keys >> self.shift).astype(np.int64)
        at = self.keys[slot]
        out = np.where(at == keys, self.places[slot], -1)
        live = np.flatnonzero((at != keys) & (at != 0))
        while len(live):
            slot[live] = (slot[live] + 1) & self.mask
            at, own = self.keys[slot[live]], keys[live]
            hit = at == own
            out[live[hit]] = self.places[slot[live[hit]]]
            live = live[~hit & (at != 0)]
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Distinct keys that aren't held yet."""
        keys = np.maximum(keys, np.uint64(1))
        slot, live = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        self.held += len(keys)
        while len(live):
            free = live[self.keys[slot[live]] == 0]
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot[live]] == keys[live]
            self.places[slot[live[own]]] = places[live[own]]
            live = live[~own]
            slot[live] = (slot[live] + 1) & self.mask


def grown(a: np.ndarray, used: int, more: int) -> np.ndarray:
    """`a` with room for so many more after those used."""
    return a if used + more <= len(a) else np.concatenate([a[:used], np.zeros(max(used, more, 1 << 10), a.dtype)])


class Runs:
    """Numbers in runs, one after the other in a growing array."""

    def __init__(self, dtype: np.dtype) -> None:
        self.data, self.start, self.size = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n, self.used = 0, 0

    def add(self, data: np.ndarray, sizes: np.ndarray) -> int:
        """Runs of so many numbers each; the place of the first."""
        first = self.n
        self.data = grown(self.data, self.used, len(data))
        self.start, self.size = (grown(a, self.n, len(sizes)) for a in (self.start, self.size))
        self.data[self.used : self.used + len(data)] = data
        self.size[first : first + len(sizes)] = sizes
        self.start[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(data)
        self.n += len(sizes)
        return first

    def joined(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at `places` in a row, and where each ends."""
        size = self.size[places]
        stops = np.cumsum(size)
        at = np.repeat(self.start[places] - (stops - size), size)
        at += np.arange(len(at))
        return self.data[at], stops
