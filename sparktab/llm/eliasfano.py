"""Elias-Fano sequences and an n-gram trie over them, as flat buffers that can be memory-mapped."""

from __future__ import annotations

import json
import struct

import numpy as np

#: Queries of more than one for so many values are answered together.
DENSE = 16
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
_BYTE_SELECT = np.zeros((256, 8), np.int64)  # place of the k-th one of a byte
for _b in range(256):
    for _k, _place in enumerate(i for i in range(8) if _b >> i & 1):
        _BYTE_SELECT[_b, _k] = _place


def _set_bits(n: int, at: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * ((n + 63) // 64 + 1), bool)
    bits[at] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


class EliasFano:
    """A sequence that never falls, in 2 + log2(universe / n) bits a value, with access and search by arrays of queries."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.mask = np.uint64((1 << width) - 1)
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * width + 63) // 64 + 2, np.uint64)
        if width:
            bits, part = np.arange(n) * width, values & np.uint64((1 << width) - 1)
            shift, word = (bits & 63).astype(np.uint64), bits >> 6
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero((bits & 63) + width > 64)  # one for a word at most
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        tops = (values >> np.uint64(width)).astype(np.int64)
        size = n + (int(tops[-1]) if n else 0) + 2
        high = _set_bits(size, tops + np.arange(n))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return cls(n, width, low, high, ones)

    def _in_word(self, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the rank-th one in each word."""
        at, rest = np.zeros(len(word), np.int64), rank.copy()
        open_ = np.ones(len(word), bool)
        found = np.zeros(len(word), np.uint8)
        for k in range(8):
            byte = ((word >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
            count = _BYTE_ONES[byte]
            here = open_ & (rest < count)
            at[here], found[here] = 8 * k, byte[here]
            open_ &= ~here
            rest = np.where(open_, rest - count, rest)
        return at + _BYTE_SELECT[found, np.minimum(rest, 7)]

    def select1(self, i: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.ones, i, "right") - 1
        return k * 64 + self._in_word(self.high[k], i - self.ones[k])

    def select0(self, i: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.zeros, i, "right") - 1
        return k * 64 + self._in_word(~self.high[k], i - self.zeros[k])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        k, shift = bit >> 6, (bit & 63).astype(np.uint64)
        above = np.where(shift > 0, self.low[k + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[k] >> shift) | above) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        top = (self.select1(i) - i).astype(np.uint64)
        return (top << np.uint64(self.width)) | self._low(i)

    def decode(self) -> np.ndarray:
        """All values, in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        at = np.arange(self.n)
        return ((ones[: self.n] - at).astype(np.uint64) << np.uint64(self.width)) | self._low(at)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below x (n if there is none).

        Few queries go by the upper bits to their bucket and search there; queries that are not
        much fewer than the values are sorted and meet the decoded sequence in one pass.
        """
        if not self.n:
            return np.zeros(len(x), np.int64)
        x = x.astype(np.uint64)
        if DENSE * len(x) > self.n:
            order, out = np.argsort(x), np.empty(len(x), np.int64)
            out[order] = np.searchsorted(self.decode(), x[order])
            return out
        top = (x >> np.uint64(self.width)).astype(np.int64)
        last = int(self.ones[-1])
        most = len(self.high) * 64 - last - 2
        capped = np.minimum(top, most)
        lo = np.where(capped > 0, self.select0(np.maximum(capped - 1, 0)) - capped + 1, 0)
        hi = self.select0(capped) - capped
        want = x & self.mask
        lo = np.where(top > most, self.n, lo)
        hi = np.where(top > most, self.n, hi)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) >> 1
            less = self._low(np.minimum(mid, self.n - 1)) < want
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        head, low, high, ones = arrays
        return cls(int(head[0]), int(head[1]), low, high, ones)


class Quantiser:
    """log10 values as 16-bit steps between the least and the greatest."""

    def __init__(self, low: float, step: float):
        self.low, self.step = low, step

    @classmethod
    def over(cls, values: np.ndarray) -> Quantiser:
        low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        return cls(low, (high - low) / 65_535 or 1.0)

    def code(self, values: np.ndarray) -> np.ndarray:
        return np.rint((values - self.low) / self.step).astype(np.uint16)

    def value(self, codes: np.ndarray) -> np.ndarray:
        return self.low + self.step * codes


class Level:
    """Successors of contexts: pointers from a context to its range, and word ids made monotone over the ranges."""

    def __init__(self, pointers: EliasFano, words: EliasFano):
        self.pointers, self.words = pointers, words

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, contexts: int) -> Level:
        """context, word: sorted by context, then word; ids from 0."""
        begin = np.searchsorted(context, np.arange(contexts + 1))
        greatest = np.where(begin[1:] > begin[:-1], word[np.maximum(begin[1:] - 1, 0)] + 1 if len(word) else 0, 0)
        base = np.concatenate([[0], np.cumsum(greatest)])[:-1]
        return cls(EliasFano.build(begin), EliasFano.build(word + 1 + base[context] if len(word) else np.zeros(0, np.int64)))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Entry of (context, word), or -1: the successor of the word relative to its context's base."""
        if not self.words.n or not len(context):
            return np.full(len(context), -1)
        dense = DENSE * len(context) > self.words.n
        ranges, values = (self.pointers.decode(), self.words.decode()) if dense else (None, None)
        begin, end = (ranges[context + k] if dense else self.pointers.get(context + k) for k in (0, 1))
        begin, end = begin.astype(np.int64), end.astype(np.int64)
        value = (lambda at: values[at]) if dense else self.words.get
        base = np.where(begin > 0, value(np.maximum(begin - 1, 0)).astype(np.int64), 0)
        wanted = base + word + 1
        at = self.words.find(wanted)
        inside = (at >= begin) & (at < end)
        safe = np.minimum(at, self.words.n - 1)
        return np.where(inside & (value(safe).astype(np.int64) == wanted), at, -1)


class Trie:
    """Word keys and two levels of successors with their log10 probabilities in 16 bits.

    Word ids are ranks of the sorted keys. A context of the second level is a word, one of the third
    an entry of the second.
    """

    def __init__(self, arrays: dict[str, np.ndarray], quantisers: dict[str, Quantiser]):
        self.a, self.q = arrays, quantisers
        self.keys = EliasFano.of([arrays[f"keys{i}"] for i in range(4)])
        level = lambda n: Level(EliasFano.of([arrays[f"p{n}_{i}"] for i in range(4)]), EliasFano.of([arrays[f"w{n}_{i}"] for i in range(4)]))
        self.two, self.three = level(2), level(3)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = self.keys.find(hashes)
        if not self.keys.n:
            return np.full(len(hashes), -1)
        safe = np.minimum(at, self.keys.n - 1)
        found = self.keys.decode()[safe] if DENSE * len(hashes) > self.keys.n else self.keys.get(safe)
        return np.where((at < self.keys.n) & (found == hashes), at, -1)

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        codes = self.a[name]
        return self.q[name].value(codes[np.maximum(at, 0)]) if len(codes) else np.zeros(len(at))

    def score(self, tokens: np.ndarray, ptr: np.ndarray, start: np.uint64) -> np.ndarray:
        """log10 probability of every token: of a first one after the start, of any other after the two before it.

        tokens: word hashes of texts given by ptr; each text has one token or more, and all n-grams are in the trie.
        """
        ids = self.ids(np.append(tokens, start))
        ids, begin = ids[:-1], ids[-1]
        before = np.concatenate([[begin], ids[:-1]])
        before[ptr[:-1]] = begin
        pair = self.two.find(before, ids)
        out = self.value("two", pair)
        inner = np.ones(len(ids), bool)
        inner[ptr[:-1]] = False
        at = np.flatnonzero(inner)
        out[at] = self.value("three", self.three.find(pair[at - 1], ids[at]))
        return out

    def to_bytes(self) -> bytes:
        head, parts, at = {}, [], 0
        for name, x in self.a.items():
            raw = np.ascontiguousarray(x).tobytes()
            raw += bytes(-len(raw) % 8)
            head[name] = [at, len(x), str(x.dtype)]
            parts.append(raw)
            at += len(raw)
        text = json.dumps({"arrays": head, "quantisers": {k: [q.low, q.step] for k, q in self.q.items()}}).encode()
        text += b" " * (-len(text) % 8)
        return struct.pack("<q", len(text)) + text + b"".join(parts)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """Arrays are views of the buffer, which may be a memory map."""
        (size,) = struct.unpack_from("<q", buffer)
        spec = json.loads(bytes(buffer[8 : 8 + size]))
        arrays = {k: np.frombuffer(buffer, np.dtype(kind), n, 8 + size + at) for k, (at, n, kind) in spec["arrays"].items()}
        return cls(arrays, {k: Quantiser(*x) for k, x in spec["quantisers"].items()})


def build_trie(keys: np.ndarray, two: tuple[np.ndarray, np.ndarray, np.ndarray], three: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Trie:
    """A trie of sorted word keys and of (context, word, log10 probability), sorted by context, then word.

    two: contexts are words; three: contexts are places in `two`.
    """
    levels = {2: (two, len(keys)), 3: (three, len(two[0]))}
    quantisers, arrays = {}, {f"keys{i}": x for i, x in enumerate(EliasFano.build(keys).arrays())}
    for n, ((context, word, log), contexts) in levels.items():
        name = {2: "two", 3: "three"}[n]
        level = Level.build(context, word, contexts)
        quantisers[name] = Quantiser.over(log)
        arrays[name] = quantisers[name].code(log)
        for kind, seq in (("p", level.pointers), ("w", level.words)):
            arrays |= {f"{kind}{n}_{i}": x for i, x in enumerate(seq.arrays())}
    return Trie(arrays, quantisers)
