"""Token ids of a public tokenizer file, with a bounded memo of the pieces already encoded."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa

from sparktab.llm.common import SPACED, WORKER_CACHE, HashTable, Words

#: Distinct pieces that a worker remembers; beyond that it forgets those that it met only once since.
MEMO_PIECES = 1_000_000
PIECES = np.ones_like(SPACED)
PIECES[32] = False
_FIRST = np.uint64(0x6C62272E07BB0142)
#: Pieces of so many bytes or more are told apart by a cryptographic digest.
LONG = 256
#: Words that go to the merges in one text.
GROUP = 1_000

#: Kinds of bytes that the byte-level pattern splits a piece by; 0: it is left to the whole tokenizer.
_LETTER, _DIGIT, _OTHER, _FEED, _FOLLOWS = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = _LETTER  # C3 to C9 begin letters of two bytes
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x80:0xC0] = _FOLLOWS
_KIND[0x27] = 0  # an apostrophe may begin a suffix such as 's
_KIND[0x0A] = _FEED


def _byte_codes() -> np.ndarray:
    """The code points that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    codes = np.zeros(256, np.uint32)
    codes[shown] = shown
    hidden = [b for b in range(256) if b not in shown]
    codes[hidden] = 256 + np.arange(len(hidden))
    return codes


def _kinds(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Kinds of the bytes of pieces that begin at `first`, one after the other."""
    kind = _KIND[data]
    follows = np.flatnonzero(kind == _FOLLOWS)
    lead = data[follows - 1]
    letter = (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((data[follows] == 0x97) | (data[follows] == 0xB7)))
    kind[follows] = np.where(letter, _LETTER, 0)
    # a line feed is a word of its own if nothing but letters, digits and marks stands beside it
    feed = np.flatnonzero(kind == _FEED)
    kind[feed[np.isin(feed, first)]] = 0
    kind[feed[1:][np.diff(feed) == 1]] = 0
    return kind


class Encoder:
    """Encodes whole texts with the tokenizers library (add_special_tokens=False).

    The byte-level pattern never joins what stands before a single space with what follows it, so
    a text without two spaces in a row is the sequence of its space-separated pieces, each but the
    first with its space in front. Pieces repeat, so only new ones go through the library. Pieces
    of Latin letters, digits, marks and single line feeds are split by these kinds, as the pattern
    would, and go to the library's merges directly; any other piece goes to the whole tokenizer. A
    text with two spaces in a row or with an added token, or a tokenizer of another kind, is
    encoded as a whole.
    """

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"].encode() for t in spec.get("added_tokens", ())]
        self.limit = memo_pieces
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()  # no byte is shown as a space
        self.codes = _byte_codes()
        self.token_chars = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.merges.get_vocab().items():
            self.token_chars[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.memo = HashTable(self.limit)
        self.keys, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keeps the pieces that were met twice or more since they came or since the last time; all go if they are too many."""
        keep = np.flatnonzero(self.hits > 1)
        if 2 * len(keep) > self.limit:
            keep = keep[:0]
        keys, hits, size = self.keys[keep], self.hits[keep] // 2, self.size[keep]
        ends = np.cumsum(size, dtype=np.int64)
        flat = self.flat[np.repeat(self.begin[keep] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._clear()
        self.keys, self.hits, self.flat, self.begin, self.size = keys, hits, flat, ends - size, size
        self.memo.put(keys, np.arange(len(keys)))

    def _learn(self, raw: np.ndarray, keys: np.ndarray, begins: np.ndarray, ends: np.ndarray, leads: np.ndarray, whole: list[str]) -> None:
        """Adds rows of new pieces (leads: those at the begin of a text, which have no space in front), then of whole texts."""
        n = len(keys)
        size = np.zeros(n + len(whole), np.int32)
        begin = np.zeros(len(size), np.int64)
        lens = ends - begins
        first = np.cumsum(lens) - lens
        data = raw[np.repeat(begins - first, lens) + np.arange(int(lens.sum()))]
        plain = np.zeros(n, bool)
        known = np.zeros(0, np.uint32)
        if n:
            kind = _kinds(data, first)
            plain = np.add.reduceat((kind == 0).astype(np.int32), first) == 0
            known, counts = self._merged(data, kind, first, lens, leads, plain)
            size[:n][plain] = counts
            begin[:n][plain] = np.cumsum(counts) - counts
        odd = np.flatnonzero(~plain)
        texts = [("" if lead else " ") + data[a : a + m].tobytes().decode() for a, m, lead in zip(first[odd].tolist(), lens[odd].tolist(), leads[odd].tolist(), strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts + whole, add_special_tokens=False)]
        rest = np.append(odd, np.arange(n, len(size)))
        size[rest] = counts = np.fromiter(map(len, found), np.int64, len(found))
        begin[rest] = len(known) + np.cumsum(counts) - counts
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        self.begin = np.concatenate([self.begin, len(self.flat) + begin])
        self.size = np.concatenate([self.size, size])
        self.keys = np.concatenate([self.keys, keys, np.zeros(len(whole), np.uint64)])
        self.hits = np.concatenate([self.hits, np.zeros(len(size), np.int32)])
        self.flat = np.concatenate([self.flat, known, flat])

    def _merged(self, data: np.ndarray, kind: np.ndarray, first: np.ndarray, lens: np.ndarray, leads: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the plain pieces, and how many each has."""
        inside = np.repeat(plain, lens)
        begins = np.zeros(len(data), bool)
        begins[first] = True
        space = np.zeros(len(data), bool)
        space[first[~leads]] = True
        word = begins.copy()
        word[1:] |= kind[1:] != kind[:-1]
        data, word, space = data[inside], word[inside], space[inside]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(int(plain.sum()), np.int64)
        # before each word a separator, and the space of its piece
        at = np.cumsum(1 + word + space) - 1
        codes = np.full(int(at[-1]) + 1, 32, np.uint32)
        codes[at] = self.codes[data]
        codes[at[space] - 1] = self.codes[32]
        text = codes.tobytes().decode("utf-32-le")
        cuts = [*(at[word] - 1 - space[word])[::GROUP].tolist(), len(text)]
        found = self.merges.encode_batch_fast([text[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        # a token spells as many bytes as it has characters
        reach = np.cumsum(self.token_chars[ids])
        stops = np.cumsum((lens + ~leads)[plain])
        place = np.searchsorted(reach, stops)
        if len(reach) != place[-1] + 1 or (reach[place] != stops).any():
            raise RuntimeError("the merges do not spell the pieces")
        return ids, np.diff(place + 1, prepend=0)

    def _marked(self, words: Words) -> np.ndarray:
        """Texts with a space at an end or beside another one, or with an added token."""
        space = np.flatnonzero(~words.inside)
        home = np.searchsorted(words.off, space, "right") - 1
        lonely = (space > words.off[home]) & (space < words.off[home + 1] - 1)
        lonely[1:] &= (space[1:] != space[:-1] + 1) | (home[1:] != home[:-1])
        whole = np.zeros(len(words.counts), bool)
        whole[home[~lonely]] = True
        raw = words.data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                whole[np.searchsorted(words.off, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        return whole if self.split else np.diff(words.off) > 0

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and the number of ids of each text; null counts as empty."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        if len(self.size) > self.limit:
            self._forget()
        words = Words(texts, PIECES, lower=False)
        known, raw = len(self.size), words.data
        whole = self._marked(words)
        mine = ~np.repeat(whole, words.counts)
        hashes = words.hashes()
        for i in np.flatnonzero((words.ends - words.starts >= LONG) & mine).tolist():
            hashes[i] = int.from_bytes(blake2b(raw[words.starts[i] : words.ends[i]], digest_size=8).digest(), "little")
        first = words.ptr[:-1][words.counts > 0]
        hashes[first] ^= _FIRST
        hashes[hashes == 0] = 1  # 0 is a free place of the memo
        at = np.flatnonzero(mine)
        rows = np.full(len(hashes), -1, np.int64)
        rows[at] = self.memo.get(hashes[at])
        new = at[rows[at] < 0]
        odd = np.flatnonzero(whole)
        fresh = 0
        if len(new) or len(odd):
            order = new[np.argsort(hashes[new])]
            ranked = hashes[order]
            head = np.ones(len(order), bool)
            head[1:] = ranked[1:] != ranked[:-1]
            rows[order] = known + np.cumsum(head) - 1
            where, keys = order[head], ranked[head]
            fresh = len(keys)
            leads = np.zeros(len(hashes), bool)
            leads[first] = True
            self._learn(raw, keys, words.starts[where], words.ends[where], leads[where], [raw[words.off[i] : words.off[i + 1]].tobytes().decode() for i in odd.tolist()])
            self.memo.put(keys, known + np.arange(fresh))
        # one row for each piece, and one for each whole text
        many = np.where(whole, 1, words.counts)
        stops = np.concatenate([[0], np.cumsum(many)])
        used = np.empty(int(stops[-1]), np.int64)
        lone = np.zeros(len(used), bool)
        lone[stops[:-1][whole]] = True
        used[lone] = known + fresh + np.arange(len(odd))
        used[~lone] = rows[mine]
        self.hits += np.bincount(rows[mine], minlength=len(self.hits)).astype(np.int32)
        size = self.size[used].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[used] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[stops])


def encoder(path: str, memo_pieces: int = MEMO_PIECES) -> Encoder:
    """One encoder for each worker process."""
    key = (path, memo_pieces)
    if key not in WORKER_CACHE:
        WORKER_CACHE[key] = Encoder(path, memo_pieces)
    return WORKER_CACHE[key]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    ends = np.cumsum(counts + 1)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = ids
    return out, counts + 1


def encoded(parts: Iterator[pa.RecordBatch], column: int, path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    tool = encoder(path)
    for part in parts:
        yield (part, *with_end(*tool.encode(part.column(column)), end_id))


def crc32s(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of id ranges as little-endian unsigned 32-bit numbers."""
    raw = memoryview(np.ascontiguousarray(ids.astype("<u4", copy=False)).view(np.uint8))
    return np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
