"""Language-model scores from Elias-Fano n-gram tries.

Every word, pair and triple of the training texts counts, however rare. Texts are taken in blocks of
some megabytes. A block sends each n-gram it has once, as a sorted run of keys with its own training
counts, to the shard of the key. A shard is a range of hashed keys, so a frequent n-gram or context
is no more than one key of each block. It adds the counts of all blocks and sends every block the
totals of its keys, in the order of the run. With them the block puts its n-grams into a trie:
Elias-Fano word keys, monotone pointers from contexts to their successors, and smoothed
probabilities in 16 bits, as one memory map that is searched for successors relative to a context.
So memory depends on the size of a block and of a shard, not on that of the corpus, and nothing is
gathered on the driver but two totals.

Probabilities are smoothed towards the lower order with a Dirichlet prior of weight `prior`:
p(w | u) = (c(u w) + prior p(w)) / (c(u) + prior), and in the same way for triples, so those of a
context sum to 1 and a context that was never seen leaves all to the lower order.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import Words, mix, remainder, segment_sums, slices, without_clashes
from sparktab.llm.eliasfano import Trie, build_trie

#: Weight of the lower order, in tokens.
PRIOR = 10.0
#: Bytes of text of a block, and of all text for each shard.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
#: The end of a text as a word hash.
END = np.uint64(0x5851F42D4C957F2D)
#: The start of a text, which is only a context.
START = np.uint64(0x14057B7EF767814F)
_SCORES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
#: Keys that a task holds before it merges them.
_HELD = 1 << 21


def _packed(values: np.ndarray) -> bytes:
    """An array of integers by byte planes, compressed; the first byte is the size of a value."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T)
    return bytes([size]) + zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zstandard.decompress(memoryview(data)[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _packed_counts(counts: np.ndarray) -> bytes:
    return _packed(counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and one end, and their ranges."""
    words = Words(column)
    counts = words.counts + 1
    ptr = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(int(ptr[-1]), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[ptr[1:] - 1] = False
    out[keep] = words.hashes()
    return out, ptr


def _levels(tokens: np.ndarray, ptr: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words with the start as the last one, of the pairs that tokens end, and of the triples that the
    tokens end which are not the first of their text; then the places of the latter."""
    before = np.concatenate([[START], tokens[:-1]])
    before[ptr[:-1]] = START
    pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)
    inner = np.ones(len(tokens), bool)
    inner[ptr[:-1]] = False
    inner = np.flatnonzero(inner)
    triple = mix(pair[inner - 1] * np.uint64(0xD1342543DE82EF95) + tokens[inner])
    cut = np.uint64(64 - bits)
    return np.append(tokens, START), pair >> cut, triple >> cut, inner


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, begins of the runs of equal ones, and the run of each key."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    run = np.empty(len(keys), np.int64)
    run[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), run


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, begin, _ = _distinct(keys)
    return keys[order][begin], np.add.reduceat(counts[order], begin) if len(begin) else counts


def _shards(keys: np.ndarray, width: int, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of sorted keys of `width` bits; shards is a power of two."""
    shift = width - (shards.bit_length() - 1)
    home = (keys >> np.uint64(shift) if shift < 64 else np.zeros(len(keys), np.uint64)).astype(np.int64)
    begin = np.flatnonzero(np.diff(home, prepend=-1))
    return zip(home[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True)


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of numbers and bytes; names: name:l for a long, name:b for binary."""
    kinds = [x.split(":") for x in names.split()]
    arrays = [pa.array([r[i] for r in rows], pa.int64() if k == "l" else pa.large_binary()) for i, (_, k) in enumerate(kinds)]
    return pa.record_batch([a.cast(pa.binary()) if k == "b" else a for a, (_, k) in zip(arrays, kinds, strict=True)], names=[n for n, _ in kinds])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows by the first column, in which they are sorted."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != key:
                if held:
                    yield key, held
                key, held = row[0], []
            held.append(row)
    if held:
        yield key, held


def training_totals(rows: DataFrame, shards: int) -> tuple[int, int]:
    """Training tokens and distinct training tokens of (id, text, held). Each task sends its distinct words once."""

    def words(batches):
        keys, counts, size = [], [], 0

        def merged():
            return _sums(np.concatenate(keys), np.concatenate(counts))

        for part in slices(batches, "text"):
            tokens, ptr = _tokens(part.column(1))
            taught = np.repeat(~part.column(2).to_numpy(zero_copy_only=False).astype(bool), np.diff(ptr))
            k, c = _sums(tokens[taught], np.ones(int(taught.sum()), np.int64))
            keys.append(k)
            counts.append(c)
            size += len(k)
            if size > _HELD:
                k, c = merged()
                keys, counts, size = [k], [c], len(k) // 2
        if keys:
            k, c = merged()
            for shard, a, b in _shards(k, 64, shards):
                yield _rows("shard:l keys:b n:l", [(shard, _packed_keys(k[a:b]), int(c[a:b].sum()))])

    def added(batches):
        for _, group in _groups(batches):
            keys = np.sort(np.concatenate([_unpacked_keys(r[1]) for r in group]))
            yield _rows("n:l v:l", [(sum(r[2] for r in group), int((keys[1:] != keys[:-1]).sum()) + 1)])

    sent = rows.mapInArrow(words, "shard long, keys binary, n long").repartition("shard").sortWithinPartitions("shard")
    total, distinct = sent.mapInArrow(added, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return total, distinct


def _block(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _sent(table: pa.Table, block: int, bits: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A block's texts, and its runs of keys with their training counts, by level and shard."""
    names = "route:l block:l data:b counts:b"
    yield _rows(names, [(-1 - block, block, _block(table), None)])
    tokens, ptr = _tokens(table.column("text"))
    taught = ~table.column("held").to_numpy().astype(bool)
    train = np.repeat(taught, np.diff(ptr)).astype(np.int64)
    words, pairs, triples, inner = _levels(tokens, ptr, bits)
    for level, keys, counts in ((0, words, np.append(train, taught.sum())), (1, pairs, train), (2, triples, train[inner])):
        keys, counts = _sums(keys, counts)
        rows = [(level * shards + shard, block, _packed_keys(keys[a:b]), _packed_counts(counts[a:b])) for shard, a, b in _shards(keys, bits if level else 64, shards)]
        if rows:
            yield _rows(names, rows)


def block_rows(rows: DataFrame, bits: int, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(route, block, data, counts) of all blocks of (id, text, held)."""

    def task(batches):
        part_no, held, size, made = TaskContext.get().partitionId(), [], 0, 0
        for part in slices(batches, "text"):
            held.append(part)
            size += part.nbytes
            if size >= block_bytes:
                yield from _sent(pa.Table.from_batches(held), (part_no << 32) + made, bits, shards)
                held, size, made = [], 0, made + 1
        if held:
            yield from _sent(pa.Table.from_batches(held), (part_no << 32) + made, bits, shards)

    return rows.mapInArrow(task, "route long, block long, data binary, counts binary")


def shard_totals(sent: DataFrame) -> DataFrame:
    """(block, route, data): for each run its keys' counts over all blocks. Texts go through as they are (route -1)."""
    names = "block:l route:l data:b"

    def task(batches):
        for route, group in _groups(batches):
            if route < 0:
                yield _rows(names, [(block, -1, data) for _, block, data, _ in group])
                continue
            keys = [_unpacked_keys(r[2]) for r in group]
            counts = np.concatenate([_unpacked(r[3]).astype(np.int64) for r in group])
            ends = np.cumsum([len(k) for k in keys]).tolist()
            order, begin, run = _distinct(np.concatenate(keys))
            total = np.add.reduceat(counts[order], begin)[run]
            yield _rows(names, [(r[1], route, _packed_counts(total[a:b])) for r, a, b in zip(group, [0, *ends], ends, strict=False)])

    return sent.repartition("route").sortWithinPartitions("route", "block").mapInArrow(task, "block long, route long, data binary")


def block_trie(tokens: np.ndarray, ptr: np.ndarray, counts: tuple[np.ndarray, np.ndarray, np.ndarray], bits: int, total: int, distinct: int, prior: float) -> tuple[Trie, np.ndarray]:
    """The trie of a block, and the training count of each of its tokens.

    counts: totals of the words, pairs and triples, in the order of their sorted distinct keys.
    """
    words, pairs, triples, inner = _levels(tokens, ptr, bits)
    order, begin, ids = _distinct(words)
    keys, c1, ids, start = words[order][begin], counts[0], ids[:-1], ids[-1]
    before = np.concatenate([[start], ids[:-1]])
    before[ptr[:-1]] = start
    p1 = (c1 + 1.0) / (total + distinct + 1.0)
    c2 = counts[1][_distinct(pairs)[2]]
    p2 = (c2 + prior * p1[ids]) / (c1[before] + prior)
    c3 = counts[2][_distinct(triples)[2]] if len(inner) else np.zeros(0)
    p3 = (c3 + prior * p2[inner]) / (c2[inner - 1] + prior)
    n = len(keys)
    order, begin, entry = _distinct(before * n + ids)
    at = order[begin]
    two = (before[at], ids[at], np.log10(p2[at]))
    context = entry[inner - 1]
    order, begin, _ = _distinct(context * n + ids[inner])
    at = order[begin]
    three = (context[at], ids[inner][at], np.log10(p3[at]))
    raw = build_trie(keys, two, three).to_bytes()
    mapped = mmap.mmap(-1, len(raw))
    mapped.write(raw)
    return Trie.from_buffer(mapped), c1[ids]


def lm_scores(docs: DataFrame, held: object, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    held: boolean expression; rows for which it is true are scored but teach nothing. A null text
    is empty: one token, the end. Without training rows every word has the same probability 1.
    Repeated ids give repeated rows; an empty table gives an empty table; other columns are not
    read. Keys of pairs and triples have so many bits that about two in 10^5 share their key
    with another one; those of words have 64.
    """
    rows = without_clashes(docs.withColumn("held_flag_", F.coalesce(held, F.lit(False))), id_col, text_col, "held_flag_").toDF("id", "text", "held")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = 1 << max(0, (size // shard_bytes)).bit_length()
    bits = min(64, 14 + max(size, 1 << 16).bit_length())
    total, distinct = training_totals(rows, shards)
    answers = shard_totals(block_rows(rows, bits, shards, block_bytes))

    def task(batches):
        for _, group in _groups(batches):
            table = pa.ipc.open_stream(group[0][2]).read_all().combine_chunks()
            tokens, ptr = _tokens(table.column("text"))
            counts = tuple(np.concatenate([np.zeros(0, np.int64), *[_unpacked(r[2]).astype(np.int64) for r in group[1:] if r[1] // shards == level]]) for level in range(3))
            trie, known = block_trie(tokens, ptr, counts, bits, total, distinct, prior)
            logs = trie.score(tokens, ptr, START)
            base = np.log10((known + 1.0) / (total + distinct + 1.0))
            n = table.num_rows
            sums = [np.add.reduceat(x, ptr[:-1]) for x in (base, logs)]
            given = [pa.concat_arrays(table.column(c).chunks) for c in ("id", "held")]
            counted = [np.diff(ptr), segment_sums(known > 0, ptr), np.full(n, total), *sums]
            yield pa.record_batch([*given, *map(pa.array, counted)], names=_SCORES)

    kind = docs.schema[id_col].dataType.simpleString()
    dealt = answers.repartition("block").sortWithinPartitions("block", "route")
    out = dealt.mapInArrow(task, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores with the rows whose crc32(doc_id) mod 7 is 2 held out."""
    return lm_scores(docs, remainder(7) == 2)
