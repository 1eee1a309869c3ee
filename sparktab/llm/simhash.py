"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints at 4 or fewer differing bits are linked. Of six blocks of bits at least two agree
between such a pair, so the shared masked pattern of two blocks is the upper node of an index:
a mask, a value and the fingerprints below it, in Gray order. Within a node, runs of neighbours in
Gray order share further patterns, which form the lower nodes; a search carries the differences
met so far and drops a whole node once they exceed the limit. A node with very many fingerprints
is not searched by one task: it is divided into nodes that share further blocks of bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import Words, hidden, materialize, semi_or_anti, slices, without_clashes
from sparktab.llm.components import components

SHINGLE = 4
MAX_BITS = 4
#: A node of more fingerprints than this is divided.
HOT_NODE = 16_384
FANOUT = 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_buffer(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, with new starts and ends."""
    lens = words.ends - words.starts
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    out = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
    inside = np.flatnonzero(words.inside)
    out[inside + np.repeat(starts - words.starts, lens)] = words.data[inside]
    return out.tobytes(), starts, ends


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints (unsigned) of whole texts; 0 for a text without words."""
    words = Words(column)
    counts = words.counts
    out = np.zeros(len(counts), np.uint64)
    if not len(words.starts):
        return out
    buffer, starts, ends = shingle_buffer(words)
    made = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    ptr = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(words.ptr[:-1] - ptr[:-1], made) + np.arange(ptr[-1])
    last = np.minimum(first + shingle, np.repeat(words.ptr[1:], made)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(buffer[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, int(ptr[-1]))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = made > 0
    sums = np.add.reduceat(bits, ptr[:-1][some], axis=0, dtype=np.int32)
    over = (2 * sums > made[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a code word in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def top_masks(blocks: int = 6) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - MAX_BITS)]


class GrayIndex:
    """Hierarchical index over fingerprints in (group, Gray) order, with one root for each group."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps, self.levels = fps, []
        value, mask = fps, np.full(len(fps), _ALL)
        while True:
            first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
            begin = np.flatnonzero(first)
            if len(begin) == len(group):
                self.levels.append((value, mask, np.arange(len(value) + 1)))
                break
            sizes = np.diff(np.append(begin, len(group)))
            place = np.arange(len(group)) - np.repeat(begin, sizes)
            at = np.flatnonzero(place % FANOUT == 0)
            parent = np.cumsum(place % FANOUT == 0) - 1
            apart = np.bitwise_or.reduceat((value ^ value[at][parent]) | ~mask, at)
            up_mask = ~apart
            self.levels.append((value, mask & ~up_mask[parent], np.append(at, len(value))))
            value, mask, group = value[at] & up_mask, up_mask, group[at]

    def pairs(self, query: np.ndarray, root: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (query, other), other > query, at no more than `limit` differing bits."""
        node = root
        value, mask, _ = self.levels[-1]
        seen = np.bitwise_count((self.fps[query] ^ value[node]) & mask[node]).astype(np.int64)
        for value, mask, begin in reversed(self.levels[:-1]):
            many = begin[node + 1] - begin[node]
            ptr = np.cumsum(many) - many
            child = np.repeat(begin[node] - ptr, many) + np.arange(int(many.sum()))
            query, seen = np.repeat(query, many), np.repeat(seen, many)
            seen = seen + np.bitwise_count((self.fps[query] ^ value[child]) & mask[child])
            keep = seen <= limit
            query, node, seen = query[keep], child[keep], seen[keep]
        keep = node > query
        return query[keep], node[keep]


def local_labels(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least node of each component of a small graph."""
    label = np.arange(n) if label is None else label
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _search(fps: np.ndarray, root: np.ndarray, load: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the leaves lo to hi with later leaves of their node. load: leaves in the node of each leaf."""
    index, label = GrayIndex(fps, root), np.arange(len(fps))
    sums = np.cumsum(load)
    at = lo
    while at < hi:
        to = min(hi, max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + 2_000_000, "right"))))
        label = local_labels(len(fps), *index.pairs(np.arange(at, to), root[at:to]), label)
        at = to
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


_OUT = pa.schema([("mask", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


def _rows(mask, u, v) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(x).view(np.int64)) for x in (mask, u, v)], schema=_OUT)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal rows, and the end."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[:1] = True
    return np.append(np.flatnonzero(new), len(new))


def _complete(batches: Iterator[pa.RecordBatch], size: int, hot: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns (mask, fingerprint) of whole nodes and the runs of the nodes, at least `size` rows together.

    A node of more than `hot` rows is not held: it comes as a run of hot + 1 rows, its first ones.
    """
    done: list[list[np.ndarray]] = []  # whole nodes
    open_: list[list[np.ndarray]] = []  # the node that may go on
    rows = open_rows = 0

    def joined(parts):
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return columns, _runs(columns[0], columns[1] & columns[0])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
        runs = _runs(columns[0], columns[1] & columns[0])
        same = bool(open_) and columns[0][0] == open_[0][0][0] and (columns[1][0] & columns[0][0]) == (open_[0][1][0] & open_[0][0][0])
        if open_ and not (same and len(runs) == 2):
            if same and (room := hot + 1 - open_rows) > 0:
                open_.append([c[: min(room, runs[1])] for c in columns])
            done += open_
            rows += sum(len(x[0]) for x in open_)
            open_, open_rows = [], 0
            if same:
                columns = [c[runs[1] :] for c in columns]
                runs = runs[1:] - runs[1]
        cut = int(runs[-2])
        if cut:
            done.append([c[:cut] for c in columns])
            rows += cut
        if (room := hot + 1 - open_rows) > 0:
            open_.append([c[cut : cut + room] for c in columns])
            open_rows += len(open_[-1][0])
        if rows >= size:
            yield joined(done)
            done, rows = [], 0
    if done or open_:
        yield joined(done + open_)


def _node_task(hot: int):
    """Rows (mask, fp) by node and Gray rank: links (mask 0), and (mask, value, 0) of a node too large for one task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (mask, fps), runs in _complete(batches, 100_000, hot):
            sizes = np.diff(runs)
            large = np.flatnonzero(sizes > hot)
            if len(large):
                yield _rows(mask[runs[large]], fps[runs[large]] & mask[runs[large]], np.zeros(len(large), np.uint64))
            keep = np.repeat((sizes > 1) & (sizes <= hot), sizes)
            if keep.any():
                root = _runs(np.repeat(np.arange(len(sizes)), sizes)[keep])
                root = np.repeat(np.arange(len(root) - 1), np.diff(root))
                u, v = _search(fps[keep], root, np.repeat(sizes, sizes)[keep], 0, int(keep.sum()))
                yield _rows(np.zeros(len(u), np.uint64), u, v)

    return task


def finer_masks(mask: int) -> list[int]:
    """Masks below a mask: its bits and four of eight blocks of the others, of which a pair at four differing bits shares one at least."""
    free = [1 << b for b in range(64) if not mask >> b & 1]
    edges = [round(len(free) * i / (2 * MAX_BITS)) for i in range(2 * MAX_BITS + 1)]
    blocks = [sum(free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [mask | sum(c) for c in combinations(blocks, MAX_BITS)]


def _gray_sort_key(fp):
    """Gray rank as an expression, made comparable as a signed number."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, hot: int = HOT_NODE) -> DataFrame:
    """Links (u, v) that span every component of distinct fingerprints (column fp, long).

    A node of more than `hot` fingerprints goes on to nodes below it, which share further bits and
    lie in other tasks. A node's other bits bound the fingerprints it can have, so that ends after
    a few levels, and no task holds more than `hot` fingerprints of a node.
    """
    spark = fps.sparkSession
    masks = F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in top_masks()]))
    rows, links = fps.select(masks.alias("mask"), "fp"), None
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", _gray_sort_key(F.col("fp"))).select("mask", "fp")
        made = materialize(dealt.mapInArrow(_node_task(hot), "mask long, u long, v long"), "nodes")
        found, large = made.where("mask = 0").select("u", "v"), made.where("mask <> 0").select("mask", F.col("u").alias("key"))
        links = found if links is None else links.unionByName(found)
        parents = [r["mask"] for r in large.select("mask").distinct().collect()]  # masks only: 15, and 70 for each of them below
        if not parents:
            return links
        below = spark.createDataFrame([(m, _signed(x)) for m in parents for x in finer_masks(m % (1 << 64))], "mask long, below long")
        # several nodes above may lead to one node below
        rows = rows.join(large, ["mask", "key"], "left_semi").join(F.broadcast(below), "mask").select(F.col("below").alias("mask"), "fp").distinct()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for every row."""

    def task(batches):
        for part in slices(batches, "text"):
            yield pa.record_batch([part.column(0), pa.array(fingerprints(part.column(1)).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return without_clashes(docs, id_col, text_col).toDF("id", "text").mapInArrow(task, f"id {kind}, fp long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, fingerprint (16 hex digits), component_id, n_same.

    A null text, an empty one and one without words have fingerprint zero, and link like any other.
    Equal fingerprints are one node of the index, so exact copies cost one row however many they are;
    n_same says how many rows share the fingerprint. component_id is the least id reachable. Repeated
    ids give repeated rows; a null id never becomes a component_id unless all ids are null. An empty
    table gives an empty table; other columns are not read.
    """
    made = materialize(fingerprint_documents(docs, id_col, text_col), "fingerprints")
    nodes = made.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_same"))
    nodes = materialize(nodes, "distinct")
    member = components(fingerprint_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = nodes.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id", "n_same")
    out = made.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of linked rows the one of least id; columns are those of docs, whatever their names.

    Rows are told apart even if they share an id: of those with the least id one stays. A null id is
    the greatest. Texts without words are one group. An empty table gives an empty table.
    """
    names = docs.columns
    rows = hidden(docs)
    key, at = f"c{names.index(id_col)}", names.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def task(batches):
        for part in slices(batches, f"c{at}"):
            yield pa.record_batch([*part.columns, pa.array(fingerprints(part.column(at)).view(np.int64))], names=[*part.schema.names, "fp"])

    made = materialize(rows.mapInArrow(task, f"{fields}, fp long").withColumn("row_no", F.monotonically_increasing_id()), "fingerprinted")
    place = F.struct(F.col(key).isNull(), F.col(key), F.col("row_no"))
    nodes = materialize(made.groupBy("fp").agg(F.min(place).alias("least")), "distinct")
    member = components(fingerprint_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    stays = nodes.join(member, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("least").alias("least"))
    stays = materialize(stays.select("least.row_no"), "stays")
    return semi_or_anti(made, stays, "row_no", "left_semi").select(rows.columns).toDF(*names)
