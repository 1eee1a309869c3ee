"""Benchmark decontamination with suffix arrays over the training texts.

Each shard of training documents gets a suffix array over its words, of all suffixes at full depth.
A suffix is cut at the first word that no test item has, since no match goes across it. Every
suffix of every test item is searched in it by binary search, word by word, which gives its longest
verbatim match and the interval of all training positions with it. On its way the search passes the
interval of the suffix's window; each position there that is not the inside of a longer match is
extended to the maximal match. The test side is broadcast in blocks of bounded size; a larger
benchmark is read and searched block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import ALNUM, Words, materialize, slices, without_clashes

WINDOW = 13
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 16_000_000
#: Bytes of training text in one suffix array.
SHARD_BYTES = 4 << 20
#: Pairs of a test suffix and a training position that are extended at once.
PAIRS = 1 << 20


class TestItems:
    """The words of test items one after the other, as ids from 1, with the end of the item and the window at each place."""

    __test__ = False

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.names = [str(i) for i, _ in items]
        words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM)
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        self.ids = np.searchsorted(self.vocabulary, hashes) + 1
        self.item = words.owner()
        self.begin, self.end = words.ptr[:-1][self.item], words.ptr[1:][self.item]
        # words of the window that begins here, 0 if none does; a short item is one window
        place = np.arange(len(hashes))
        size = np.minimum(window, self.end - self.begin)
        self.window = np.where(place + size <= self.end, size, 0)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """1.. for words of the block, 0 for any other."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _heads(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of words other than 0, sorted by the words from there to `ends`: the depth is doubled for what is still equal."""
    at = np.flatnonzero(ids > 0)
    tied = at[np.argsort(ids[at], kind="stable")]
    new = _heads(ids[tied])
    # a rank is one more than the number of suffixes that are less, as far as they are compared
    rank = np.zeros(len(ids) + 1, np.int64)
    rank[tied] = 1 + np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0)) if len(tied) else 0
    tied, deep = tied[~(new & np.append(new[1:], True))], 1
    while len(tied):
        after = np.where(tied + deep < ends[tied], rank[np.minimum(tied + deep, len(ids))], 0)
        key = (rank[tied] << 32) | after
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        new, first, place = _heads(key), _heads(key >> 32), np.arange(len(tied))
        rank[tied] = (key >> 32) + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        tied = tied[~(new & np.append(new[1:], True)) & ((key & 0xFFFFFFFF) > 0)]
        deep *= 2
    return at[np.argsort(rank[at], kind="stable")]


class Shard:
    """The suffix array of some training texts, in the word ids of a block of test items."""

    def __init__(self, column: pa.Array, test: TestItems):
        words = Words(column, ALNUM)
        self.ptr, self.counts = words.ptr, words.counts
        self.ids = test.word_ids(words.hashes())
        stops = np.union1d(np.flatnonzero(self.ids == 0), self.ptr[1:])
        self.ends = stops[np.searchsorted(stops, np.arange(len(self.ids)), "right")] if len(self.ids) else stops
        self.order = suffix_array(self.ids, self.ends)

    def _word(self, rank: np.ndarray, depth: int) -> np.ndarray:
        at = self.order[rank] + depth
        return np.where(at < self.ends[self.order[rank]], self.ids[np.minimum(at, len(self.ids) - 1)], 0)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """First suffixes of the ranges whose word at this depth is not below `word`."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._word(mid, depth) < word[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    def search(self, test: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every test suffix the words and the interval of its longest match, and the interval of its window (empty if it has none)."""
        n = len(test.ids)
        longest, wlo, whi = (np.zeros(n, np.int64) for _ in range(3))
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.order))
        live, depth = np.arange(n if len(self.order) else 0), 0
        while len(live):
            word = test.ids[live + depth]
            a = self._bound(lo[live], hi[live], depth, word)
            b = self._bound(a, hi[live], depth, word + 1)
            some = b > a
            live = live[some]
            lo[live], hi[live] = a[some], b[some]
            depth += 1
            longest[live] = depth
            whole = live[test.window[live] == depth]
            wlo[whole], whi[whole] = lo[whole], hi[whole]
            live = live[live + depth < test.end[live]]
        return longest, lo, hi, wlo, whi

    def first_places(self, lo: np.ndarray, hi: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes in each interval the text of the least id, and the word there."""
        rank = pc.rank(ids, null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        at = np.zeros(len(lo), np.int64)
        for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            p = self.order[a:b]
            text = np.searchsorted(self.ptr, p, "right") - 1
            at[i] = p[np.lexsort((p - self.ptr[text], rank[text]))[0]]
        text = np.searchsorted(self.ptr, at, "right") - 1
        return text, at - self.ptr[text]

    def matches(self, test: TestItems) -> np.ndarray:
        """Rows (text, word, number of words, item, word of the item): maximal verbatim matches of a window or more."""
        *_, wlo, whi = self.search(test)
        some = np.flatnonzero(whi > wlo)
        found = [np.zeros((0, 5), np.int64)]
        while len(some):
            many = np.cumsum(whi[some] - wlo[some])
            cut = max(1, int(np.searchsorted(many, PAIRS, "right")))
            found.append(self._extended(test, some[:cut], wlo, whi))
            some = some[cut:]
        out = np.concatenate(found)
        return out[np.lexsort(out.T[::-1])]

    def _extended(self, test: TestItems, suffixes: np.ndarray, wlo: np.ndarray, whi: np.ndarray) -> np.ndarray:
        many = whi[suffixes] - wlo[suffixes]
        t = np.repeat(suffixes, many)
        p = self.order[np.repeat(wlo[suffixes] - np.cumsum(many) + many, many) + np.arange(len(t))]
        text = np.searchsorted(self.ptr, p, "right") - 1
        # a pair that goes on to the left is part of the match of the pair before
        inner = (t > test.begin[t]) & (p > self.ptr[text]) & (test.window[np.maximum(t - 1, 0)] > 0)
        inner &= self.ids[np.maximum(p - 1, 0)] == test.ids[np.maximum(t - 1, 0)]
        t, p, text = t[~inner], p[~inner], text[~inner]
        size = test.window[t].copy()
        live = np.arange(len(t))
        while len(live):
            u, q = t[live] + size[live], p[live] + size[live]
            more = (u < test.end[t[live]]) & (q < self.ends[p[live]])
            more[more] = test.ids[u[more]] == self.ids[q[more]]
            live = live[more]
            size[live] += 1
        return np.stack([text, p - self.ptr[text], size, test.item[t], t - test.begin[t]], axis=1)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, chars: int) -> Iterator[list[tuple]]:
    """The benchmark in bounded blocks, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


_SPANS = "spans array<struct<start:bigint,end:bigint>>, items array<string>, best struct<words:bigint,start:bigint,item:string>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_BEST = pa.struct([("words", pa.int64()), ("start", pa.int64()), ("item", pa.string())])


def _hits(docs: DataFrame, test: TestItems) -> DataFrame:
    """docs with n_words, spans (array of start, end), items and the longest match for one block."""
    shared = docs.sparkSession.sparkContext.broadcast(test)
    at, names = docs.columns.index("text"), docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def task(batches):
        test = shared.value
        for part in slices(batches, "text", SHARD_BYTES):
            shard = Shard(part.column(at), test)
            found = shard.matches(test)
            spans, items, best = [[]] * part.num_rows, [[]] * part.num_rows, [None] * part.num_rows
            begin = np.flatnonzero(_heads(found[:, 0]))
            for a, b in zip(begin.tolist(), np.append(begin, len(found))[1:].tolist(), strict=True):
                row, mine = int(found[a, 0]), found[a:b]
                reach = np.maximum.accumulate(mine[:, 1] + mine[:, 2])  # sorted by start
                first = np.flatnonzero(np.append(True, mine[1:, 1] > reach[:-1]))
                spans[row] = [{"start": x, "end": y} for x, y in zip(mine[first, 1].tolist(), reach[np.append(first[1:] - 1, len(mine) - 1)].tolist(), strict=True)]
                items[row] = sorted({test.names[k] for k in np.unique(mine[:, 3]).tolist()})
                long = mine[mine[:, 2] == mine[:, 2].max()]
                long = long[long[:, 1] == long[0, 1]]
                best[row] = {"words": int(long[0, 2]), "start": int(long[0, 1]), "item": min(test.names[k] for k in long[:, 3].tolist())}
            yield pa.record_batch([*part.columns, pa.array(shard.counts.astype(np.int64)), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string())), pa.array(best, _BEST)], names=[*names, "n_words", "spans", "items", "best"])

    return docs.mapInArrow(task, f"{fields}, n_words long, {_SPANS}")


def _with_span(done: Column, span: Column) -> Column:
    """Sorted spans with one more, which is joined to the last one if they meet."""
    last = F.element_at(done, -1)
    joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
    meets = (F.size(done) > 0) & (last["end"] >= span["start"])
    return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))


def _with_verdict(rows: DataFrame) -> DataFrame:
    """The columns ADDED from spans (sorted, apart), items and best."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = rows.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    rows = rows.withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort("items")), 256))
    rows = rows.withColumn("longest", F.coalesce("best.words", F.lit(0))).withColumn("longest_start", F.col("best.start")).withColumn("longest_item", F.col("best.item"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("spans", "best")


ADDED = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "longest", "longest_start", "longest_item")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items, items_sha256, contaminated, longest, longest_start and longest_item.

    Columns of those names (and spans, best, row_no) are replaced. Words are runs of 0-9, a-z and non-ASCII characters after
    lower-casing A-Z. An item of fewer words than a window is one window; an item without words, a
    null text and a null item id match nothing. A document is contaminated if at least a twentieth
    of its words lies in matches. longest is the number of words of the longest match of a window or
    more (0: none), longest_start its first word, longest_item its item; ties go to the first word,
    then to the item whose id is first as text. Rows are neither moved nor dropped if the benchmark
    fits a block; otherwise each row gets a number to bring the blocks' matches together, and
    one block at a time is on the driver.
    """
    renamed = docs.drop(*ADDED, "spans", "best", "row_no")
    if text_col != "text":
        renamed = renamed.drop("text").withColumnRenamed(text_col, "text")
    blocks = _blocks(benchmark, item_col, "text", block_chars)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = _with_verdict(_hits(renamed, TestItems(first, window)))
    else:
        keyed = materialize(renamed.withColumn("row_no", F.expr("uuid()")), "keyed")
        parts = None
        for block in chain((first, second), blocks):
            found = _hits(keyed.select("row_no", "text"), TestItems(block, window)).where("size(items) > 0")
            one = materialize(found.select("row_no", "spans", "items", "best"), "found")
            parts = one if parts is None else parts.unionByName(one)
        better = F.struct(-F.col("best.words"), F.col("best.start"), F.col("best.item"))
        merged = parts.groupBy("row_no").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.min_by("best", better).alias("best"))
        apart = F.aggregate(
            "spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
            _with_span,
        )
        merged = merged.withColumn("spans", apart)
        counted = _hits(keyed, TestItems([], window)).drop("spans", "items", "best").join(merged, "row_no", "left").drop("row_no")
        out = _with_verdict(counted.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)"))))
    if text_col != "text":
        out = out.withColumnRenamed("text", text_col)
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, item_start, n_words, id, start): for each test suffix the longest verbatim match in all training texts, of `least` words or more.

    Of several places the one with the least id stands, then the least first word; a null id counts as the greatest.
    Each shard gives one row for a suffix at most.
    """
    rows = without_clashes(docs, id_col, text_col).toDF("id", "text")
    kind, made = rows.schema["id"].dataType.simpleString(), None

    def searched(test):
        shared = rows.sparkSession.sparkContext.broadcast(test)

        def task(batches):
            test = shared.value
            for part in slices(batches, "text", SHARD_BYTES):
                shard = Shard(part.column(1), test)
                words, lo, hi, *_ = shard.search(test)
                some = np.flatnonzero(words >= least)
                text, start = shard.first_places(lo[some], hi[some], part.column(0))
                names = pa.array([test.names[k] for k in test.item[some].tolist()], pa.string())
                cells = [names, pa.array(some - test.begin[some]), pa.array(words[some]), part.column(0).take(pa.array(text)), pa.array(start)]
                yield pa.record_batch(cells, names=["item", "item_start", "n_words", "id", "start"])

        return rows.mapInArrow(task, f"item string, item_start long, n_words long, id {kind}, start long")

    for block in _blocks(benchmark, item_col, "text", block_chars):
        one = materialize(searched(TestItems(block)), "longest")
        made = one if made is None else made.unionByName(one)
    if made is None:
        made = searched(TestItems([]))
    best = F.struct(-F.col("n_words"), F.col("id").isNull(), "id", "start")
    return made.groupBy("item", "item_start").agg(F.min_by(F.struct("n_words", "id", "start"), best).alias("x")).select("item", "item_start", "x.n_words", F.col("x.id").alias(id_col), "x.start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones; columns as in docs, even if they are called like a result."""
    names = docs.columns
    hidden = docs.toDF(*[f"c{i}" if n != "text" else n for i, n in enumerate(names)])
    return find_contamination(hidden, benchmark, window).where("not contaminated").select(hidden.columns).toDF(*names)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_start, longest_item for every row."""
    rows = without_clashes(docs, id_col, "text").toDF("id", "text")
    out = find_contamination(rows, benchmark, window).withColumnRenamed("id", id_col)
    return out.select(id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_start", "longest_item")
