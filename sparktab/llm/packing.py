"""Best-fit packing by minimum bin slack.

Only the number of pieces of each length matters for a packing, and lengths are bounded by the
sequence length, so the plan is made from a histogram of at most that many rows. For each bin a
subset-sum bitset over the lengths still available finds the fullest combination around the
longest piece left; the combination is taken as often as the counts allow. The plan says which
ranks of a length go to which bins, and every piece finds its place by its rank alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktab.llm.bpe import crc32s, encoded
from sparktab.llm.common import materialize, slices, without_clashes

SEQUENCE = 1024
END_ID = 2
_RANKS = 1 << 44


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (descending) of the fullest combination within `room` of the available lengths."""
    stages: list[tuple[int, int, int]] = []
    reach, full = 1, (1 << (room + 1)) - 1
    for length in sorted((k for k, n in counts.items() if n > 0 and k <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            stages.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, take, before in reversed(stages):
        if not before >> total & 1:
            total -= length * take
            out += [length] * take
    return sorted(out, reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, number per bin, first bin, offset in the bin), by length and rank."""
    left = {k: n for k, n in histogram.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    rank, rows, bins = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = [longest, *fullest(left, capacity - longest)]
        left[longest] += 1
        many = {k: chosen.count(k) for k in set(chosen)}
        times = min(left[k] // n for k, n in many.items())
        at = 0
        for length in sorted(many, reverse=True):
            rows.append((length, rank[length], many[length], bins, at))
            at += length * many[length]
            rank[length] += many[length] * times
            left[length] -= many[length] * times
            if not left[length]:
                del left[length]
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of these lengths: owner, piece, start, length. The first may be shorter."""
    pieces = -(-counts // capacity)
    owner = np.repeat(np.arange(len(counts)), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = counts - (pieces - 1) * capacity
    start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
    return owner, piece, start, np.where(piece == 0, first[owner], capacity)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece with the end id alone. Repeated ids are packed like any other
    rows. An empty table gives an empty table. Other columns are not read.
    """

    def pieces(batches):
        part_no, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part, ids, counts in encoded(slices(batches, "text", cached=True), 1, tokenizer_path, end_id):
            owner, piece, start, length = cut(counts, capacity)
            at = (np.cumsum(counts) - counts)[owner] + start
            order = np.argsort(length, kind="stable")
            sizes = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(seen, sizes)
            seen += sizes
            made = (piece.astype(np.int32), start, length, crc32s(ids, at, at + length), np.full(len(owner), part_no), rank)
            yield pa.record_batch([part.column(0).take(pa.array(owner)), *map(pa.array, made)], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = without_clashes(docs, id_col, text_col).toDF("id", "text").mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long")
    made = materialize(made, "pieces")
    sizes = materialize(made.groupBy("part", "length").agg(F.count("*").alias("n")), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begin = sizes.select("part", "length", F.coalesce(before, F.lit(0)).alias("begin"))
    shared = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))

    def place(batches):
        table = shared.value
        keys = table[:, 0] * _RANKS + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            row = table[np.searchsorted(keys, length * _RANKS + rank, "right") - 1]
            turn, at = np.divmod(rank - row[:, 1], row[:, 2]) if len(row) else (rank, rank)
            yield pa.record_batch([*batch.columns[:5], pa.array(row[:, 3] + turn), pa.array(row[:, 4] + at * length)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(begin, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("begin")).alias("rank"))
    out = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
