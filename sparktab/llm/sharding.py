"""Sharding through a permutation-filled lookup table, with DataFrame expressions only.

Each shard has its own order of preference over the slots of a prime-sized table. Shards take
turns; at a turn a shard claims the first slot of its order that is still free. The table has a
fixed size, so broadcasting it is bounded, and a row is placed by one hash and one probe.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def _preference(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Shard number of every slot. `slots` must be a prime of at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and at least one")
    if slots < len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is not below the number of shards")
    turns = [_preference(s, slots) for s in shards]
    at, table, claimed = [offset for offset, _ in turns], [-1] * slots, 0
    while True:
        for shard, (_, skip) in enumerate(turns):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + skip) % slots
            table[slot], at[shard] = shard, (slot + skip) % slots
            claimed += 1
            if claimed == slots:
                return table


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) with `slots` rows, built from one literal."""
    text = ",".join(map(str, fill(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select(F.col("slot").cast("int").alias("slot"), F.col("shard").cast("int").alias("shard"))


def slot_of(key, slots: int = SLOTS):
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size; null counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str] | int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with columns slot and shard (numbers).

    Columns of those names in df are replaced. Equal keys get equal shards; null is a key like the
    empty text. Rows are neither moved nor dropped, so a hot key costs no more than any other row.
    An empty table gives an empty table.
    """
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else shards
    table = F.broadcast(lookup_table(df.sparkSession, names, slots))
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(table, "slot", "left")


def write_shards(df: DataFrame, key: str, path: str, shards: int = SHARDS, files_per_shard: int = 1) -> None:
    """One folder for each shard; rows of a shard are spread over `files_per_shard` tasks."""
    placed = assign_shards(df, key, shards)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard))
    placed.repartition(shards * files_per_shard, "shard", salt).drop("slot").write.partitionBy("shard").parquet(path)
