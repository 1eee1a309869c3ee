"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on ids.

Files hold disjoint, ascending ranges of document ids, and rows ascend within a file, so stripe
statistics and Bloom filters prune a lookup, and stripes are read in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktab.llm.bpe import crc32s, encoded
from sparktab.llm.common import shared_dir, slices, without_clashes

END_ID = 2
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1_000
BLOOM_FPP = 0.01
#: Bytes of text for each file.
FILE_BYTES = 256 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", row_index: int = INDEX_ROWS) -> None:
    """Writes (id, start, n_tokens, ids) in ascending order of ids; a null text counts as empty.

    start: the ids before the row in its file. Texts are moved once, before they are encoded, so that
    the sample for the ranges costs no encoding. There is a file for every FILE_BYTES of text, and for
    every shuffle partition, if `partitions` is not given. Rows of one id are ordered by a hash of
    their text and may go on in the next file, so an id with very many rows is not one task.
    """
    spark = docs.sparkSession
    rows = without_clashes(docs, id_col, text_col).toDF("id", "text")
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches):
        before = 0
        for part, ids, counts in encoded(slices(batches, "text", cached=True), 1, tokenizer_path, end_id):
            ends = np.cumsum(counts)
            ptr = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.record_batch([part.column(0), pa.array(before + ends - counts), pa.array(counts), pa.ListArray.from_arrays(pa.array(ptr), pa.array(ids.view(np.int32)))], names=[id_col, "start", "n_tokens", "ids"])
            before += int(ends[-1])

    order = ["id", F.xxhash64("text")]
    made = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order, "text").mapInArrow(task, f"`{id_col}` {kind}, start long, n_tokens long, ids array<int>")
    options = {"orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": str(BLOOM_FPP), "orc.row.index.stride": str(row_index), "orc.stripe.size": str(STRIPE_BYTES), "orc.compress": "ZSTD"}
    made.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, ids: list, id_col: str = "doc_id") -> DataFrame:
    """Rows of the given ids; the filter is pushed to stripe statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col(id_col).isin(ids))


def token_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files: id, start (ids of all rows before it), n_tokens, ids_crc32."""
    kind = read_tokens(spark, path).schema[id_col].dataType.simpleString()
    files = F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)", 1).cast("int")
    rows = read_tokens(spark, path).select(id_col, "start", "ids", files.alias("file"))

    def task(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint32)
            off = lists.offsets.to_numpy()
            crc = crc32s(flat, off[:-1], off[1:])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(off).astype(np.int64)), pa.array(crc), batch.column(3)], names=["id", "own", "n_tokens", "ids_crc32", "file"])

    made = rows.mapInArrow(task, f"id {kind}, own long, n_tokens long, ids_crc32 long, file int")
    # one row for each file, from a small column alone
    sizes = read_tokens(spark, path).select("n_tokens", files.alias("file")).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    begin = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    return made.join(F.broadcast(begin), "file").select(F.col("id").alias(id_col), (F.col("begin") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def store_and_index(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes the files to `path` (else the shared folder), and returns their index."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens"
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_index(spark, path)
