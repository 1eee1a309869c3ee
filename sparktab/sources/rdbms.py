"""Database results: cursors on the driver, and JDBC scans split by a key."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparktab.errors import InvalidArgument
from sparktab.table import Table


def column_names(cursor) -> list[str]:
    if getattr(cursor, "description", None) is None:
        raise InvalidArgument("the cursor has no result")
    return [d[0] for d in cursor.description]


def rows(cursor):
    names = column_names(cursor)
    return (dict(zip(names, r, strict=True)) for r in cursor)


def from_cursor(spark: SparkSession, cursor) -> Table:
    """A DB-API cursor's rows, materialised."""
    names = column_names(cursor)
    return Table.from_records(spark, [list(r) for r in cursor], names)


def from_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options) -> Table:
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key and bounds:
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    else:
        reader = reader.option("query", query)
    return Table(reader.load())
