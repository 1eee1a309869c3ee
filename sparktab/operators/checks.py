"""Checks of records: consistent width, and use of delimiters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.errors import InvalidArgument
from sparktab.table import FIELDS, OFFSET


class ColumnConsistency:
    """Records of n fields; -1 takes the width of the first record."""

    def __init__(self, n: int = -1):
        if n < -1:
            raise InvalidArgument("the column count must be -1 or more")
        self.n = n

    def expression(self, fields: Column, first_width: int | None = None) -> Column:
        n = self.n if self.n >= 0 else first_width
        return F.lit(True) if n is None else F.size(fields) == n

    def failures(self, table):
        """The records of a headerless table that have another number of fields; -1 takes that of its first record."""
        return table._with(table.df.where(~self.expression(F.col(table.fields), table.width() if self.n < 0 else None)))

    def __call__(self, record) -> bool:
        if self.n == -1:
            self.n = len(record)
        return len(record) == self.n


def _uses(column: Column, delimiter: str, enclosure: str) -> Column:
    """Fields of a line and one for the line itself, if the delimiter splits it; fields in the enclosure count as one."""
    d, q = "\\Q" + delimiter + "\\E", "\\Q" + enclosure + "\\E"
    plain = F.regexp_replace(column, f"(^|{d})[ \\t]*{q}(?:(?!{q}).|{q}{q})*{q}", "$1x")
    n = F.size(F.split(plain, d))
    return F.when(n > 1, n + 1).otherwise(0)


def delimiter_stats(lines: DataFrame, delimiters: list[str], limit: int = 1, column: str = "value", enclosure: str = '"', order_by: str | None = None) -> DataFrame:
    """(delimiter, fields): records that a delimiter splits plus their fields, over the first `limit` lines (-1: all).

    A delimiter that is not one byte scores 0. All delimiters are counted in one pass.
    """
    rows = lines.orderBy(order_by) if order_by and limit >= 0 else lines
    rows = rows.limit(limit) if limit >= 0 else rows
    one = [d for d in dict.fromkeys(delimiters) if len(d.encode()) == 1]
    sums = rows.agg(*[F.coalesce(F.sum(_uses(F.col(column), d, enclosure)), F.lit(0)).alias(f"d{i}") for i, d in enumerate(one)]) if one else rows.sparkSession.range(1)
    pairs = [F.struct(F.lit(d).alias("delimiter"), (F.col(f"d{one.index(d)}") if d in one else F.lit(0)).cast("long").alias("fields")) for d in dict.fromkeys(delimiters)]
    return sums.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def reader_delimiter_stats(reader, delimiters: list[str], limit: int = 1) -> dict[str, int]:
    """The same over the first `limit` records of a document (-1: all), each delimiter with the document's own parser."""
    if limit < -1:
        raise InvalidArgument("the limit must be -1 or more")
    out = dict.fromkeys(delimiters, 0)
    for d in out:
        if len(d.encode()) == 1:
            raw = reader.set_delimiter(d).raw_records()
            raw = raw if limit == -1 else raw.where(F.col(OFFSET) < limit)
            n = F.size(FIELDS)
            out[d] = raw.agg(F.coalesce(F.sum(F.when(n > 1, n + 1)), F.lit(0))).first()[0]
    return out
