"""The table: a DataFrame, its ordered columns and, where needed, the offset of each record."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.errors import InvalidArgument, QueryException, SyntaxProblem
from sparktab.plans.predicate import as_predicate
from sparktab.shared import materialize

OFFSET = "__offset"
FIELDS = "__fields"


def check_header(names: Iterable) -> list[str]:
    names = list(names)
    if any(not isinstance(n, str) for n in names):
        raise SyntaxProblem("the header must be a list of texts")
    again = tuple(dict.fromkeys(n for n in names if names.count(n) > 1))
    if again:
        raise SyntaxProblem(f"duplicate column names: {', '.join(again)}", again)
    return names


class Table:
    """Lazy and immutable. A headerless table has one array column instead of named columns.

    Filters, sorts and slices keep the offsets of records. Offsets are attached only when an
    operator asks for them: from the source, else by writing the rows once in their order.
    """

    def __init__(self, df: DataFrame, columns: list[str] | None = None, offset: str | None = None, headerless: bool = False, order_key: list[str] | None = None, start: int = 0, ordered: tuple = ()):
        self.df, self.headerless, self.order_key, self.start, self.ordered = df, headerless, order_key, start, ordered
        self.offset = offset or (OFFSET if OFFSET in df.columns else None)
        self.fields = FIELDS
        self.columns = [] if headerless else check_header(columns if columns is not None else [c for c in df.columns if c != self.offset])

    # sources

    @classmethod
    def of(cls, source) -> Table:
        if isinstance(source, Table):
            return source
        if isinstance(source, DataFrame):
            return cls(source)
        if hasattr(source, "to_table"):
            return source.to_table()
        raise InvalidArgument(f"no table can be made of {type(source).__name__}")

    @classmethod
    def try_of(cls, source) -> Table | None:
        try:
            return cls.of(source)
        except Exception:  # noqa: BLE001
            return None

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, order_key: list[str] | None = None) -> Table:
        return cls(spark.read.parquet(path), order_key=order_key)

    @classmethod
    def from_records(cls, spark: SparkSession, records: Iterable, header: list[str] | None = None, start: int = 0) -> Table:
        """Driver-side records: lists or dicts; dicts give the header if none is given."""
        rows = list(records)
        if rows and isinstance(rows[0], dict):
            header = header or list(dict.fromkeys(k for r in rows for k in r))
            rows = [[r.get(h) for h in header] for r in rows]
        if not header:
            kind = T.StructType([T.StructField(OFFSET, T.LongType(), False), T.StructField(FIELDS, T.ArrayType(T.StringType()))])
            return cls(spark.createDataFrame([(i + start, [None if v is None else str(v) for v in r]) for i, r in enumerate(rows)], kind), headerless=True)
        check_header(header)
        rows = [(i + start, *(list(r) + [None] * len(header))[: len(header)]) for i, r in enumerate(rows)]
        kind = T.StructType([T.StructField(OFFSET, T.LongType(), False), *[T.StructField(h, _kind([r[i + 1] for r in rows])) for i, h in enumerate(header)]])
        return cls(spark.createDataFrame(rows, kind), header)

    def _with(self, df: DataFrame, columns: list[str] | None = None, **more) -> Table:
        given = {"offset": self.offset, "headerless": self.headerless, "order_key": self.order_key, "start": self.start, "ordered": self.ordered} | more
        return Table(df, None if given["headerless"] else (self.columns if columns is None else columns), **given)

    # offsets

    def with_offset(self) -> Table:
        """The table with a dense offset column: of the order key if there is one, else in scan order.

        The ordered rows are written once, each with its partition and its place there. Both the
        sizes of partitions and the rows are read from those files, so a second run of the plan,
        which may be dealt out otherwise, cannot renumber or lose a row.
        """
        if self.offset:
            return self
        written, place = self._written()
        return self._with(written.select(*[F.col(f"`{c}`") for c in self.df.columns], place.alias(OFFSET)), offset=OFFSET)

    def _written(self) -> tuple[DataFrame, Column]:
        """The rows in order as a written table, and the place of each as an expression."""
        df = self.df.orderBy(*self.order_key) if self.order_key and not self.ordered else self.df
        at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        written = materialize(df.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")), "rows")
        total, begin = self.start, []
        for part, n in sorted(tuple(r) for r in written.groupBy("__part").agg(F.count("*")).collect()):  # one row for each partition
            begin.append((part, total))
            total += n
        bases = F.broadcast(self.df.sparkSession.createDataFrame(begin, "__part int, __base long"))
        missing = F.raise_error(F.lit("a partition of the written rows was not counted")).cast("long")
        return written.join(bases, "__part", "left"), F.coalesce("__base", missing) + F.col("__at")

    # columns

    def resolve(self, column: str | int) -> tuple[Column, T.DataType]:
        """Expression and type of a column by name or ordinal; a dotted name reaches into a struct."""
        if self.headerless:
            if not isinstance(column, int):
                raise QueryException(f"unknown column {column!r}")
            c = F.col(FIELDS)
            at = F.lit(column) if column >= 0 else F.size(c) + column
            return F.get(c, at), T.StringType()
        if isinstance(column, int):
            if not -len(self.columns) <= column < len(self.columns):
                raise QueryException(f"unknown column {column}")
            column = self.columns[column]
        if column in self.columns:
            return F.col(f"`{column}`"), self.df.schema[column].dataType
        head, _, rest = column.partition(".")
        if rest and head in self.columns:
            try:
                return F.col(column), self.df.select(F.col(column).alias("x")).schema["x"].dataType
            except Exception as e:
                raise QueryException(f"unknown column {column!r}") from e
        raise QueryException(f"unknown column {column!r}")

    def header(self) -> list[str]:
        return list(self.columns)

    def has_header(self) -> bool:
        return not self.headerless

    def width(self) -> int:
        """Number of columns; of the first record where there is no header."""
        if not self.headerless:
            return len(self.columns)
        row = self._in_order().df.select(F.size(FIELDS).alias("n")).limit(1).collect()
        return row[0]["n"] if row else 0

    def _out(self, columns: list[Column], names: list[str]) -> Table:
        keep = [F.col(self.offset)] if self.offset else []
        return self._with(self.df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], *keep), names, headerless=False, order_key=None)

    def select(self, *columns: str | int) -> Table:
        """By name and ordinal, in the order asked for; repeats collapse."""
        try:
            if self.headerless:
                wanted = list(dict.fromkeys(columns))
                if any(not isinstance(c, int) for c in wanted):
                    raise InvalidArgument("a table without header has ordinals only")
                width = self.width()
                if any(c >= width or c < -width for c in wanted):
                    raise InvalidArgument("unknown column ordinal")
                return self._out([self.resolve(c)[0] for c in wanted], [str(c % width) for c in wanted])
            names = list(dict.fromkeys(self.columns[c] if isinstance(c, int) and -len(self.columns) <= c < len(self.columns) else c for c in columns))
            return self._out([self.resolve(n)[0] for n in names], [str(n) for n in names])
        except QueryException as e:
            raise InvalidArgument(str(e)) from e

    def select_all_except(self, *columns: str | int) -> Table:
        if self.headerless:
            width = self.width()
            if any(not isinstance(c, int) or not -width <= c < width for c in columns):
                raise InvalidArgument("unknown column ordinal")
            return self.select(*[i for i in range(width) if i not in {c % width for c in columns}])
        gone = set()
        for c in columns:
            if isinstance(c, int) and -len(self.columns) <= c < len(self.columns):
                gone.add(self.columns[c])
            elif c in self.columns:
                gone.add(c)
            else:
                raise InvalidArgument(f"unknown column {c!r}")
        return self.select(*[c for c in self.columns if c not in gone])

    def map_header(self, header: list[str] | dict[int, str]) -> Table:
        """Columns by ordinal under new names; an ordinal beyond the record gives nulls."""
        pairs = list(header.items()) if isinstance(header, dict) else list(enumerate(header))
        names = check_header([n for _, n in pairs])
        if any(not isinstance(i, int) or i < 0 for i, _ in pairs):
            raise SyntaxProblem("ordinals must be non-negative numbers")
        inside = [self.resolve(i)[0] if self.headerless or i < len(self.columns) else F.lit(None).cast("string") for i, _ in pairs]
        return self._out(inside, names)

    def map(self, f: Callable, schema: T.StructType | str) -> Table:
        """`table -> list of columns` is an expression; any other callable maps records in Python (slow path)."""
        if isinstance(f, dict):
            return self._out(list(f.values()), list(f))
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        columns, headerless = self.columns, self.headerless

        def task(batches):
            for pdf in batches:
                records = (list(r) for r in pdf[FIELDS]) if headerless else (dict(zip(columns, r, strict=True)) for r in pdf[columns].itertuples(index=False, name=None))
                import pandas as pd

                rows = [f(r) for r in records]
                yield pd.DataFrame([r if isinstance(r, dict) else dict(zip(kind.names, r if isinstance(r, (list, tuple)) else [r], strict=True)) for r in rows], columns=kind.names)

        return Table(self.df.mapInPandas(task, kind))

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Table:
        """A formatter: DataFrame to DataFrame."""
        return self._with(f(self.df), None if self.headerless else [c for c in f(self.df).columns if c != self.offset])

    # rows

    def filter(self, predicate) -> Table:
        p = as_predicate(predicate)
        table = self.with_offset() if p.needs_offset else self
        return table._with(table.df.where(p.total(table).positive()))

    def sorted(self, *keys) -> Table:
        """A stable sort: ties keep the order of offsets where the table has them, else of its order key."""
        keys = [x for k in keys for x in (k.keys if hasattr(k, "keys") else (k,))]
        table, made = self, []
        for i, key in enumerate(keys):
            table, key = key.prepared(table, f"__rank{i}")
            made.append(key)
        columns = [c for k in made for c in k.columns(table)]
        ties = [F.col(self.offset)] if self.offset else [F.col(k) for k in self.order_key or ()]
        df = table.df.orderBy(*columns, *ties)
        return self._with(df.drop(*[c for c in df.columns if c.startswith("__rank")]), ordered=(*columns, *ties))

    def _in_order(self) -> Table:
        """The table in an order of its own: sorted, or by offset, or by order key."""
        if self.ordered:
            return self
        keys = [self.offset] if self.offset else self.order_key
        if not keys:
            table = self.with_offset()
            return table._with(table.df.orderBy(table.offset), ordered=(F.col(table.offset),))
        return self._with(self.df.orderBy(*keys), ordered=tuple(map(F.col, keys)))

    def slice(self, offset: int, length: int | None = -1) -> Table:
        length = -1 if length is None else length
        if offset < 0 or length < -1:
            raise InvalidArgument("offset must be 0 or more, length -1 or more")
        table = self._in_order()
        df = table.df.offset(offset) if offset else table.df
        return table._with(df.limit(length) if length >= 0 else df, ordered=table.ordered)

    def _placed(self, size: int) -> DataFrame:
        """The records, written once in their order, with their place among these records."""
        if size < 1:
            raise InvalidArgument("a chunk has one record or more")
        written, place = self._in_order()._with(self._in_order().df, start=0)._written()
        return written.select(*[F.col(f"`{c}`") for c in self.df.columns], place.alias("__place"))

    def chunk_id(self, size: int) -> DataFrame:
        """The records with a column chunk: position among these records, divided by size."""
        placed = self._placed(size).withColumn("chunk", F.floor(F.col("__place") / size).cast("long"))
        return placed.drop("__place", OFFSET)

    def chunk_by(self, size: int) -> Iterator[Table]:
        """Tables of `size` records each; the records are sorted and written once, however many chunks there are."""
        placed = self._placed(size)
        last = placed.agg(F.max("__place")).first()[0]
        place = F.col("__place")
        for at in range(0, -1 if last is None else last + 1, size):
            yield self._with(placed.where(place.between(at, at + size - 1)).orderBy(place).drop("__place"), ordered=(F.lit(at),))

    # actions

    def _record(self, row) -> Any:
        return list(row[FIELDS]) if self.headerless else {c: row[c] for c in self.columns}

    def records(self) -> Iterator:
        return (self._record(r) for r in self._in_order().df.toLocalIterator())

    def items(self) -> Iterator[tuple[int, Any]]:
        """(offset, record) of every record in order."""
        table = (self if self.offset else self.with_offset())._in_order()
        return ((r[table.offset], table._record(r)) for r in table.df.toLocalIterator())

    def __iter__(self) -> Iterator:
        return self.records()

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def first(self) -> Any:
        return self.nth(0)

    def nth(self, n: int) -> Any:
        if n < 0:
            raise InvalidArgument("the position must be 0 or more")
        rows = self.slice(n, 1).df.collect()
        return self._record(rows[0]) if rows else ([] if self.headerless else {})

    def last(self) -> Any:
        """Last record, by one pass that keeps the record of the greatest offset."""
        if self.ordered:
            rows = self.df.tail(1)
        else:
            table = self if self.offset or self.order_key else self.with_offset()
            key = F.struct(*([table.offset] if table.offset else table.order_key))
            rows = table.df.agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in table.df.columns]), key).alias("r")).collect()
            rows = [r["r"] for r in rows if r["r"] is not None]
        return self._record(rows[0]) if rows else ([] if self.headerless else {})

    def value(self, column: str | int = 0) -> Any:
        try:
            c, _ = self.resolve(column)
        except QueryException:
            return None
        rows = self._in_order().df.select(c.alias("v")).limit(1).collect()
        return rows[0]["v"] if rows else None

    def column(self, index: str | int = 0, keep_nulls: bool = False) -> DataFrame:
        """The values of a column as a DataFrame, without nulls."""
        try:
            c, _ = self.resolve(index)
        except QueryException as e:
            raise InvalidArgument(str(e)) from e
        df = self.df.select(c.alias("value"))
        return df if keep_nulls else df.where("value is not null")

    def fetch_column(self, index: str | int = 0) -> Iterator:
        table = self._in_order()
        c, _ = table.resolve(index)
        return (r["v"] for r in table.df.select(c.alias("v")).toLocalIterator() if r["v"] is not None)

    def pairs(self, key: str | int = 0, value: str | int = 1) -> DataFrame:
        k, v = self.resolve(key)[0], self.resolve(value)[0]
        return self.df.select(k.alias("key"), v.alias("value")).where("key is not null")

    def fetch_pairs(self, key: str | int = 0, value: str | int = 1) -> Iterator[tuple]:
        table = self._in_order()
        return ((r["key"], r["value"]) for r in table.pairs(key, value).toLocalIterator())

    def each(self, f: Callable) -> bool:
        return all(f(r) is not False for r in self.records())

    def exists(self, predicate) -> bool:
        return not self.filter(predicate).is_empty()

    def reduce(self, f: Callable, initial: Any = None) -> Any:
        """A fold in order on the driver, streamed; for known folds use `aggregate`."""
        for record in self.records():
            initial = f(initial, record)
        return initial

    def aggregate(self, **columns: Column) -> DataFrame:
        return self.df.agg(*[c.alias(n) for n, c in columns.items()])

    def first_offset(self) -> int | None:
        table = self.with_offset()
        return table.df.agg(F.min(table.offset)).first()[0]

    def last_offset(self) -> int | None:
        table = self.with_offset()
        return table.df.agg(F.max(table.offset)).first()[0]

    def matching(self, expression: str) -> list[Table]:
        from sparktab.plans import fragment

        return fragment.find_all(expression, self)

    def matching_first(self, expression: str) -> Table | None:
        from sparktab.plans import fragment

        return fragment.find_first(expression, self)

    def matching_first_or_fail(self, expression: str) -> Table:
        from sparktab.plans import fragment

        return fragment.find_first_or_fail(expression, self)

    def infer_schema(self, inspector=None):
        from sparktab.operators.inference import Inspector

        return (inspector or Inspector()).schema(self)

    def infer_records(self, inspector=None) -> Table:
        return self.infer_schema(inspector).parse(self)

    def as_objects(self, cls: type) -> Iterator:
        from sparktab.operators.mapping import Mapper

        return Mapper(cls).objects(self)

    def first_as_object(self, cls: type):
        return next(iter(self.slice(0, 1).as_objects(cls)), None)

    def nth_as_object(self, n: int, cls: type):
        return next(iter(self.slice(n, 1).as_objects(cls)), None)

    def last_as_object(self, cls: type):
        n = self.count()
        return self.nth_as_object(n - 1, cls) if n else None

    def to_list(self) -> list:
        return list(self.records())


def _kind(values: list) -> T.DataType:
    for types, kind in ((bool, T.BooleanType()), (int, T.LongType()), ((int, float), T.DoubleType())):
        some = [v for v in values if v is not None]
        if some and all(isinstance(v, types) and (types is bool or not isinstance(v, bool)) for v in some):
            return kind
    return T.StringType()
