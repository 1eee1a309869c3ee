"""A table with insert, update and delete: each change is a new version of a plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktab.errors import CannotInsertRecord, InvalidArgument
from sparktab.plans.predicate import as_predicate
from sparktab.table import Table

#: Versions after which the plan is checkpointed, so that it stays small.
CHECKPOINT_EVERY = 20


class Buffer:
    """Offsets of survivors keep their gaps, and `nth` looks an offset up. Counts are returned only if asked for."""

    def __init__(self, table: Table):
        self.table = table.with_offset()
        self.validators: dict[str, Callable[[Table], Column]] = {}
        self.formatters: list[Callable] = []
        self.versions = 0
        self._next: int | None = None  # the offset of the next record, while it is known

    @classmethod
    def of(cls, source) -> Buffer:
        return cls(Table.of(source))

    def to_table(self) -> Table:
        return self.table

    def add_validator(self, build: Callable[[Table], Column], name: str) -> Buffer:
        """build: table -> boolean expression that each inserted or updated record must meet."""
        self.validators[name] = build
        return self

    def add_formatter(self, f: Callable) -> Buffer:
        """f: DataFrame -> DataFrame, for inserted and updated records."""
        self.formatters.append(f)
        return self

    def _set(self, df) -> None:
        self.versions += 1
        if self.versions % CHECKPOINT_EVERY == 0 and df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            df = df.checkpoint()
        self.table = self.table._with(df)

    def _checked(self, table: Table) -> Table:
        for f in self.formatters:
            table = table._with(f(table.df))
        for name, build in self.validators.items():
            bad = table.df.where(~F.coalesce(build(table), F.lit(False))).limit(1).collect()
            if bad:
                raise CannotInsertRecord(name, table._record(bad[0]))
        return table

    def insert(self, *records: list | dict) -> int:
        """Lists must have the header's length, dicts its names; new offsets follow the last one."""
        header, rows = self.table.columns, []
        for r in records:
            if isinstance(r, dict) and set(r) == set(header):
                rows.append([r[h] for h in header])
            elif isinstance(r, (list, tuple)) and (self.table.headerless or len(r) == len(header)):
                rows.append(list(r))
            else:
                raise CannotInsertRecord("record_fields", r)
        if not rows:
            return 0
        if self._next is None:
            last = self.table.last_offset()
            self._next = 0 if last is None else last + 1
        start = self._next
        new = self._checked(Table.from_records(self.table.df.sparkSession, rows, None if self.table.headerless else header, start))
        kinds = self.table.df.schema
        cast = new.df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds.fields])
        self._set(self.table.df.unionByName(cast))
        self._next = start + len(rows)
        return len(rows)

    def update(self, where, record: dict | list, count: bool = True) -> int | None:
        """Sets columns by name or ordinal on matching records; a list sets all columns from the first, padded with null."""
        table, p = self.table, as_predicate(where)
        hit = p.total(table).column()
        if isinstance(record, (list, tuple)):
            record = {i: v for i, v in enumerate([*record, *[None] * (len(table.columns) - len(record))])}
        values = {}
        for k, v in record.items():
            if isinstance(k, int):
                if not 0 <= k < len(table.columns):
                    raise InvalidArgument(f"unknown column {k}")
                k = table.columns[k]
            if k not in table.columns:
                raise InvalidArgument(f"unknown column {k!r}")
            values[k] = v if isinstance(v, Column) else F.lit(v)
        if self.validators or self.formatters:
            changed = table.df.where(hit)
            self._checked(table._with(changed.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in changed.columns])))
        n = table.df.where(hit).count() if count else None
        self._set(table.df.select(*[F.when(hit, values[c].cast(t)).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c, t in table.df.dtypes]))
        return n

    def delete(self, where, count: bool = True) -> int | None:
        hit = as_predicate(where).total(self.table).column()
        n = self.table.df.where(hit).count() if count else None
        self._set(self.table.df.where(~hit))
        self._next = None
        return n

    def truncate(self) -> None:
        self._next = None
        self._set(self.table.df.where(F.lit(False)))

    def nth(self, n: int) -> Any:
        if n < 0:
            raise InvalidArgument("the position must be 0 or more")
        first = self.table.first_offset()
        rows = [] if first is None else self.table.df.where(F.col(self.table.offset) == first + n).limit(1).collect()
        return self.table._record(rows[0]) if rows else []

    def first(self) -> Any:
        return self.nth(0)

    def last(self) -> Any:
        return self.table.last()

    def fetch_column(self, index: str | int = 0) -> list:
        """With nulls, in order of offsets."""
        c, _ = self.table.resolve(index)
        return [r["v"] for r in self.table.df.orderBy(self.table.offset).select(c.alias("v")).toLocalIterator()]

    def is_empty(self) -> bool:
        return self.table.is_empty()

    def record_count(self) -> int:
        return self.table.count()

    def has_header(self) -> bool:
        return self.table.has_header()

    def first_offset(self) -> int | None:
        return self.table.first_offset()

    def last_offset(self) -> int | None:
        return self.table.last_offset()

    def to(self, writer, header: bool = True) -> int:
        if header and self.table.columns:
            writer.insert_one(self.table.columns)
        return writer.insert_all(self.table)
