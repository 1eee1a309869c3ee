"""The statement: an immutable single-table query, run as WHERE, ORDER BY, OFFSET and LIMIT, SELECT."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from sparktab.errors import InvalidArgument
from sparktab.plans.order import SortOn
from sparktab.plans.predicate import Col, Cols, Criteria, Offset, as_predicate


@dataclass(frozen=True)
class Statement:
    conditions: tuple = ()
    keys: tuple = ()
    skip: int = 0
    take: int = -1
    columns: tuple = ()
    mode: str = "select"
    compat_bugs: bool = field(default=False, kw_only=True)

    def where(self, predicate) -> Statement:
        return self._append("and", as_predicate(predicate))

    def _append(self, joiner: str, predicate) -> Statement:
        if joiner == "and":
            return replace(self, conditions=(*self.conditions, predicate))
        before = (Criteria.all(*self.conditions),) if self.conditions else ()
        join = {"or": Criteria.any, "xor": Criteria.xany, "not": Criteria.none}[joiner]
        return replace(self, conditions=(join(*before, predicate),))

    def append_where(self, joiner: str, predicate) -> Statement:
        return self._append(joiner.strip().lower(), as_predicate(predicate))

    def when(self, condition: Any, on_success: Callable, on_fail: Callable | None = None) -> Statement:
        flag = condition(self) if callable(condition) else condition
        return (on_success(self) if flag else on_fail(self) if on_fail else None) or self

    def order_by(self, *keys) -> Statement:
        return replace(self, keys=self.keys + keys)

    def order_by_asc(self, column: str | int, key: Callable | None = None) -> Statement:
        return self.order_by(SortOn(column, "asc", key))

    def order_by_desc(self, column: str | int, key: Callable | None = None) -> Statement:
        return self.order_by(SortOn(column, "desc", key))

    def offset(self, n: int) -> Statement:
        if n < 0:
            raise InvalidArgument("the offset must not be negative")
        return replace(self, skip=n)

    def limit(self, n: int) -> Statement:
        if n < -1:
            raise InvalidArgument("the limit must be -1 or more")
        return replace(self, take=n)

    def select(self, *columns: str | int) -> Statement:
        return replace(self, columns=columns, mode="select")

    def select_all_except(self, *columns: str | int) -> Statement:
        return replace(self, columns=columns, mode="except")

    def process(self, source, header: list[str] | dict[int, str] | None = None):
        """The resulting table, lazy. Unknown columns raise here."""
        from sparktab.table import Table

        table = Table.of(source)
        if header:
            table = table.map_header(header)
        if self.conditions:
            table = table.filter(Criteria.all(*self.conditions))
        if self.keys:
            table = table.sorted(*self.keys)
        if self.skip or self.take >= 0:
            if self.compat_bugs and self.take == 0 and self.skip:
                raise IndexError("an empty slice beyond the start")
            table = table.slice(self.skip, self.take)
        if self.columns:
            table = table.select(*self.columns) if self.mode == "select" else table.select_all_except(*self.columns)
        return table


def _family(build):
    def make(joiner: str):
        def method(self: Statement, *args) -> Statement:
            return self._append(joiner, build(*args, compat_bugs=self.compat_bugs))

        return method

    return make


for _suffix, _build in (("", Col), ("_column", Cols), ("_offset", Offset)):
    for _joiner, _name in (("and", "and_where"), ("or", "or_where"), ("xor", "xor_where"), ("not", "where_not")):
        setattr(Statement, _name + _suffix, _family(_build)(_joiner))
