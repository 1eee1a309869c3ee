"""Predicates over columns, pairs of columns and record offsets, and their algebra."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktab.errors import QueryException
from sparktab.functions.compare import Op, Total, accept, compare, family


class Predicate(Protocol):
    """Anything that gives a boolean expression for a table."""

    needs_offset: bool

    def total(self, table) -> Total: ...


def _reference(value: Any) -> list[tuple[Column, str, Any]]:
    values = value if isinstance(value, (list, tuple)) else [value]
    return [(F.lit(v), family(v), v) for v in values]


class Col:
    """A column against a literal, or a closure on its value (Python, in Arrow batches)."""

    needs_offset = False

    def __init__(self, column: str | int, op: Op | str | Callable, value: Any = None, compat_bugs: bool = False):
        self.column, self.closure = column, op if callable(op) and not isinstance(op, (Op, str)) else None
        self.op = None if self.closure else Op.parse(op, compat_bugs)
        self.value = None if self.closure else accept(self.op, value)

    def total(self, table) -> Total:
        c, kind = table.resolve(self.column)
        if self.closure:
            f = self.closure
            return Total(F.udf(lambda v: bool(f(v)), "boolean", useArrow=True)(c))
        return compare(self.op, c, kind, _reference(self.value))


class Cols:
    """A column against another one, or a list of others for BETWEEN and IN."""

    needs_offset = False

    def __init__(self, column: str | int, op: Op | str | Callable, other: str | int | list, compat_bugs: bool = False):
        self.column, self.other = column, other
        self.closure = op if callable(op) and not isinstance(op, (Op, str)) else None
        self.op = None if self.closure else Op.parse(op, compat_bugs)
        many = isinstance(other, (list, tuple))
        if self.op in (Op.BETWEEN, Op.NBETWEEN) and not (many and len(other) == 2):
            raise QueryException("two columns are needed")
        if self.op in (Op.IN, Op.NIN) and not many:
            raise QueryException("a list of columns is needed")

    def total(self, table) -> Total:
        a, kind = table.resolve(self.column)
        others = [table.resolve(o) for o in (self.other if isinstance(self.other, (list, tuple)) else [self.other])]
        if self.closure:
            f = self.closure
            if isinstance(self.other, (list, tuple)):
                return Total(F.udf(lambda x, y: bool(f(x, list(y))), "boolean", useArrow=True)(a, F.array(*[c for c, _ in others])))
            return Total(F.udf(lambda x, y: bool(f(x, y)), "boolean", useArrow=True)(a, others[0][0]))
        if self.op in (Op.CONTAINS, Op.NCONTAIN, Op.STARTS_WITH, Op.ENDS_WITH):
            b = others[0][0]
            if family(kind) != "text" or family(others[0][1]) != "text":
                return Total(F.lit(False))
            hit = {Op.CONTAINS: a.contains(b), Op.NCONTAIN: ~a.contains(b), Op.STARTS_WITH: a.startswith(b), Op.ENDS_WITH: a.endswith(b)}[self.op]
            return Total(hit)
        if self.op in (Op.REGEXP, Op.NREGEXP):
            b = others[0][0]
            # a delimited pattern such as /x/i, from cell to cell
            flags = F.regexp_replace(F.regexp_extract(b, r"(?s)^\W.*\W([A-Za-z]*)$", 1), "[uUD]", "")
            body = F.regexp_extract(b, r"(?s)^\W(.*)\W[A-Za-z]*$", 1)
            hit = F.regexp(a, F.concat(F.when(flags != "", F.concat(F.lit("(?"), flags, F.lit(")"))).otherwise(F.lit("")), body))
            return Total(hit if self.op is Op.REGEXP else ~hit)
        return compare(self.op, a, kind, [(c, family(k), ...) for c, k in others])


class Offset:
    """A record's offset against a literal, or a closure on it."""

    needs_offset = True

    def __init__(self, op: Op | str | Callable, value: Any = None, compat_bugs: bool = False):
        self.closure = op if callable(op) and not isinstance(op, (Op, str)) else None
        self.op = None if self.closure else Op.parse(op, compat_bugs)
        self.value = None if self.closure else accept(self.op, value)

    def total(self, table) -> Total:
        from pyspark.sql import types as T

        c = F.col(table.offset)
        if self.closure:
            f = self.closure
            return Total(F.udf(lambda v: bool(f(v)), "boolean", useArrow=True)(c))
        return compare(self.op, c, T.LongType(), _reference(self.value))


class Where:
    """An expression builder `columns -> Column`, a Column, or a closure on (record, offset) (Python, in Arrow batches)."""

    def __init__(self, f: Column | Callable, closure: bool = False):
        self.f, self.closure = f, closure
        self.needs_offset = closure

    def total(self, table) -> Total:
        if isinstance(self.f, Column):
            return Total(self.f)
        if not self.closure:
            return Total(self.f(table))
        f, headerless = self.f, table.headerless
        record = F.col(table.fields) if headerless else F.struct(*[F.col(f"`{c}`") for c in table.columns])
        call = lambda r, k: bool(f(list(r) if headerless else r.asDict() if hasattr(r, "asDict") else dict(r), k))
        return Total(F.udf(call, "boolean", useArrow=True)(record, F.col(table.offset)))


def as_predicate(p) -> Predicate:
    return p if hasattr(p, "total") else Where(p, closure=not isinstance(p, Column))


class Criteria:
    """all, any, none and xany of predicates, and their combinations."""

    def __init__(self, kind: str, parts: tuple):
        self.kind, self.parts = kind, parts
        self.needs_offset = any(p.needs_offset for p in parts)

    @classmethod
    def all(cls, *parts) -> Criteria:
        return cls("all", tuple(map(as_predicate, parts)))

    @classmethod
    def any(cls, *parts) -> Criteria:
        return cls("any", tuple(map(as_predicate, parts)))

    @classmethod
    def none(cls, *parts) -> Criteria:
        return cls("none", tuple(map(as_predicate, parts)))

    @classmethod
    def xany(cls, *parts) -> Criteria:
        return cls("xany", tuple(map(as_predicate, parts)))

    def total(self, table) -> Total:
        totals = [p.total(table) for p in self.parts]
        if self.kind in ("all", "any"):
            join = (lambda a, b: a & b) if self.kind == "all" else (lambda a, b: a | b)
            if not totals:
                return Total(F.lit(self.kind == "all"))
            out = Total(reduce(join, [t.column() for t in totals]))
            bare = reduce(join, [t.positive() for t in totals])
            out.positive = lambda: bare  # type: ignore[method-assign]
            return out
        if self.kind == "none":
            return Total(~reduce(lambda a, b: a | b, [t.column() for t in totals], F.lit(False)))
        return Total(reduce(lambda a, b: a != b, [t.column() for t in totals], F.lit(False)))

    def and_(self, *parts) -> Criteria:
        return Criteria.all(self, *parts)

    def or_(self, *parts) -> Criteria:
        return Criteria.any(self, *parts)

    def xor(self, *parts) -> Criteria:
        return Criteria.xany(self, *parts)

    def not_(self, *parts) -> Criteria:
        return Criteria.none(self, *parts)

    def and_not(self, *parts) -> Criteria:
        return Criteria.all(self, Criteria.none(*parts))

    def or_not(self, *parts) -> Criteria:
        return Criteria.any(self, Criteria.none(*parts))

    def xor_not(self, *parts) -> Criteria:
        return Criteria.xany(self, Criteria.none(*parts))
