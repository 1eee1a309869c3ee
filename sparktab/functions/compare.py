"""Comparison operators: aliases, checks of operands, and two-valued expressions.

Equality and membership are strict about types; order comparisons are loose, so text that holds a
number compares as a number. The branch is chosen from the static types, so that typed columns
keep plain comparisons that reach the scan.
"""

from __future__ import annotations

import datetime
import decimal
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.errors import InvalidArgument, QueryException
from sparktab.functions.text import NUMERIC, number_in, translate_regex


class Op(Enum):
    EQ = "="
    NEQ = "!="
    GT = ">"
    GTE = ">="
    LT = "<"
    LTE = "<="
    BETWEEN = "BETWEEN"
    NBETWEEN = "NBETWEEN"
    REGEXP = "REGEXP"
    NREGEXP = "NREGEXP"
    IN = "IN"
    NIN = "NIN"
    CONTAINS = "CONTAINS"
    NCONTAIN = "NCONTAIN"
    STARTS_WITH = "STARTS_WITH"
    ENDS_WITH = "ENDS_WITH"

    @classmethod
    def parse(cls, name: Op | str, compat_bugs: bool = False) -> Op:
        if isinstance(name, Op):
            return name
        key = str(name).strip().upper()
        if key in ("NOT_BETWEEN", "NOT BETWEEN"):
            return cls.BETWEEN if compat_bugs else cls.NBETWEEN
        for op, names in ALIASES.items():
            if key == op.value or key in names:
                return op
        raise QueryException(f"unknown operator {name!r}")


# fixed values: further names of the operators
ALIASES = {
    Op.EQ: ("EQ", "IS", "EQUAL", "EQUALS"), Op.NEQ: ("<>", "NEQ", "IS NOT", "NOT EQUAL"), Op.GT: ("GT", "GREATER THAN"), Op.GTE: ("GTE", "GREATER THAN OR EQUAL"), Op.LT: ("LT", "LESSER THAN"), Op.LTE: ("LTE", "LESSER THAN OR EQUAL"),
    Op.BETWEEN: (), Op.NBETWEEN: (), Op.REGEXP: (), Op.NREGEXP: ("NOT_REGEXP", "NOT REGEXP"), Op.IN: (), Op.NIN: ("NOT_IN", "NOT IN"), Op.CONTAINS: (), Op.NCONTAIN: ("NOT_CONTAIN", "NOT CONTAIN", "DOES_NOT_CONTAIN", "DOES NOT CONTAIN"),
    Op.STARTS_WITH: ("STARTS WITH", "START WITH"), Op.ENDS_WITH: ("ENDS WITH", "END WITH"),
}
ORDER = {Op.GT, Op.GTE, Op.LT, Op.LTE}
TEXT = {Op.REGEXP, Op.NREGEXP, Op.CONTAINS, Op.NCONTAIN, Op.STARTS_WITH, Op.ENDS_WITH}
_PLAIN = {Op.GT: lambda a, b: a > b, Op.GTE: lambda a, b: a >= b, Op.LT: lambda a, b: a < b, Op.LTE: lambda a, b: a <= b}


def accept(op: Op, reference: object) -> object:
    """The reference, if the operator can use it."""
    if op in (Op.BETWEEN, Op.NBETWEEN) and not (isinstance(reference, (list, tuple)) and len(reference) == 2):
        raise QueryException(f"{op.value} needs a list of two values")
    if op in (Op.IN, Op.NIN) and not isinstance(reference, (list, tuple)):
        raise QueryException(f"{op.value} needs a list")
    if op in TEXT and not (isinstance(reference, str) and reference):
        raise QueryException(f"{op.value} needs a text that is not empty")
    if op in (Op.REGEXP, Op.NREGEXP):
        try:
            translate_regex(reference)
        except InvalidArgument as e:
            raise QueryException(str(e)) from e
    return reference


def family(kind: T.DataType | object) -> str:
    """null, bool, int, float, text, time or other, of a Spark type or a Python value."""
    if not isinstance(kind, T.DataType):
        for types, name in ((type(None), "null"), (bool, "bool"), (int, "int"), ((float, decimal.Decimal), "float"), (str, "text"), ((datetime.datetime, datetime.date), "time")):
            if isinstance(kind, types):
                return name
        return "other"
    for types, name in ((T.NullType, "null"), (T.BooleanType, "bool"), (T.IntegralType, "int"), ((T.FractionalType,), "float"), ((T.StringType,), "text"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "time")):
        if isinstance(kind, types):
            return name
    return "other"


class Total:
    """A boolean expression and what it means where it is null."""

    def __init__(self, expr: Column, null: Column | bool = False, subject: Column | None = None):
        self.expr, self.null, self.subject = expr, null, subject

    def column(self) -> Column:
        """For any position."""
        return F.coalesce(self.expr, self.null if isinstance(self.null, Column) else F.lit(self.null))

    def positive(self) -> Column:
        """For a filter's own conjunctions and disjunctions: null drops the row, so the scan gets bare comparisons."""
        if self.null is False:
            return self.expr
        if self.null is True and self.subject is not None:
            return self.expr | self.subject.isNull()
        return self.column()


def _truth(c: Column, fam: str) -> Column:
    if fam == "null":
        return F.lit(False)
    if fam == "text":
        return F.coalesce((c != "") & (c != "0"), F.lit(False))
    if fam in ("int", "float"):
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(c, F.lit(False)) if fam == "bool" else c.isNotNull()


def loose(op: Op, a: Column, fa: str, b: Column, fb: str, value: object = ...) -> Total:
    """a op b under loose comparison. value: b as a Python literal, if it is one."""
    plain = _PLAIN[op]
    as_bool = lambda: plain(_truth(a, fa).cast("int"), _truth(b, fb).cast("int"))
    if "bool" in (fa, fb) or "null" in (fa, fb):
        if "text" in (fa, fb) and "null" in (fa, fb):
            empty = F.lit("")
            return Total(plain(F.coalesce(a, empty) if fa == "text" else empty, F.coalesce(b, empty) if fb == "text" else empty))
        return Total(as_bool())
    numbers = {"int", "float"}
    if fa in numbers and fb in numbers:
        if value is not ...:
            return Total(plain(a, b), bool(plain(0, int(bool(value)))), a)
        return Total(plain(a, b), as_bool())
    if fa == fb == "text":
        if value is not ...:
            import re

            null = bool(plain("", value))
            if not re.match(NUMERIC, value):
                return Total(plain(a, b), null, a)
            n = number_in(a)
            return Total(F.when(n.isNotNull(), plain(n, F.lit(float(value)))).otherwise(plain(a, b)), null, a)
        x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
        n, m = number_in(x), number_in(y)
        return Total(F.when(n.isNotNull() & m.isNotNull(), plain(n, m)).otherwise(plain(x, y)))
    if {fa, fb} <= numbers | {"text"}:
        n, m = (number_in(a), b) if fa == "text" else (a, number_in(b))
        both = n.isNotNull() & m.isNotNull()
        some = a.isNotNull() & b.isNotNull()
        return Total(F.when(both, plain(n, m)).when(some, plain(a.cast("string"), b.cast("string"))), as_bool())
    return Total(plain(a, b), as_bool() if value is ... else False)


def _same(a: Column, fa: str, b: Column, fb: str) -> Total:
    """Strict equality; null equals null only."""
    if fb == "null":
        return Total(a.isNull())
    if fa == "null":
        return Total(b.isNull())
    return Total(a.eqNullSafe(b)) if fa == fb else Total(a.isNull() & b.isNull())


def compare(op: Op, a: Column, kind: T.DataType, references: list[tuple[Column, str, object]]) -> Total:
    """Expression of `a op reference`; references: (column, family, literal or ...), several for lists."""
    fa = family(kind)
    if op in (Op.EQ, Op.NEQ):
        b, fb, value = references[0]
        same = _same(a, fa, b, fb)
        if value is not ... and fb != "null" and fa != fb:
            same = Total(F.lit(False))
        if op is Op.EQ:
            return same
        if value is not ... and fa == fb and fb != "null":
            return Total(a != b, True, a)
        return Total(~same.column())
    if op in ORDER:
        b, fb, value = references[0]
        return loose(op, a, fa, b, fb, value)
    if op in (Op.BETWEEN, Op.NBETWEEN):
        (lo, fl, vl), (hi, fh, vh) = references
        if op is Op.BETWEEN:
            x, y = loose(Op.GTE, a, fa, lo, fl, vl), loose(Op.LTE, a, fa, hi, fh, vh)
            return Total(x.expr & y.expr) if x.null is False or y.null is False else Total(x.column() & y.column())
        x, y = loose(Op.LT, a, fa, lo, fl, vl), loose(Op.GT, a, fa, hi, fh, vh)
        return Total(x.expr | y.expr) if x.null is False and y.null is False else Total(x.column() | y.column())
    if op in (Op.IN, Op.NIN):
        literal = all(v is not ... for _, _, v in references)
        if literal:
            same = [v for _, f, v in references if f == fa]
            found = a.isin(same) if same else F.lit(False)
            if any(f == "null" for _, f, _ in references):
                found = F.coalesce(found, F.lit(False)) | a.isNull()
                null: bool = True
            else:
                null = False
        else:
            found, null = F.lit(False), False
            for b, fb, _ in references:
                found = found | _same(a, fa, b, fb).column()
        if op is Op.IN:
            return Total(found, null)
        return Total(~found, True, a) if literal and not null else Total(~F.coalesce(found, F.lit(null)))
    if fa != "text":
        return Total(F.lit(False))
    value = references[0][2]
    if op in (Op.REGEXP, Op.NREGEXP):
        hit = a.rlike(translate_regex(value))
        return Total(hit if op is Op.REGEXP else ~hit)
    if op is Op.CONTAINS:
        return Total(a.contains(value))
    if op is Op.NCONTAIN:
        return Total(~a.contains(value))
    return Total(a.startswith(value) if op is Op.STARTS_WITH else a.endswith(value))
