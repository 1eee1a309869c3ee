"""RFC 7111 fragments: row=, col= and cell= selections."""

from __future__ import annotations

import re

from sparktab.errors import FragmentNotFound
from sparktab.plans.predicate import Criteria, Offset

_EXPRESSION = re.compile(r"^\s*(row|col|cell)=(.+)$", re.IGNORECASE)
_RANGE = re.compile(r"^(\d+)(?:-(\d+|\*))?$")
_CELL = re.compile(r"^(\d+),(\d+)(?:-(?:(\d+),(\d+)|(\*)))?$")


def parse(expression: str) -> tuple[str, list[tuple | None]]:
    """Kind and selections; None stands for an invalid one. Ends are None where open."""
    found = _EXPRESSION.match(expression)
    if not found:
        return "unknown", []
    kind = found[1].lower()
    return kind, [(_cell if kind == "cell" else _range)(x.strip()) for x in found[2].split(";")]


def _range(text: str) -> tuple[int, int | None] | None:
    m = _RANGE.match(text)
    if not m or int(m[1]) < 1:
        return None
    start = int(m[1]) - 1
    if m[2] is None:
        return start, start
    if m[2] == "*":
        return start, None
    end = int(m[2]) - 1
    return (start, end) if end > start else None


def _cell(text: str) -> tuple | None:
    m = _CELL.match(text)
    if not m or int(m[1]) < 1 or int(m[2]) < 1:
        return None
    row, col = int(m[1]) - 1, int(m[2]) - 1
    if m[5]:
        return row, col, None, None
    if m[3] is None:
        return row, col, row, col
    end_row, end_col = int(m[3]) - 1, int(m[4]) - 1
    return (row, col, end_row, end_col) if end_row >= row and end_col >= col and (end_row, end_col) != (row, col) else None


def _clamped(start: int, end: int | None, width: int) -> tuple[int, int] | None:
    return None if start >= width else (start, width - 1 if end is None else min(end, width - 1))


def find_all(expression: str, table) -> list:
    """Tables of the valid selections: one for rows or columns, one for each cell range."""
    kind, selections = parse(expression)
    valid = [s for s in selections if s is not None]
    if kind == "row":
        rows = [Offset("between", [a, b]) if b is not None else Offset(">=", a) for a, b in valid]
        return [table.filter(Criteria.any(*rows))] if rows else []
    width = table.width() if valid else 0
    if kind == "col":
        spans = [s for a, b in valid if (s := _clamped(a, b, width))]
        columns = [i for a, b in spans for i in range(a, b + 1)]
        return [table.select(*columns)] if columns else []
    out = []
    for row, col, end_row, end_col in valid:
        span = _clamped(col, end_col, width)
        if span:
            size = -1 if end_row is None else end_row - row + 1
            out.append(table.slice(row, size).select(*range(span[0], span[1] + 1)))
    return out


def find_first(expression: str, table):
    return next((t for t in find_all(expression, table) if not t.is_empty()), None)


def find_first_or_fail(expression: str, table):
    kind, selections = parse(expression)
    if kind == "unknown" or not selections or None in selections:
        raise FragmentNotFound(f"the expression {expression!r} is not valid")
    if kind != "row":
        width = table.width()
        if any((s[0] if kind == "col" else s[1]) >= width for s in selections):
            raise FragmentNotFound(f"the expression {expression!r} selects nothing")
    found = find_first(expression, table)
    if found is None:
        raise FragmentNotFound(f"the expression {expression!r} selects nothing")
    return found
