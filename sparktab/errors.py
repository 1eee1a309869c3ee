"""Errors of the engine."""

from __future__ import annotations

import re


class TableError(Exception):
    """Base of all errors."""


class InvalidArgument(TableError, ValueError):
    """A value outside what an operator accepts."""


class SyntaxProblem(InvalidArgument):
    """A header that is missing, not text, or has duplicates."""

    def __init__(self, message: str, duplicates: tuple[str, ...] = ()):
        super().__init__(message)
        self.duplicates = duplicates


class QueryException(TableError):
    """An unknown column, offset, operator or direction."""


class CannotInsertRecord(TableError):
    """A record that a validator or the header rejects."""

    def __init__(self, name: str, record: object):
        super().__init__(f"the record was rejected by `{name}`: {record!r}")
        self.name, self.record = name, record


class FragmentNotFound(InvalidArgument):
    """A fragment expression without a result."""


class UnavailableStream(TableError):
    """A document that cannot be opened."""


class UnavailableFeature(TableError):
    """A feature that the source or sink does not have."""


class TypeCastingFailed(TableError):
    """A cell that cannot be cast to its declared type: column, value (as JSON) and target say which, if known."""

    column: str | None = None
    value: str | None = None
    target: str | None = None

    @classmethod
    def of(cls, message: str) -> TypeCastingFailed:
        """From the message of a cast that was raised on an executor."""
        found = re.search(r"column (\S+): cannot cast (.+) to (\w+)", message)
        out = cls(found.group() if found else message)
        if found:
            out.column, out.value, out.target = found.groups()
        return out


class MappingFailed(TableError):
    """A class that cannot be mapped."""


class DenormalizationFailed(MappingFailed):
    """A property that was not initialised."""
