"""Records to typed objects: annotations of a dataclass compile to strict casts."""

from __future__ import annotations

import dataclasses
import datetime
import json
import re
import types
import typing
from collections.abc import Callable, Iterator
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktab.errors import DenormalizationFailed, MappingFailed, TypeCastingFailed
from sparktab.functions.text import trim
from sparktab.operators.inference import FLOAT, INTEGER, java_format

@typing.runtime_checkable
class TypeCasting(typing.Protocol):
    """A cast as an object: `to_variable` gives the value of a cell as an expression that raises where it cannot be cast."""

    def to_variable(self, c: Column, name: str) -> Column: ...


#: Registered casts: by type, and by alias `@name`.
_TYPES: dict[type, Callable] = {}
_ALIASES: dict[str, Callable] = {}


def register_type(kind: type, cast: Callable) -> None:
    _TYPES[kind] = cast


def register_alias(name: str, cast: Callable) -> None:
    if not re.fullmatch(r"@\w+", name) or name in _ALIASES:
        raise MappingFailed(f"the alias {name!r} is not valid or is taken")
    _ALIASES[name] = cast


def unregister(what: type | str) -> bool:
    return (_ALIASES if isinstance(what, str) else _TYPES).pop(what, None) is not None


def unregister_all() -> None:
    _TYPES.clear()
    _ALIASES.clear()


def registered() -> tuple[list, list]:
    return list(_TYPES), list(_ALIASES)


def cell(column: str | int | None = None, cast: str | Callable | None = None, ignore: bool = False, empty_to_null: bool | None = None, trim_first: bool | None = None, default=dataclasses.MISSING, **options):
    """A dataclass field with mapping options (column, cast or alias, and options of the cast)."""
    meta = {"cell": {"column": column, "cast": cast, "ignore": ignore, "empty_to_null": empty_to_null, "trim_first": trim_first, "options": options}}
    return dataclasses.field(metadata=meta) if default is dataclasses.MISSING else dataclasses.field(default=default, metadata=meta)


def record(after_mapping: tuple[str, ...] = (), empty_to_null: bool = True, trim_first: bool = False):
    """A class decorator: hooks to call on each object, and defaults for its cells."""

    def mark(cls):
        cls.__mapping__ = {"after": after_mapping, "empty_to_null": empty_to_null, "trim_first": trim_first}
        return cls

    return mark


def setter(column: str | int | None = None, cast: str | Callable | None = None, **options):
    """Marks a method of one argument, whose annotation is its type; a method named set_x is one for column x without the mark."""

    def mark(method):
        method.__setter__ = {"column": column, "cast": cast, "options": options}
        return method

    return mark


def _setters(cls: type) -> list[tuple[str, str | int, dict, typing.Any]]:
    """(method, column, options, type) of a class's setter methods."""
    out = []
    for name, method in vars(cls).items():
        own = getattr(method, "__setter__", None)
        if not callable(method) or own is None and not name.startswith("set_"):
            continue
        hints = [h for k, h in typing.get_type_hints(method).items() if k != "return"]
        if len(hints) != 1:
            if own is None:
                continue
            raise MappingFailed(f"the method {name} needs one argument with a type")
        meta = own or {"column": None, "cast": None, "options": {}}
        out.append((name, meta["column"] if meta["column"] is not None else name.removeprefix("set_"), meta, hints[0]))
    return out


def _checked(ok: Column, value: Column, c: Column, name: str, kind: str) -> Column:
    message = F.concat(F.lit(f"column {name}: cannot cast "), F.coalesce(F.to_json(F.struct(c.alias("value"))), F.lit("null")), F.lit(f" to {kind}"))
    return F.when(ok, value).otherwise(F.raise_error(message))


def cast_int(c: Column, name: str, default=None) -> Column:
    v = F.when(c.isNull(), F.lit(default).cast("bigint")).when(c.rlike(INTEGER), c.try_cast("bigint"))
    return F.when(c.isNull(), v).otherwise(_checked(v.isNotNull(), v, c, name, "int"))


def cast_float(c: Column, name: str, default=None) -> Column:
    v = F.when(c.rlike(FLOAT), c.try_cast("double"))
    return F.when(c.isNull(), F.lit(default).cast("double")).otherwise(_checked(v.isNotNull(), v, c, name, "float"))


def cast_bool(c: Column, name: str, default=None) -> Column:
    return F.when(c.isNull(), F.lit(default).cast("boolean")).otherwise(F.lower(c).isin("1", "true", "on", "yes"))


def cast_string(c: Column, name: str, default=None) -> Column:
    return F.coalesce(c, F.lit(default).cast("string"))


def cast_date(c: Column, name: str, default=None, format: str | None = None, timezone: str | None = None) -> Column:
    """By format, else ISO dates and times only; relative words such as tomorrow are errors."""
    if format == "U":
        v = F.timestamp_seconds(c.try_cast("bigint"))
    elif format:
        java, shape = java_format(format)
        v = F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(java)))
    else:
        v = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.try_cast("timestamp"))
    if timezone:
        v = F.to_utc_timestamp(v, timezone)
    return F.when(c.isNull(), F.lit(default).cast("timestamp")).otherwise(_checked(v.isNotNull(), v, c, name, "date"))


def cast_enum(c: Column, name: str, enum: type[Enum], default=None) -> Column:
    values = [str(e.value) for e in enum]
    return F.when(c.isNull(), F.lit(None if default is None else str(getattr(default, "value", default)))).otherwise(_checked(c.isin(values), c, c, name, enum.__name__))


def cast_array(c: Column, name: str, shape: str = "list", separator: str = ",", depth: int = 512, of: str = "string", default=None) -> Column:
    """list: split by a separator; csv: a CSV line; json: a JSON list. Elements are cast to `of`."""
    if shape == "list":
        parts = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, re.escape(separator)))
    elif shape == "json":
        parts = F.when(c == "", F.array().cast("array<string>")).otherwise(F.from_json(c, "array<string>"))
    elif shape == "csv":
        parts = F.udf(_csv_cells, "array<string>", useArrow=True)(c, F.lit(separator))
    else:
        raise MappingFailed(f"unknown array shape {shape!r}")
    value = F.transform(parts, lambda x: x.try_cast(of)) if of != "string" else parts
    return F.when(c.isNull(), F.lit(default)).otherwise(_checked(parts.isNotNull(), value, c, name, "array"))


def _csv_cells(text: str | None, separator: str) -> list[str] | None:
    import csv

    return None if text is None else next(csv.reader([text], delimiter=separator), [])


_SPARK = {int: cast_int, float: cast_float, bool: cast_bool, str: cast_string, datetime.datetime: cast_date, datetime.date: cast_date, list: cast_array, typing.Any: cast_string, object: cast_string}


def resolve(annotation) -> tuple[type, bool]:
    """The first supported type of an annotation, and whether null is allowed."""
    parts = typing.get_args(annotation) if isinstance(annotation, types.UnionType) or typing.get_origin(annotation) is typing.Union else (annotation,)
    null = type(None) in parts or annotation in (typing.Any, object)
    for part in parts:
        base = typing.get_origin(part) or part
        if part in _TYPES or base in _SPARK or isinstance(base, type) and issubclass(base, Enum):
            return part, null
    raise MappingFailed(f"no cast for {annotation!r}")


class Mapper:
    """Compiles a dataclass once; `columns` is one projection, `objects` streams typed objects."""

    def __init__(self, cls: type):
        if not dataclasses.is_dataclass(cls):
            raise MappingFailed(f"{cls.__name__} is not a dataclass")
        self.cls, self.options = cls, getattr(cls, "__mapping__", {"after": (), "empty_to_null": True, "trim_first": False})
        hints = typing.get_type_hints(cls)
        self.fields, self.setters = [], []
        for name, column, meta, hint in _setters(cls):
            f = types.SimpleNamespace(name=name, default=dataclasses.MISSING, default_factory=dataclasses.MISSING)
            self.setters.append(name)
            self.fields.append((f, meta | {"column": column}, hint))
        own = {column for _, column, _, _ in _setters(cls)}
        for f in dataclasses.fields(cls):
            if f.name in own and (f.default is not dataclasses.MISSING or f.default_factory is not dataclasses.MISSING):
                continue  # its setter takes the column
            meta = f.metadata.get("cell", {})
            if meta.get("ignore"):
                continue
            self.fields.append((f, meta, hints[f.name]))

    def columns(self, table) -> dict[str, Column]:
        out = {}
        for f, meta, hint in self.fields:
            source = meta.get("column") if meta.get("column") is not None else f.name
            if isinstance(source, str) and source not in table.columns:
                if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                    raise DenormalizationFailed(f"no column for the property {f.name}")
                continue
            c, _ = table.resolve(source)
            c = c.cast("string")
            pick = lambda key: meta[key] if meta.get(key) is not None else self.options[key]
            if pick("trim_first"):
                c = trim(c)
            if pick("empty_to_null"):
                c = F.when(c != "", c)
            options, cast = dict(meta.get("options") or {}), meta.get("cast")
            kind, null = resolve(hint) if cast is None else (None, True)
            if isinstance(cast, str):
                if cast not in _ALIASES:
                    raise MappingFailed(f"unknown alias {cast!r}")
                value = _ALIASES[cast](c, f.name, **options)
            elif isinstance(cast, TypeCasting):
                value = (cast(**options) if isinstance(cast, type) else cast).to_variable(c, f.name)
            elif cast is not None:
                value = cast(c, f.name, **options)
            elif kind in _TYPES:
                value = _TYPES[kind](c, f.name, **options)
            elif isinstance(kind, type) and issubclass(kind, Enum):
                value = cast_enum(c, f.name, kind, **options)
            else:
                base = typing.get_origin(kind) or kind
                if base is list and typing.get_args(kind):
                    options.setdefault("of", {int: "bigint", float: "double", bool: "boolean"}.get(typing.get_args(kind)[0], "string"))
                value = _SPARK[base](c, f.name, **options)
            if not null and "default" not in options:
                value = _checked(c.isNotNull() if (typing.get_origin(kind) or kind) is not str else value.isNotNull(), value, c, f.name, getattr(kind, "__name__", str(kind)))
            out[f.name] = value
        return out

    def to_table(self, table):
        return table.map(self.columns(table), "")

    def objects(self, table) -> Iterator:
        mapped = self.to_table(table)
        hints = {f.name: resolve(h)[0] for f, m, h in self.fields if m.get("cast") is None}
        try:
            for r in mapped.records():
                values = {k: hints[k](v) if v is not None and isinstance(hints.get(k), type) and issubclass(hints[k], Enum) else v.date() if v is not None and hints.get(k) is datetime.date else v for k, v in r.items()}
                late = [(k, values.pop(k)) for k in self.setters if k in values]
                made = self.cls(**values)
                for method, v in late:
                    getattr(made, method)(v)
                for hook in self.options["after"]:
                    getattr(made, hook)()
                yield made
        except Exception as e:
            if "cannot cast" in str(e):
                raise TypeCastingFailed.of(str(e)) from e
            raise


def assign(cls: type, row: dict):
    """One object of one record."""
    from pyspark.sql import SparkSession

    from sparktab.table import Table

    text = {k: None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in row.items()}
    return next(Mapper(cls).objects(Table.from_records(SparkSession.getActiveSession(), [text])))
