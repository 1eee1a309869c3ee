"""Schema inference: fields that parse text into types, tried on a sample, applied to all records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktab.errors import InvalidArgument
from sparktab.functions.text import blank_to_null, trim

# fixed values: formats that the default fields try, in order
MACHINE_FORMATS = ("Y-m-d\\TH:i:sP", "Y-m-d H:i:s", "Y-m-d\\TH:i:s", "Y-m-d", "Y/m/d", "Ymd", "U")
LOCAL_FORMATS = ("d/m/Y", "m/d/Y", "d-m-Y", "m-d-Y", "d.m.Y", "d/m/Y H:i:s", "m/d/Y H:i:s")
# fixed values: letters of date formats and the Java letters for them
LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "n": "M", "d": "dd", "j": "d", "H": "HH", "G": "H", "h": "hh", "g": "h", "i": "mm", "s": "ss", "A": "a", "a": "a", "D": "EEE", "l": "EEEE", "M": "MMM", "F": "MMMM", "P": "XXX", "p": "XXX", "O": "xx", "u": "SSSSSS", "v": "SSS", "e": "VV", "T": "z"}
_SHAPES = {"Y": r"\d{4}", "y": r"\d{2}", "m": r"\d{2}", "n": r"\d{1,2}", "d": r"\d{2}", "j": r"\d{1,2}", "H": r"\d{2}", "G": r"\d{1,2}", "h": r"\d{2}", "g": r"\d{1,2}", "i": r"\d{2}", "s": r"\d{2}", "u": r"\d{1,6}", "v": r"\d{3}", "P": r"[+-]\d{2}:\d{2}", "p": r"(?:Z|[+-]\d{2}:\d{2})", "O": r"[+-]\d{4}"}
# fixed values: structured text
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ULID = r"^[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}$"
HEX_COLOR = r"^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"
JWT = r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$"
MD5 = r"^[0-9a-fA-F]{32}$"
SHA1 = r"^[0-9a-fA-F]{40}$"
INTEGER = r"^[+-]?(0|[1-9][0-9]{0,18})$"
FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def java_format(php: str) -> tuple[str, str]:
    """Java pattern and a regular expression for the exact shape."""
    out, shape, i = "", "^", 0
    while i < len(php):
        c = php[i]
        if c == "\\" and i + 1 < len(php):
            i += 1
            out += f"'{php[i]}'"
            shape += re.escape(php[i])
        elif c in "!|":
            pass
        elif c in LETTERS:
            out += LETTERS[c]
            shape += _SHAPES.get(c, r".+?")
        elif c.isalpha():
            raise InvalidArgument(f"the format letter {c!r} is not supported")
        else:
            out += c if c not in "'#[]{}" else f"'{c}'"
            shape += re.escape(c)
        i += 1
    return out, shape + "$"


def boolean(c: Column) -> Column:
    t = F.lower(trim(c))
    return F.when(t.isin("1", "true", "on", "yes"), F.lit(True)).when(t.isin("0", "false", "off", "no"), F.lit(False))


@dataclass(frozen=True)
class Field:
    """A type: parse gives a value or null; threshold is the share of non-blank cells that must parse."""

    type: str
    parse: Callable[[Column], Column]
    threshold: float = 0.8
    name: str = ""
    metadata: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise InvalidArgument("a threshold lies between 0 and 1")

    def evaluate(self, c: Column) -> Column:
        """1 for a valid cell, 0 for a blank one, -1 for an invalid one."""
        blank = blank_to_null(c).isNull()
        return F.when(blank, 0).when(self.parse(c).isNotNull(), 1).otherwise(-1)

    def union(self, other: dict) -> Field:
        """The field with more metadata; its own keys stay as they are."""
        return replace(self, metadata={**other, **self.metadata})

    def with_threshold(self, threshold: float) -> Field:
        return replace(self, threshold=threshold)


def BooleanField(threshold: float = 0.8) -> Field:
    return Field("boolean", boolean, threshold)


def NumericField(minimum: float | None = None, maximum: float | None = None, threshold: float = 0.8, as_long: bool = False) -> Field:
    if minimum is not None and maximum is not None and minimum > maximum:
        raise InvalidArgument("the minimum exceeds the maximum")

    def parse(c: Column) -> Column:
        t = trim(c)
        n = F.when(t.rlike(FLOAT), t.try_cast("double"))
        if minimum is not None:
            n = F.when(n >= minimum, n)
        if maximum is not None:
            n = F.when(n <= maximum, n)
        return F.when(n.isNotNull(), t.try_cast("bigint")) if as_long else n

    return Field("numeric", parse, threshold, metadata={"min": minimum, "max": maximum})


NumericField.min = lambda n, threshold=0.8: NumericField(n, None, threshold)
NumericField.max = lambda n, threshold=0.8: NumericField(None, n, threshold)
NumericField.fixed = lambda n, threshold=0.8: NumericField(n, n, threshold)
NumericField.between = lambda a, b, threshold=0.8: NumericField(a, b, threshold)
NumericField.positive = lambda threshold=0.8: NumericField(0, None, threshold)
NumericField.negative = lambda threshold=0.8: NumericField(None, 0, threshold)


def DateTimeField(format: str, timezone: str = "UTC", threshold: float = 0.8) -> Field:
    if format == "U":
        return Field("datetime", lambda c: F.when(trim(c).rlike(r"^-?\d{1,11}$"), F.timestamp_seconds(trim(c).try_cast("bigint"))), threshold, "U")
    java, shape = java_format(format)

    def parse(c: Column) -> Column:
        t = trim(c)
        at = F.try_to_timestamp(t, F.lit(java))
        if timezone != "UTC" and not set("PpOeT") & set(format):
            at = F.to_utc_timestamp(at, timezone)
        return F.when(t.rlike(shape), at)

    return Field("datetime", parse, threshold, format, {"format": format, "timezone": timezone})


DateTimeField.machine = lambda timezone="UTC", threshold=0.8: [DateTimeField(f, timezone, threshold) for f in MACHINE_FORMATS]
DateTimeField.localized = lambda timezone="UTC", threshold=0.7: [DateTimeField(f, timezone, threshold) for f in LOCAL_FORMATS]
DateTimeField.common = lambda timezone="UTC": [*DateTimeField.machine(timezone), *DateTimeField.localized(timezone)]
DateTimeField.timestamp = lambda threshold=0.8: DateTimeField("U", threshold=threshold)
DateTimeField.from_format = DateTimeField


def TimeField(precision: str = "any", threshold: float = 0.8) -> Field:
    """HH, HH:MM or HH:MM:SS with any one-byte separator, as padded text. precision: hours, minutes, seconds or any."""
    shapes = {"hours": r"^(\d{1,2})$", "minutes": r"^(\d{1,2})(\D)(\d{1,2})$", "seconds": r"^(\d{1,2})(\D)(\d{1,2})\2(\d{1,2})$"}

    def parse(c: Column) -> Column:
        t, out = trim(c), F.lit(None).cast("string")
        pad = lambda n, shape: F.lpad(F.regexp_extract(t, shape, n), 2, "0")
        for name in ("seconds", "minutes", "hours"):
            if precision not in (name, "any") or precision == "any" and name == "hours":
                continue
            shape = shapes[name]
            groups = {"hours": (1,), "minutes": (1, 3), "seconds": (1, 3, 4)}[name]
            ok = t.rlike(shape) & (pad(1, shape) < "24")
            for g in groups[1:]:
                ok = ok & (pad(g, shape) < "60")
            sep = F.regexp_extract(t, shape, 2) if len(groups) > 1 else F.lit("")
            out = F.coalesce(out, F.when(ok, F.concat_ws("", *[x for i, g in enumerate(groups) for x in ([sep] if i else []) + [pad(g, shape)]])))
        return out

    return Field("time", parse, threshold, precision)


def valid_json(c: Column) -> Column:
    """Whether a text is one JSON document and not null. As the only element of a list and of an object it can have nothing behind it."""
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    first = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>", strict)
    inner = F.from_json(F.concat(F.lit('{"a":'), c, F.lit("}")), "map<string,string>", strict)
    one = (F.size(first) == 1) & (F.size(inner) == 1) & F.get(first, F.lit(0)).isNotNull() & F.element_at(inner, "a").isNotNull()
    return F.coalesce(one, F.lit(False))


def JsonField(threshold: float = 0.8) -> Field:
    """A JSON document, kept as text; JSON null and trailing tokens are invalid."""
    return Field("json", lambda c: F.when(valid_json(trim(c)), trim(c)), threshold)


def EnumField(enum: type[Enum] | Iterable, threshold: float = 0.8) -> Field:
    values = [str(e.value) for e in enum] if isinstance(enum, type) else [str(v) for v in enum]
    return Field("enum", lambda c: F.when(trim(c).isin(values), trim(c)), threshold, metadata={"values": values})


def SetField(values: Iterable, delimiter: str = ",", threshold: float = 0.8) -> Field:
    """Distinct valid members in order; null if none is valid."""
    allowed = [str(getattr(v, "value", v)) for v in values]

    def parse(c: Column) -> Column:
        parts = F.transform(F.split(trim(c), re.escape(delimiter)), trim)
        kept = F.array_distinct(F.filter(parts, lambda x: x.isin(allowed)))
        return F.when(F.size(kept) > 0, kept)

    return Field("set", parse, threshold, metadata={"values": allowed})


def StringField(minimum: int | None = None, maximum: int | None = None, pattern: str | None = None, name: str = "", threshold: float = 0.8) -> Field:
    if minimum is not None and minimum < 0 or minimum is not None and maximum is not None and minimum > maximum:
        raise InvalidArgument("the lengths are not a range")

    def parse(c: Column) -> Column:
        t = blank_to_null(c)
        if minimum is not None:
            t = F.when(F.char_length(t) >= minimum, t)
        if maximum is not None:
            t = F.when(F.char_length(t) <= maximum, t)
        return F.when(t.rlike(pattern), t) if pattern else t

    return Field("string", parse, threshold, name)


for _name, _pattern in (("uuid", UUID), ("ulid", ULID), ("hex_color", HEX_COLOR), ("jwt_token", JWT), ("md5", MD5), ("sha1", SHA1)):
    setattr(StringField, _name, lambda threshold=0.8, _p=_pattern, _n=_name: StringField(pattern=_p, name=_n, threshold=threshold))
StringField.min = lambda n, threshold=0.8: StringField(n, None, threshold=threshold)
StringField.max = lambda n, threshold=0.8: StringField(None, n, threshold=threshold)
StringField.fixed = lambda n, threshold=0.8: StringField(n, n, threshold=threshold)
StringField.built_ins = lambda: [getattr(StringField, n)() for n in ("uuid", "ulid", "hex_color", "jwt_token", "md5", "sha1")]


def CustomField(name: str, f: Callable, result: str = "string", threshold: float = 0.8) -> Field:
    if not re.fullmatch(r"[a-z][a-z0-9]*(_[a-z0-9]+)*", name):
        raise InvalidArgument("the name of a custom field is in snake case")
    return Field("custom", lambda c: F.udf(f, result, useArrow=True)(c), threshold, name)


@dataclass(frozen=True)
class FieldList:
    fields: tuple[Field, ...] = ()

    @classmethod
    def default(cls) -> FieldList:
        return cls((BooleanField(), NumericField(), *DateTimeField.common(), TimeField(), JsonField(), *StringField.built_ins()))

    def append(self, *f: Field) -> FieldList:
        return FieldList(self.fields + f)

    def prepend(self, *f: Field) -> FieldList:
        return FieldList(f + self.fields)

    def replace(self, at: int, f: Field) -> FieldList:
        return FieldList(tuple(f if i == at % len(self.fields) else x for i, x in enumerate(self.fields)))

    def remove_by_offset(self, *at: int) -> FieldList:
        kept = tuple(x for i, x in enumerate(self.fields) if i not in {k % len(self.fields) for k in at})
        return FieldList(kept) if kept else self

    def remove_by_type(self, *types: str) -> FieldList:
        return FieldList(tuple(x for x in self.fields if x.type not in types))

    def remove_by_name(self, *names: str) -> FieldList:
        return FieldList(tuple(x for x in self.fields if x.name not in names))

    def nth(self, at: int) -> Field | None:
        return self.fields[at] if -len(self.fields) <= at < len(self.fields) else None

    def get(self, type: str, name: str = "") -> Field | None:
        return next((x for x in self.fields if x.type == type and (not name or x.name == name)), None)

    def __iter__(self):
        return iter(self.fields)

    def __len__(self) -> int:
        return len(self.fields)


@dataclass(frozen=True)
class Schema:
    """Column names and their fields, in order; parsing gives null for what does not parse."""

    columns: tuple[tuple[str, Field], ...] = ()

    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    def types(self) -> dict[str, str]:
        return {n: f.type for n, f in self.columns}

    def has(self, name: str) -> bool:
        return name in self.names()

    def get(self, name: str) -> Field:
        try:
            return dict(self.columns)[name]
        except KeyError as e:
            raise InvalidArgument(f"unknown column {name!r}") from e

    def append(self, name: str, f: Field) -> Schema:
        if self.has(name):
            raise InvalidArgument(f"{name!r} is there already")
        return Schema((*self.columns, (name, f)))

    def replace(self, name: str, f: Field) -> Schema:
        self.get(name)
        return Schema(tuple((n, f if n == name else x) for n, x in self.columns))

    def remove(self, *names: str) -> Schema:
        return Schema(tuple((n, x) for n, x in self.columns if n not in names))

    def map(self, f: Callable) -> list:
        return [f(x, n) for n, x in self.columns]

    def parse(self, table):
        """One projection over all records; columns without a field stay as they are."""
        known = dict(self.columns)
        kinds = dict(table.df.dtypes)
        out = {}
        for n in table.columns:
            c = F.col(f"`{n}`")
            out[n] = known[n].parse(c if kinds[n] == "string" else c.cast("string")) if n in known else c
        return table.map(out, "")

    def format(self, record: dict) -> dict:
        from pyspark.sql import SparkSession

        from sparktab.table import Table

        text = {k: None if v is None else str(v) for k, v in record.items()}
        return self.parse(Table.from_records(SparkSession.getActiveSession(), [text])).first()


@dataclass(frozen=True)
class Inspector:
    fields: FieldList = field(default_factory=FieldList.default)
    sample_limit: int = 10

    def __post_init__(self):
        if self.sample_limit < 1:
            raise InvalidArgument("a sample has one record or more")

    def with_sample_limit(self, n: int) -> Inspector:
        return replace(self, sample_limit=n)

    def with_fields(self, fields: FieldList) -> Inspector:
        return replace(self, fields=fields)

    def scores(self, table) -> dict[str, list[float]]:
        """Of the first records: for each column and field the share of valid among non-blank cells, in one row."""
        sample = table.slice(0, self.sample_limit).df
        parts = []
        for i, n in enumerate(table.columns):
            c = F.col(f"`{n}`").cast("string")
            parts.append(F.sum((blank_to_null(c).isNotNull()).cast("int")).alias(f"n{i}"))
            parts += [F.count_if(f.evaluate(c) == 1).alias(f"s{i}_{k}") for k, f in enumerate(self.fields)]
            parts.append(F.bool_and(F.coalesce(blank_to_null(c).rlike(INTEGER), F.lit(True))).alias(f"i{i}"))
        row = sample.agg(*parts).first()
        return {n: [row[f"n{i}"] or 0, bool(row[f"i{i}"]), *[row[f"s{i}_{k}"] or 0 for k in range(len(self.fields))]] for i, n in enumerate(table.columns)}

    def schema(self, table) -> Schema:
        out = []
        for n, (filled, whole, *sums) in self.scores(table).items():
            # the best score wins, ties by the order of fields; then its threshold must be met
            ranked = sorted(((-s / filled, k) for k, s in enumerate(sums)), key=lambda x: x) if filled else []
            chosen = next((self.fields.fields[k] for s, k in ranked if -s >= self.fields.fields[k].threshold), None)
            chosen = chosen or StringField()
            if chosen.type == "numeric" and whole:
                chosen = NumericField(chosen.metadata.get("min"), chosen.metadata.get("max"), chosen.threshold, as_long=True)
            out.append((n, chosen))
        return Schema(tuple(out))
