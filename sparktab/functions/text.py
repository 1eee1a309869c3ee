"""Text expressions: trimming, numbers in text, formula escaping, charsets and record transforms."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktab.errors import InvalidArgument

# fixed values: the characters that trimming removes
TRIMMED = " \t\n\r\0\x0b"
NUMERIC = r"^[ \t\n\r\x0B\f]*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ \t\n\r\x0B\f]*$"


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(TRIMMED))


def blank_to_null(c: Column) -> Column:
    t = trim(c)
    return F.when(t != "", t)


def number_in(c: Column) -> Column:
    """The number in a numeric string, else null; NaN, Infinity and suffixes are no numbers."""
    return F.when(c.rlike(NUMERIC), F.trim(c, F.lit(" \t\n\r\x0b\f")).try_cast("double"))


def translate_regex(pattern: str) -> str:
    """A delimited pattern such as /x/i as a Java pattern."""
    if len(pattern) < 3 or pattern[0].isalnum() or pattern[0] in "\\ ":
        raise InvalidArgument(f"invalid regular expression: {pattern!r}")
    close = {"(": ")", "[": "]", "{": "}", "<": ">"}.get(pattern[0], pattern[0])
    end = pattern.rfind(close)
    if end <= 0:
        raise InvalidArgument(f"no ending delimiter in {pattern!r}")
    flags = pattern[end + 1 :]
    if set(flags) - set("imsxuUD"):
        raise InvalidArgument(f"unknown modifiers {flags!r}")
    java = "".join(f for f in flags if f in "imsxu")
    return (f"(?{java})" if java else "") + pattern[1:end]


@dataclass(frozen=True)
class EscapeFormula:
    """Marks cells that a spreadsheet would take for a formula."""

    escape: str = "'"
    special: tuple[str, ...] = ()

    # fixed values: the characters that begin a formula
    DEFAULT = ("=", "-", "+", "@", "\t", "\r")

    def _class(self) -> str:
        for c in self.special:
            if len(c) != 1:
                raise InvalidArgument("special characters must be single characters")
        return "[" + "".join("\\" + c if not c.isalnum() and c not in "\t\r" else c for c in (*self.DEFAULT, *self.special)) + "]"

    def escape_cell(self, c: Column) -> Column:
        risky = c.rlike("^" + self._class()) | c.startswith(self.escape)
        return F.when(risky, F.concat(F.lit(self.escape), c)).otherwise(c)

    def unescape_cell(self, c: Column) -> Column:
        rest = F.substring(c, len(self.escape) + 1, 1 << 30)
        return F.when(c.startswith(self.escape) & (rest.rlike("^" + self._class()) | rest.startswith(self.escape)), rest).otherwise(c)

    def _apply(self, df, f):
        return df.select(*[f(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])

    def escape_records(self, df):
        return self._apply(df, self.escape_cell)

    def unescape_records(self, df):
        return self._apply(df, self.unescape_cell)


@dataclass(frozen=True)
class EnumFormatter:
    """Enum cells as names, values or by a callback; works on plain Python records before they are written."""

    encode: object = field(default=lambda e: e.name)

    @classmethod
    def using_name(cls) -> EnumFormatter:
        return cls(lambda e: e.name)

    @classmethod
    def using_value(cls) -> EnumFormatter:
        return cls(lambda e: e.value)

    using_json = using_value

    @classmethod
    def using_callback(cls, f) -> EnumFormatter:
        return cls(f)

    def __call__(self, record):
        one = lambda v: self.encode(v) if isinstance(v, Enum) else v
        return {k: one(v) for k, v in record.items()} if isinstance(record, dict) else [one(v) for v in record]

    @staticmethod
    def column(c: Column, enum: type[Enum], by: str = "name") -> Column:
        """Names from values (or values from names) as a map expression."""
        pairs = [(e.value, e.name) if by == "name" else (e.name, e.value) for e in enum]
        return F.create_map(*[F.lit(x) for p in pairs for x in p])[c]


# fixed values: byte-order marks, in order of detection
BOMS = {"UTF-32LE": b"\xff\xfe\x00\x00", "UTF-32BE": b"\x00\x00\xfe\xff", "UTF-16BE": b"\xfe\xff", "UTF-16LE": b"\xff\xfe", "UTF-8": b"\xef\xbb\xbf"}


class Bom:
    """Byte-order marks by sequence and by encoding."""

    @staticmethod
    def try_from_sequence(data: bytes | str) -> str | None:
        data = data.encode() if isinstance(data, str) else data
        return next((name for name, mark in BOMS.items() if data.startswith(mark)), None)

    @staticmethod
    def from_sequence(data: bytes | str) -> str:
        if (found := Bom.try_from_sequence(data)) is None:
            raise InvalidArgument("no byte-order mark")
        return found

    @staticmethod
    def try_from_encoding(name: str) -> str | None:
        key = name.upper().replace("_", "-").replace(" ", "")
        key = {"UTF8": "UTF-8", "UTF16": "UTF-16", "UTF32": "UTF-32", "UTF16LE": "UTF-16LE", "UTF16BE": "UTF-16BE", "UTF32LE": "UTF-32LE", "UTF32BE": "UTF-32BE"}.get(key, key)
        key = {"UTF-16": "UTF-16BE", "UTF-32": "UTF-32BE"}.get(key, key)
        return key if key in BOMS else None

    @staticmethod
    def from_encoding(name: str) -> str:
        if (found := Bom.try_from_encoding(name)) is None:
            raise InvalidArgument(f"no byte-order mark for {name}")
        return found

    @staticmethod
    def length(name: str) -> int:
        return len(BOMS[name])

    @staticmethod
    def is_utf8(name: str) -> bool:
        return name == "UTF-8"

    @staticmethod
    def is_utf16(name: str) -> bool:
        return name.startswith("UTF-16")

    @staticmethod
    def is_utf32(name: str) -> bool:
        return name.startswith("UTF-32")


@dataclass(frozen=True)
class CharsetConverter:
    """Transcodes documents or cells. Spark's strings are UTF-8, so a cell in another encoding is binary."""

    input: str = "UTF-8"
    output: str = "UTF-8"

    def __post_init__(self):
        import codecs

        for name in (self.input, self.output):
            try:
                codecs.lookup(name)
            except LookupError as e:
                raise InvalidArgument(f"unknown encoding {name}") from e

    def input_encoding(self, name: str) -> CharsetConverter:
        return CharsetConverter(name, self.output)

    def output_encoding(self, name: str) -> CharsetConverter:
        return CharsetConverter(self.input, name)

    def convert_bytes(self, data: bytes) -> bytes:
        return data if self.input.upper() == self.output.upper() else data.decode(self.input).encode(self.output)

    def cell(self, c: Column) -> Column:
        """A binary cell of the input encoding as text, or as binary of the output encoding."""
        text = F.decode(c, self.input)
        return text if self.output.upper() == "UTF-8" else F.encode(text, self.output)

    def __call__(self, record):
        one = lambda v: self.convert_bytes(v) if isinstance(v, bytes) else v
        return {one(k): one(v) for k, v in record.items()} if isinstance(record, dict) else [one(v) for v in record]

    def convert(self, records):
        """Records one by one; see __call__."""
        return (self(r) for r in records)

    def _filter(self) -> str:
        from sparktab.sources.csv import is_registered, register_filter

        name = f"convert.{self.input}/{self.output}".lower()
        if not is_registered(name):
            register_filter(name, lambda data, _, one=self.convert_bytes: one(data))
        return name

    def append_to(self, csv):
        """A reader whose bytes, or a writer whose lines, are converted behind other filters."""
        return csv.append_filter(self._filter())

    def prepend_to(self, csv):
        return csv.prepend_filter(self._filter())

    add_to = append_to

    @staticmethod
    def add_bom_skipping_to(reader):
        """A reader that takes the encoding of the document's byte-order mark and leaves the mark out."""
        return reader.skip_input_bom().set_encoding("UTF-8")
