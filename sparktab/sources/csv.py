"""CSV documents: dialect, byte-order marks, filters, a fast and an exact reader, and a byte-exact writer."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktab.errors import CannotInsertRecord, InvalidArgument, SyntaxProblem, UnavailableFeature, UnavailableStream
from sparktab.functions.text import BOMS, Bom
from sparktab.shared import materialize
from sparktab.table import FIELDS, OFFSET, Table, check_header


@dataclass(frozen=True)
class Dialect:
    """escape '' follows RFC 4180; a backslash suppresses the end of a quoted field and stays in the value."""

    delimiter: str = ","
    enclosure: str = '"'
    escape: str = "\\"
    eol: str = "\n"
    encoding: str = "UTF-8"
    header_offset: int | None = None
    skip_empty: bool = True
    keep_bom: bool = False
    filters: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.delimiter:
            raise InvalidArgument("the delimiter must not be empty")
        if len(self.enclosure.encode()) != 1:
            raise InvalidArgument("the enclosure must be a single byte")
        if len(self.escape.encode()) > 1:
            raise InvalidArgument("the escape must be empty or a single byte")
        if self.header_offset is not None and self.header_offset < 0:
            raise InvalidArgument("the header offset must not be negative")


#: Named byte filters: (bytes, params) -> bytes. They are shipped to executors by value.
_FILTERS: dict[str, Callable] = {}


def register_filter(name: str, f: Callable) -> None:
    if not name or name in _FILTERS:
        raise InvalidArgument(f"the filter name {name!r} is empty or taken")
    _FILTERS[name] = f


def unregister_filter(name: str) -> bool:
    return _FILTERS.pop(name, None) is not None


def registered_filters() -> list[str]:
    return list(_FILTERS)


def is_registered(name: str) -> bool:
    return name in _FILTERS


def filter_callback(name: str) -> Callable:
    if name not in _FILTERS:
        raise InvalidArgument(f"unknown filter {name!r}")
    return _FILTERS[name]


def parse_records(text: str, dialect: Dialect) -> Iterator[list[str | None]]:
    """Raw records with offsets by position; a blank line is [None]."""
    sep, quote, esc = dialect.delimiter, dialect.enclosure, dialect.escape
    esc = "" if esc == quote else esc
    n, at = len(text), 0
    while at < n:
        record: list[str | None] = []
        blank = text[at] in "\r\n"
        while True:
            lead = at
            while lead < n and text[lead] in " \t" and not text.startswith(sep, lead):
                lead += 1
            value = ""
            if lead < n and text[lead] == quote:
                at, parts, begin = lead + 1, [], lead + 1
                while at < n:
                    c = text[at]
                    if esc and c == esc and at + 1 < n:
                        at += 2
                    elif c == quote:
                        if text.startswith(quote, at + 1):
                            parts.append(text[begin : at + 1])
                            at += 2
                            begin = at
                        else:
                            break
                    else:
                        at += 1
                value = "".join(parts) + text[begin : min(at, n)]
                at = min(at + 1, n)
            begin = at
            while at < n and text[at] not in "\r\n" and not text.startswith(sep, at):
                at += 1
            record.append(value + text[begin:at])
            if at < n and text.startswith(sep, at):
                at += len(sep)
                continue
            break
        yield [None] if blank else record
        if at < n:
            at += 2 if text.startswith("\r\n", at) else 1


def _single(c: str) -> str:
    if len(c.encode()) != 1:
        raise InvalidArgument("the delimiter must be a single byte")
    return c


class LineScanner:
    """Finds the ends of records in lines that are read one by one, with whether a quoted field is open between them."""

    def __init__(self, dialect: Dialect):
        d = dialect
        self.sep, self.quote, self.esc = d.delimiter, d.enclosure, "" if d.escape == d.enclosure else d.escape
        self.stop = re.compile("[\r\n]|" + re.escape(d.delimiter))
        self.mark = re.compile("[" + re.escape(self.quote + self.esc) + "]")
        self.simple = lambda line: self.quote not in line and "\r" not in line

    def _close(self, text: str, at: int) -> int:
        """The place after the enclosure that ends the open field, or -1."""
        while (m := self.mark.search(text, at)) is not None:
            at = m.start()
            if self.esc and text[at] == self.esc:
                at += 2
            elif text.startswith(self.quote, at + 1):
                at += 2
            else:
                return at + 1
        return -1

    def ends(self, line: str, open_: bool) -> tuple[list[int], bool]:
        """Places in line (with its line feed) after the records that end in it, and whether a field stays open."""
        if not open_ and self.simple(line):
            return [len(line)], False
        out, at, n = [], 0, len(line)
        while at < n:
            if not open_:
                lead = at
                while lead < n and line[lead] in " \t" and not line.startswith(self.sep, lead):
                    lead += 1
                open_ = lead < n and line[lead] == self.quote
                at = lead + 1 if open_ else at
            if open_:
                at = self._close(line, at)
                if at < 0:
                    return out, True
                open_ = False
            m = self.stop.search(line, at)
            at = n if m is None else m.end()
            if m is None or m.group() in "\r\n":
                if m is not None and m.group() == "\r" and line.startswith("\n", at):
                    at += 1
                out.append(at)
        return out, False


def decode_document(data: bytes, dialect: Dialect, filters: list[tuple[Callable, object]] = ()) -> str:
    """Bytes after filters, without the byte-order mark (unless kept), as text."""
    mark = Bom.try_from_sequence(data)
    encoding = dialect.encoding
    if mark and not dialect.keep_bom:
        data = data[len(BOMS[mark]) :]
        encoding = mark if encoding.upper() == "UTF-8" else encoding
    for f, params in filters:
        data = f(data, params)
    return data.decode(encoding, "replace")


def format_cell(value: object) -> str:
    """The text of a value as the writer casts it."""
    if value is None or value is False:
        return ""
    if value is True:
        return "1"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return str(value)


@lru_cache
def _risky(dialect: Dialect) -> re.Pattern:
    return re.compile("[ \t\r\n" + re.escape(dialect.enclosure + dialect.escape) + "]|" + re.escape(dialect.delimiter))


@lru_cache
def _bare(dialect: Dialect) -> re.Pattern:
    """Enclosures that are doubled: all but those behind an escape."""
    q = re.escape(dialect.enclosure)
    return re.compile(f"(?<!{re.escape(dialect.escape)}){q}" if dialect.escape and dialect.escape != dialect.enclosure else q)


def format_line(record: Iterable, dialect: Dialect, policy: str = "necessary") -> str:
    q, out = dialect.enclosure, []
    risky, bare = _risky(dialect).search, _bare(dialect)
    for value in record:
        text = value if type(value) is str else format_cell(value)
        if policy == "none" or policy == "necessary" and not risky(text):
            out.append(text)
        else:
            out.append(q + (bare.sub(q + q, text) if q in text else text) + q)
    return dialect.delimiter.join(out) + dialect.eol


def _lines(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """(file, block, line) of all lines of the documents, split at line feeds; more: further columns."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.format("text").option("lineSep", "\n").load(path).select(*place, F.col("value").cast("binary").alias("line"), *more)


def _plain_path(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


def _record_batches(records: Iterable[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
    offsets, fields = [], []
    for offset, record in records:
        offsets.append(offset)
        fields.append(record)
        if len(offsets) == 10_000:
            yield pa.record_batch([pa.array(offsets, pa.int64()), pa.array(fields, pa.list_(pa.string()))], names=[OFFSET, FIELDS])
            offsets, fields = [], []
    if offsets:
        yield pa.record_batch([pa.array(offsets, pa.int64()), pa.array(fields, pa.list_(pa.string()))], names=[OFFSET, FIELDS])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, pa.Array]]:
    """(file, block, whether it goes on, lines) of consecutive lines of one block; columns file, block, line."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(1).to_numpy()
        names = batch.column(0).dictionary_encode().indices.to_numpy()
        cuts = [0, *((block[1:] != block[:-1]) | (names[1:] != names[:-1])).nonzero()[0] + 1, batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = batch.column(0)[a].as_py(), int(block[a])
            yield (*key, key == last, batch.column(2).slice(a, b - a))
            last = key


def _plain(lines: pa.Array, dialect: Dialect) -> bool:
    """Whether no line holds an enclosure or a return, so that each one is a record."""
    return not any(pc.any(pc.match_substring(lines, c)).as_py() for c in (dialect.enclosure, "\r"))


def split_records(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame | None:
    """(offset, fields) of the UTF-8 documents at path, read block by block; None if one begins with the mark of another encoding.

    Whether a block begins within a quoted field depends on all blocks before it. So a first pass
    finds, for either beginning, how many records of the block end, and whether a field is open
    behind it; a few numbers for each block are put together on the driver. In the second pass
    each block parses its own records; those that lie across blocks are parsed from their parts.
    A field that is still open at the end of a document loses the document's last line feed.
    """
    lines = _lines(spark, path)
    scanner = LineScanner(dialect)

    def text_of(line: bytes, first: bool) -> str:
        return (line.removeprefix(BOMS["UTF-8"]) if first else line).decode("utf-8", "replace")

    def survey(batches):
        now = None

        def row(x):
            # for a block that begins outside of a field, then for one that begins inside
            found = [pa.array([x[k][i]], kind) for i in (0, 1) for k, kind in _FOUND.items()]
            return pa.record_batch([pa.array([x["file"]]), pa.array([x["block"]]), pa.array([x["mark"]], pa.string()), *found], names=_SURVEY)

        for file, block, goes_on, some in _blocks(batches):
            if not goes_on:
                if now is not None:
                    yield row(_finished(now))
                first = some[0].as_py()
                now = {"file": file, "block": block, "mark": Bom.try_from_sequence(first) if block == 0 else None, "n": [0, 0], "open": [False, True], "head": ["", ""], "tail": [[], []], "ended": [True, False], "headed": [[], []]}
            if _plain(some, dialect) and not now["open"][0] and not now["open"][1]:
                now["n"] = [n + len(some) for n in now["n"]]
                continue
            for i, line in enumerate(some.to_pylist()):
                text = text_of(line, block == 0 and i == 0 and not goes_on) + "\n"
                same = now["open"][0] == now["open"][1]
                for k in (0, 1):
                    if k == 1 and same:
                        cuts, open_ = done
                    else:
                        cuts, open_ = done = scanner.ends(text, now["open"][k])
                    if not now["ended"][k]:
                        now["headed"][k].append(text[: cuts[0]] if cuts else text)
                        now["ended"][k] = bool(cuts)
                    now["n"][k] += len(cuts)
                    if cuts:
                        now["tail"][k] = []
                    if open_:
                        now["tail"][k].append(text[cuts[-1] if cuts else 0 :])
                    now["open"][k] = open_
        if now is not None:
            yield row(_finished(now))

    fields = ", ".join(f"{n} {'string' if n in ('file', 'mark') or n[:4] in ('head', 'tail') else 'boolean' if n[:4] == 'open' else 'long'}" for n in _SURVEY)
    surveyed = materialize(lines.mapInArrow(survey, fields), "blocks")
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    before, file = (False, 0), None
    for r in surveyed.select("file", "block", "mark", "n0", "open0", "n1", "open1").orderBy("file", "block").collect():  # one row for each block of a file
        if r["mark"] not in (None, "UTF-8"):
            return None
        before, file = (before, file) if r["file"] == file else ((False, 0), r["file"])
        begins[r["file"], r["block"]] = before
        before = (r["open1"], before[1] + r["n1"]) if before[0] else (r["open0"], before[1] + r["n0"])
    shared = spark.sparkContext.broadcast(begins)

    def parse(batches):
        open_, offset, held = False, 0, []
        for file, block, goes_on, some in _blocks(batches):
            if not goes_on:
                open_, offset = shared.value[file, block]
                held, skip = [], open_
            if not open_ and not held and _plain(some, dialect) and not (block == 0 and not goes_on):
                yield _split_lines(some, offset, dialect)
                offset += len(some)
                continue
            out = []
            for i, line in enumerate(some.to_pylist()):
                text = text_of(line, block == 0 and i == 0 and not goes_on) + "\n"
                cuts, open_ = scanner.ends(text, open_)
                at = 0
                for cut in cuts:
                    if not skip:  # else the record began in an earlier block
                        out.append((offset, parse_one("".join([*held, text[at:cut]]), dialect)))
                    held, skip, at = [], False, cut
                    offset += 1
                if open_ and not skip:
                    held.append(text[at:])
            yield from _record_batches(out)

    whole = lines.mapInArrow(parse, f"{OFFSET} long, {FIELDS} array<string>")
    table = spark.createDataFrame([(f, b, o, n) for (f, b), (o, n) in begins.items()] or [("", -1, False, 0)], "file string, block long, began boolean, base long")
    parts = surveyed.join(F.broadcast(table), ["file", "block"])
    head = F.when(F.col("began"), F.struct(F.col("base").alias("record"), F.col("head1").alias("text")))

    def tail_of(k: int) -> Column:
        # a block that lies within a field as a whole is all head
        begins_here = F.col(f"open{k}") & (F.lit(k == 0) | (F.col(f"n{k}") > 0))
        return F.when(begins_here, F.struct((F.col("base") + F.col(f"n{k}")).alias("record"), F.col(f"tail{k}").alias("text")))

    tail = F.when(F.col("began"), tail_of(1)).otherwise(tail_of(0))
    pieces = parts.select("file", "block", F.explode(F.array(head, tail)).alias("x")).where("x is not null")
    joined = pieces.groupBy("file", "x.record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "x.text"))), lambda x: x["text"]), "").alias("text"))

    def parse_parts(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield from _record_batches([(record, parse_one(text, dialect)) for record, text in rows])

    return whole.unionByName(joined.select("record", "text").mapInArrow(parse_parts, f"{OFFSET} long, {FIELDS} array<string>"))


_FOUND = {"n": pa.int64(), "open": pa.bool_(), "head": pa.string(), "tail": pa.string()}
_SURVEY = ["file", "block", "mark", *[f"{k}{i}" for i in (0, 1) for k in _FOUND]]


def _finished(now: dict) -> dict:
    return now | {"head": ["".join(x) for x in now["headed"]], "tail": ["".join(x) for x in now["tail"]]}


def parse_one(text: str, dialect: Dialect) -> list[str | None]:
    """The record of a text that ends with it; its line feed may be one that the document does not have."""
    if text in ("\n", "\r\n", "\r"):
        return [None]
    return next(parse_records(text.removesuffix("\n"), dialect))


def _split_lines(lines: pa.Array, offset: int, dialect: Dialect) -> pa.RecordBatch:
    """Records of lines without enclosures and returns."""
    try:
        text = lines.cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([x.decode("utf-8", "replace") for x in lines.to_pylist()], pa.string())
    cells = pc.split_pattern(text, dialect.delimiter)
    if pc.any(pc.equal(text, "")).as_py():
        cells = pa.array([[None] if t == "" else c for t, c in zip(text.to_pylist(), cells.to_pylist(), strict=True)], pa.list_(pa.string()))
    return pa.record_batch([pa.array(range(offset, offset + len(lines)), pa.int64()), cells.cast(pa.list_(pa.string()))], names=[OFFSET, FIELDS])


@dataclass(frozen=True)
class Reader:
    """A CSV document at a path that Spark can read, or a text. Immutable; every setter gives a new reader."""

    spark: SparkSession
    path: str | None = None
    content: bytes | None = None
    dialect: Dialect = field(default_factory=Dialect)
    read_filters: tuple[tuple[str, object], ...] = ()
    formatters: tuple[Callable, ...] = ()
    exact: bool = True
    single_line: bool = False

    @classmethod
    def from_path(cls, spark: SparkSession, path: str | os.PathLike, mode: str = "r") -> Reader:
        if not mode.startswith("r"):
            raise UnavailableStream(f"the mode {mode!r} does not read")
        return cls(spark, str(path))

    @classmethod
    def from_string(cls, spark: SparkSession, text: str | bytes) -> Reader:
        return cls(spark, None, text.encode() if isinstance(text, str) else text)

    @classmethod
    def from_stream(cls, spark: SparkSession, stream) -> Reader:
        if not hasattr(stream, "read"):
            raise TypeError("a stream with read() is needed")
        return cls.from_string(spark, stream.read())

    @classmethod
    def of(cls, spark: SparkSession, source) -> Reader:
        return cls.from_stream(spark, source) if hasattr(source, "read") else cls.from_path(spark, source)

    def _set(self, **more) -> Reader:
        return replace(self, dialect=replace(self.dialect, **more))

    def set_delimiter(self, c: str) -> Reader:
        """A single byte; a dialect takes a delimiter of several characters as well."""
        return self._set(delimiter=_single(c))

    def set_enclosure(self, c: str) -> Reader:
        return self._set(enclosure=c)

    def set_escape(self, c: str) -> Reader:
        return self._set(escape=c)

    def set_header_offset(self, n: int | None) -> Reader:
        return self._set(header_offset=n)

    def set_encoding(self, name: str) -> Reader:
        return self._set(encoding=name)

    def skip_empty_records(self) -> Reader:
        return self._set(skip_empty=True)

    def include_empty_records(self) -> Reader:
        return self._set(skip_empty=False)

    def skip_input_bom(self) -> Reader:
        return self._set(keep_bom=False)

    def include_input_bom(self) -> Reader:
        return self._set(keep_bom=True)

    def add_formatter(self, f: Callable[[DataFrame], DataFrame]) -> Reader:
        return replace(self, formatters=(*self.formatters, f))

    def append_filter(self, name: str, params: object = None) -> Reader:
        if name not in _FILTERS:
            raise InvalidArgument(f"unknown filter {name!r}")
        return replace(self, read_filters=(*self.read_filters, (name, params)))

    def prepend_filter(self, name: str, params: object = None) -> Reader:
        if name not in _FILTERS:
            raise InvalidArgument(f"unknown filter {name!r}")
        return replace(self, read_filters=((name, params), *self.read_filters))

    def remove_filter(self, name: str) -> Reader:
        return replace(self, read_filters=tuple(f for f in self.read_filters if f[0] != name))

    def has_filter(self, name: str) -> bool:
        return any(f[0] == name for f in self.read_filters)

    def supports_read_filters(self) -> bool:
        return True

    def supports_write_filters(self) -> bool:
        return False

    def fast(self, single_line: bool = False) -> Reader:
        """Spark's own reader, for RFC 4180 documents with a header at 0 or none: empty fields become null.

        It splits a file only if no field may hold a line feed (`single_line`); else each document is one task.
        """
        return replace(self, exact=False, single_line=single_line)

    def _bytes(self) -> DataFrame:
        if self.content is not None:
            return self.spark.createDataFrame([(bytearray(self.content),)], "content binary")
        return self.spark.read.format("binaryFile").load(self.path).select("content")

    def input_bom(self) -> str | None:
        row = self._bytes().select(F.substring("content", 1, 4).alias("c")).first()
        return Bom.try_from_sequence(bytes(row["c"])) if row else None

    def raw_records(self) -> DataFrame:
        """(offset, fields) of all records, blank lines included, before the header is taken.

        A path is read in parallel, in pieces of any size, if its bytes are UTF-8 without filters;
        any other document is one task.
        """
        if self.path is not None and not self.read_filters and not self.dialect.keep_bom and self.dialect.encoding.upper() in ("UTF-8", "UTF8"):
            found = split_records(self.spark, self.path, self.dialect)
            if found is not None:
                return found
        dialect, filters = self.dialect, [(_FILTERS[n], p) for n, p in self.read_filters]

        def task(batches):
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    yield from _record_batches(enumerate(parse_records(decode_document(data, dialect, filters), dialect)))

        return self._bytes().mapInArrow(task, f"{OFFSET} long, {FIELDS} array<string>")

    def header(self, raw: DataFrame | None = None) -> list[str]:
        """The names at the header's offset; raw: the raw records, if they are known."""
        k = self.dialect.header_offset
        if k is None:
            return []
        rows = (self.raw_records() if raw is None else raw).where(F.col(OFFSET) == k).limit(1).collect()
        if not rows or rows[0][FIELDS] in ([None], []):
            raise SyntaxProblem(f"the header record at offset {k} is missing or empty")
        return check_header([x if x is not None else "" for x in rows[0][FIELDS]])

    def to_table(self, header: list[str] | dict[int, str] | None = None) -> Table:
        """Short records are padded with null and long ones cut if there is a header; else they stay ragged."""
        if not self.exact:
            return self._fast(header)
        raw = self.raw_records()
        own = self.header(raw)
        if self.dialect.skip_empty:
            raw = raw.where(~((F.size(FIELDS) == 1) & F.col(FIELDS)[0].isNull()))
        else:
            raw = raw.withColumn(FIELDS, F.when((F.size(FIELDS) == 1) & F.col(FIELDS)[0].isNull(), F.array().cast("array<string>")).otherwise(F.col(FIELDS)))
        if self.dialect.header_offset is not None:
            raw = raw.where(F.col(OFFSET) != self.dialect.header_offset)
        table = Table(raw, headerless=True)
        if header or own:
            table = table.map_header(header or own)
        for f in self.formatters:
            table = table.transform(f)
        return table

    def _fast(self, header) -> Table:
        d = self.dialect
        if d.escape not in ("", d.enclosure) or d.header_offset not in (None, 0) or not d.skip_empty or self.read_filters or self.path is None:
            raise UnavailableFeature("the fast reader takes paths, RFC 4180, a header at 0 or none, no blank records and no filters")
        options = {"sep": d.delimiter, "quote": d.enclosure, "escape": d.enclosure, "multiLine": str(not self.single_line).lower(), "encoding": d.encoding, "header": str(d.header_offset == 0).lower()}
        df = self.spark.read.options(**options).csv(self.path)
        table = Table(df, check_header(df.columns), start=int(d.header_offset == 0))
        if header:
            table = table.map_header(header)
        for f in self.formatters:
            table = table.transform(f)
        return table

    def records(self, header=None) -> Iterator:
        return self.to_table(header).records()

    def last_record(self):
        return self.to_table().last()

    def count(self) -> int:
        return self.to_table().count()

    def _stream(self) -> Iterator[bytes]:
        """The bytes of the documents in order, line by line; a path is not held on the driver."""
        if self.content is not None:
            yield self.content
            return
        sizes = {r["path"]: r["length"] for r in self.spark.read.format("binaryFile").load(self.path).select("path", "length").collect()}
        lines = _lines(self.spark, self.path, F.monotonically_increasing_id().alias("at"))
        left = {_plain_path(k): n for k, n in sizes.items()}
        for r in lines.orderBy("file", "block", "at").toLocalIterator():
            # only the last line may have no line feed, which the length tells
            line = bytes(r["line"]) + b"\n"
            line = line[: left[_plain_path(r["file"])]]
            left[_plain_path(r["file"])] -= len(line)
            yield line

    def text(self) -> str:
        """The whole document, which must fit into the driver's memory; `chunk` streams it."""
        return b"".join(self._stream()).decode(self.dialect.encoding, "replace")

    def chunk(self, length: int) -> Iterator[bytes]:
        if length < 1:
            raise InvalidArgument("a chunk has one byte or more")

        def cut():
            held = bytearray()
            for piece in self._stream():
                held += piece
                while len(held) >= length:
                    yield bytes(held[:length])
                    del held[:length]
            if held:
                yield bytes(held)

        return cut()

    def seek(self, n: int) -> list | None:
        if n < 0:
            raise InvalidArgument("the record offset must not be negative")
        rows = self.raw_records().where(F.col(OFFSET) == n).limit(1).collect()
        return list(rows[0][FIELDS]) if rows else None


def cell_expression(c: Column, kind: T.DataType, dialect: Dialect, policy: str = "necessary") -> Column:
    """The text of a cell in a line, as an expression."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, F.lit("1")).otherwise(F.lit(""))
    elif isinstance(kind, T.FractionalType):
        text = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    text = F.coalesce(text, F.lit(""))
    q = dialect.enclosure
    bare = F.regexp_replace(text, F.lit(f"(?<!\\Q{dialect.escape}\\E)\\Q{q}\\E"), F.lit(q + q)) if dialect.escape and dialect.escape != q else F.replace(text, F.lit(q), F.lit(q + q))
    quoted = F.concat(F.lit(q), bare, F.lit(q))
    if policy == "all":
        return quoted
    if policy == "none":
        return text
    risky = text.rlike("[ \\t\\r\\n\\Q" + q + dialect.escape + "\\E]") | text.contains(dialect.delimiter)
    return F.when(risky, quoted).otherwise(text)


def write_csv(table: Table, path: str, dialect: Dialect | None = None, policy: str = "necessary", header: bool = False, single: bool = False, bom: str | None = None, filters: tuple[tuple[str, object], ...] = (), validators: dict[str, Callable] | None = None, formatters: tuple[Callable, ...] = ()) -> None:
    """Byte-exact lines by one expression and the text sink, one file for each partition; `single` gives one ordered file.

    header and bom begin each file. formatters: DataFrame -> DataFrame. validators: table -> boolean
    expression; a record that fails one stops the job. filters: registered ones, applied to the bytes of
    each line without its end. The end of line may be any text; lines are encoded as the dialect says.
    """
    d = dialect or Dialect(escape="")
    for f in formatters:
        table = table.transform(f)
    table = table._in_order() if single else table
    kinds = {f.name: f.dataType for f in table.df.schema.fields}
    cells = [cell_expression(F.col(f"`{c}`"), kinds[c], d, policy) for c in table.columns]
    line = F.concat_ws(d.delimiter, *cells)
    for name, build in (validators or {}).items():
        failed = F.concat(F.lit(f"the record was rejected by `{name}`: "), F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
        line = F.when(F.coalesce(build(table), F.lit(False)), line).otherwise(F.raise_error(failed))
    df = table.df.select(line.alias("value"))
    df = df.coalesce(1) if single else df
    encoding, run = d.encoding, [(_FILTERS[n], p) for n, p in filters]
    first = [format_line(table.columns, replace(d, eol=""), policy)] if header else []
    if first or bom or run or encoding.upper() not in ("UTF-8", "UTF8"):
        mark, end = BOMS[Bom.from_encoding(bom)] if bom else b"", d.eol.encode(encoding)

        def dressed(texts: list[str]) -> list[bytes]:
            out = [x.encode(encoding) for x in texts]
            for f, params in run:
                out = [f(x, params) for x in out]
            return out

        def task(batches):
            lead = mark + b"".join(x + end for x in dressed(first))
            for batch in batches:
                out = dressed(batch.column(0).to_pylist())
                if out:
                    out[0], lead = lead + out[0], b""
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

        if single and (first or bom) and table.is_empty():
            lead = bytearray((mark + b"".join(x + end for x in dressed(first))).removesuffix(end))
            df = df.sparkSession.createDataFrame([(lead,)], "value binary").select(F.col("value").cast("string").alias("value"))
        else:
            df = df.mapInArrow(task, "value binary").select(F.col("value").cast("string").alias("value"))  # the bytes as they are
    df.write.option("lineSep", _bytes_text(d.eol.encode(encoding))).text(path)


def _bytes_text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        raise UnavailableFeature("distributed files have ends of line that are also UTF-8") from e


class Writer:
    """Appends records to a document in driver memory; `write_csv` is the distributed sink."""

    def __init__(self, dialect: Dialect | None = None):
        self.dialect, self.policy, self.parts = dialect or Dialect(), "necessary", []
        self.bom: bytes = b""
        self.validators: dict[str, Callable] = {}
        self.formatters: list[Callable] = []
        self.filters: list[tuple[str, object]] = []

    def necessary_enclosure(self) -> Writer:
        self.policy = "necessary"
        return self

    def force_enclosure(self) -> Writer:
        self.policy = "all"
        return self

    def no_enclosure(self) -> Writer:
        self.policy = "none"
        return self

    def set_end_of_line(self, eol: str) -> Writer:
        self.dialect = replace(self.dialect, eol=eol)
        return self

    def set_flush_threshold(self, n: int | None) -> Writer:
        if n is not None and n < 1:
            raise InvalidArgument("the flush threshold must be 1 or more")
        return self

    def set_output_bom(self, name: str | None) -> Writer:
        self.bom = BOMS[Bom.from_encoding(name)] if name else b""
        return self

    def add_validator(self, f: Callable, name: str) -> Writer:
        self.validators[name] = f
        return self

    def add_formatter(self, f: Callable) -> Writer:
        self.formatters.append(f)
        return self

    def append_filter(self, name: str, params: object = None) -> Writer:
        self.filters.append((name, params))
        return self

    def prepend_filter(self, name: str, params: object = None) -> Writer:
        self.filters.insert(0, (name, params))
        return self

    def remove_filter(self, name: str) -> Writer:
        self.filters = [f for f in self.filters if f[0] != name]
        return self

    def has_filter(self, name: str) -> bool:
        return any(f[0] == name for f in self.filters)

    def supports_read_filters(self) -> bool:
        return False

    def supports_write_filters(self) -> bool:
        return True

    def set_delimiter(self, c: str) -> Writer:
        self.dialect = replace(self.dialect, delimiter=_single(c))
        return self

    def set_enclosure(self, c: str) -> Writer:
        self.dialect = replace(self.dialect, enclosure=c)
        return self

    def set_escape(self, c: str) -> Writer:
        self.dialect = replace(self.dialect, escape=c)
        return self

    def set_encoding(self, name: str) -> Writer:
        self.dialect = replace(self.dialect, encoding=name)
        return self

    def insert_one(self, record) -> int:
        for f in self.formatters:
            record = f(record)
        for name, f in self.validators.items():
            if not f(record):
                raise CannotInsertRecord(name, record)
        data = format_line(record.values() if isinstance(record, dict) else record, self.dialect, self.policy).encode(self.dialect.encoding)
        for name, params in self.filters:
            data = _FILTERS[name](data, params)
        self.parts.append(data)
        return len(data)

    def insert_all(self, records) -> int:
        source = records.to_table().records() if hasattr(records, "to_table") else records.records() if isinstance(records, Table) else records
        return sum(self.insert_one(r) for r in source)

    def to_bytes(self) -> bytes:
        return self.bom + b"".join(self.parts)

    def to_string(self) -> str:
        return self.to_bytes().decode(self.dialect.encoding, "replace")

    def download(self, filename: str) -> tuple[dict[str, str], bytes]:
        return download_headers(filename), self.to_bytes()


class SwapDelimiter:
    """A document with a delimiter of several characters, by replacing it, within quotes too."""

    @staticmethod
    def add_to(csv: Reader | Writer, delimiter: str) -> Reader | Writer:
        """A reader or writer whose document has `delimiter` where its own dialect has the delimiter of one byte."""
        own = csv.dialect.delimiter
        if len(own.encode()) != 1 or len(delimiter.encode()) < 2 or own in delimiter:
            raise InvalidArgument("a delimiter of several bytes takes the place of one of one byte")
        reads = isinstance(csv, Reader)
        name = f"swap.{'read' if reads else 'write'}.{own}.{delimiter}"
        a, b = (delimiter.encode(), own.encode()) if reads else (own.encode(), delimiter.encode())
        if name not in _FILTERS:
            register_filter(name, lambda data, _: data.replace(a, b))
        return csv.append_filter(name)


def rfc4180_field(csv: Reader | Writer) -> Reader | Writer:
    """Rewrites an escaped enclosure as a doubled one; deprecated, an empty escape does it better."""
    e, q = csv.dialect.escape, csv.dialect.enclosure
    if not e:
        return csv
    name = f"rfc4180.{e}{q}"
    if name not in _FILTERS:
        register_filter(name, lambda data, _, a=(e + q).encode(), b=(q + q).encode(): data.replace(a, b))
    return csv.append_filter(name)


def enclose_field(writer: Writer, sequence: str = "\t\x1f") -> Writer:
    """Encloses every cell; deprecated, force_enclosure does it. The sequence must hold a character that needs an enclosure."""
    if not any(c in sequence for c in "\t\x1f \r\n"):
        raise InvalidArgument("the sequence does not force an enclosure")
    return writer.force_enclosure()


def download_headers(filename: str, kind: str = "text/csv") -> dict[str, str]:
    """HTTP headers of a file download; a name that is not ASCII goes into filename*."""
    from urllib.parse import quote

    if not filename or any(c in filename for c in "/\\\0"):
        raise InvalidArgument("the file name must not hold a path")
    plain = filename.encode("ascii", "replace").decode().replace("?", "_").replace('"', "")
    value = f'attachment; filename="{plain}"'
    if plain != filename:
        value += f"; filename*=UTF-8''{quote(filename)}"
    return {"Content-Type": kind, "Content-Transfer-Encoding": "binary", "Content-Description": "File Transfer", "Content-Disposition": value}
