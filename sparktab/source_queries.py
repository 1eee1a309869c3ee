"""Queries for documents, writers, converters, schemas, mapping and closures, with their SQL.

They run over whole tables like those of `sparktab.queries`. Documents are written to the shared
folder, or are texts made of a small table where the operator works on a text.
"""

from __future__ import annotations

import dataclasses
import datetime
import enum
import io
import json
import sqlite3

from pyspark.sql import functions as F

from sparktab.errors import CannotInsertRecord, InvalidArgument, TypeCastingFailed
from sparktab.functions.text import BOMS, Bom, CharsetConverter, EnumFormatter, EscapeFormula
from sparktab.operators import inference as I  # noqa: E741, N812
from sparktab.operators import mapping
from sparktab.operators.buffer import Buffer
from sparktab.operators.checks import ColumnConsistency
from sparktab.plans.order import CompareOn, SortOn
from sparktab.plans.predicate import Col, Cols, Offset, Where
from sparktab.plans.statement import Statement
from sparktab.queries import _ORD, _where, query
from sparktab.shared import shared_dir
from sparktab.sources import csv, rdbms
from sparktab.sources.convert import HtmlConverter, JsonConverter, XmlConverter
from sparktab.sources.csv import Dialect, Reader, SwapDelimiter, Writer, enclose_field, rfc4180_field, write_csv
from sparktab.table import FIELDS, OFFSET, Table

_S = Statement()
_LINE = "l_orderkey, l_extendedprice, l_linenumber, l_quantity"
_NATION = "select n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey from nation"


def _rows(t, rows, schema: str):
    return t("nation").df.sparkSession.createDataFrame(rows, schema)


def _nation(t) -> Table:
    return t("nation").select("n_nationkey", "n_name", "n_regionkey")


def _text(t, dialect: Dialect | None = None, header: bool = True, name: str = "nation") -> str:
    """A small table as a CSV document."""
    writer, table = Writer(dialect or Dialect(escape="")), _nation(t) if name == "nation" else t(name)
    if header:
        writer.insert_one(table.columns)
    writer.insert_all(table)
    return writer.to_string()


def _reader(t, text: str | bytes, header: int | None = 0) -> Reader:
    return Reader.from_string(t("nation").df.sparkSession, text).set_escape("").set_header_offset(header)


def _filter(name: str, f) -> str:
    if not csv.is_registered(name):
        csv.register_filter(name, f)
    return name


# documents


@query("q_read_dialect", "select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer")
def _dialect(t):
    table = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    path, d = shared_dir(table.df.sparkSession), Dialect(delimiter=";", enclosure="'", escape="")
    write_csv(table, path, d, "all")
    return Reader.from_path(table.df.sparkSession, path).set_delimiter(";").set_enclosure("'").set_escape("").to_table(table.columns).df.drop(OFFSET)


@query("q_read_offsets", "select o_orderkey::varchar as o_orderkey, o_orderpriority, row_number() over (order by o_orderkey) as at from orders")
def _read_offsets(t):
    table = t("orders").select("o_orderkey", "o_orderpriority")
    path = shared_dir(table.df.sparkSession)
    write_csv(Table(table.df.orderBy("o_orderkey")), path, Dialect(escape=""), header=True, single=True)
    return Reader.from_path(table.df.sparkSession, path).set_escape("").set_header_offset(0).to_table().df.withColumnRenamed(OFFSET, "at")


@query("q_read_stream", "select r_regionkey::varchar as r_regionkey, r_name from region")
def _stream(t):
    text = _text(t, name="region")
    return Reader.from_stream(t("nation").df.sparkSession, io.BytesIO(text.encode())).set_header_offset(0).to_table().df.drop(OFFSET)


@query("q_header_offset", "select 'before' as n_nationkey, 'the header' as n_name, null::varchar as n_regionkey union all " + _NATION)
def _header_offset(t):
    return _reader(t, "before,the header\n" + _text(t), 1).to_table().df.drop(OFFSET)


@query("q_blank_records", "select (select count(*) from nation)::bigint as skipped, (select 2 * count(*) from nation)::bigint as kept")
def _blank(t):
    r = _reader(t, _text(t, header=False).replace("\n", "\n\n"), None)
    return _rows(t, [(r.skip_empty_records().count(), r.include_empty_records().count())], "skipped long, kept long")


@query("q_raw_records", "select row_number() over (order by n_nationkey) as at, 3::integer as fields, n_name from nation union all select 0, 3, 'n_name'")
def _raw(t):
    return _reader(t, _text(t)).raw_records().select(F.col(OFFSET).alias("at"), F.size(FIELDS).alias("fields"), F.col(FIELDS)[1].alias("n_name"))


@query("q_seek", "select n_nationkey::bigint as at, n_name from nation")
def _seek(t):
    r = _reader(t, _text(t, header=False), None)
    return _rows(t, [(i, r.seek(i)[1]) for i in range(t("nation").count())], "at long, n_name string")


@query("q_text_chunks", "select length(d)::bigint as size, ceil(length(d) / 100)::bigint as chunks, md5(d) as digest from (select string_agg(n_nationkey || ',' || case when contains(n_name, ' ') then '\"' || n_name || '\"' else n_name end || ',' || n_regionkey || chr(10), '' order by n_nationkey) as d from nation)")
def _chunks(t):
    r = _reader(t, _text(t, header=False), None)
    parts = list(r.chunk(100))
    rows = [(sum(map(len, parts)), len(parts), r.text() if r.text() == b"".join(parts).decode() else None)]
    return _rows(t, rows, "size long, chunks long, d string").select("size", "chunks", F.md5(F.col("d").cast("binary")).alias("digest"))


@query("q_last_record", "select n_nationkey::varchar as key, n_name as name from nation order by n_nationkey desc limit 1")
def _last(t):
    r = _reader(t, _text(t)).last_record()
    return _rows(t, [(r["n_nationkey"], r["n_name"])], "key string, name string")


@query("q_bom_documents", "select encoding, n_nationkey::varchar as n_nationkey, n_name, 'é€' as more from nation, (values ('UTF-8'), ('UTF-16LE'), ('UTF-16BE'), ('UTF-32LE'), ('UTF-32BE')) e(encoding)")
def _boms(t):
    text, made = "\n".join(f"{r['n_nationkey']},{r['n_name']},é€" for r in t("nation").records()), None
    for name, mark in BOMS.items():
        reader = CharsetConverter.add_bom_skipping_to(_reader(t, mark + text.encode(name), None))
        df = reader.to_table(["n_nationkey", "n_name", "more"]).df.select(F.lit(reader.input_bom()).alias("encoding"), "n_nationkey", "n_name", "more")
        made = df if made is None else made.unionByName(df)
    return made


@query("q_bom_facts", "select * from (values ('UTF-8', 'EFBBBF', 3::bigint, true, false, false, 'UTF-8'), ('UTF-16LE', 'FFFE', 2, false, true, false, 'utf16le'), ('UTF-16BE', 'FEFF', 2, false, true, false, 'utf-16'), ('UTF-32LE', 'FFFE0000', 4, false, false, true, 'UTF32LE'), ('UTF-32BE', '0000FEFF', 4, false, false, true, 'utf_32')) v(name, mark, size, utf8, utf16, utf32, alias)")
def _bom_facts(t):
    aliases = {"UTF-8": "UTF-8", "UTF-16LE": "utf16le", "UTF-16BE": "utf-16", "UTF-32LE": "UTF32LE", "UTF-32BE": "utf_32"}
    rows = [(Bom.from_encoding(a), m.hex().upper(), Bom.length(n), Bom.is_utf8(n), Bom.is_utf16(n), Bom.is_utf32(n), a) for n, a in aliases.items() if (m := BOMS[n]) and Bom.from_sequence(m + b"x") == n]
    return _rows(t, rows, "name string, mark string, size long, utf8 boolean, utf16 boolean, utf32 boolean, alias string")


@query("q_output_bom", "select 'EFBBBF' as mark, 'r_regionkey,r_name' as first, (select count(*) from region)::bigint as n")
def _output_bom(t):
    table, path = t("region"), shared_dir(t("region").df.sparkSession)
    write_csv(table.sorted(SortOn("r_regionkey")), path, Dialect(escape=""), header=True, single=True, bom="UTF-8")
    data = b"".join(bytes(r["content"]) for r in table.df.sparkSession.read.format("binaryFile").load(path).collect())
    mark = Bom.from_sequence(data)
    return _rows(t, [(BOMS[mark].hex().upper(), data[3:].decode().split("\n")[0], data.count(b"\n") - 1)], "mark string, first string, n long")


@query("q_charset_documents", "select n_nationkey::varchar as n_nationkey, n_name || ' é€' as n_name from nation")
def _charset(t):
    text = "".join(f"{r['n_nationkey']},{r['n_name']} é€\n" for r in t("nation").records())
    to_utf8 = CharsetConverter().input_encoding("ISO-8859-15").output_encoding("UTF-8")
    return to_utf8.prepend_to(_reader(t, text.encode("ISO-8859-15"), None)).to_table(["n_nationkey", "n_name"]).df.drop(OFFSET)


@query("q_charset_cells", "select p_partkey, p_name || ' é' as name from part")
def _charset_cells(t):
    cell = F.encode(F.concat("p_name", F.lit(" é")), "ISO-8859-1")
    return t("part").df.select("p_partkey", CharsetConverter("ISO-8859-1", "UTF-8").cell(cell).alias("name"))


@query("q_charset_records", "select n_nationkey, 'é' || n_name as name from nation")
def _charset_records(t):
    records = ({"key": r["n_nationkey"], "name": ("é" + r["n_name"]).encode("ISO-8859-15")} for r in t("nation").records())
    made = CharsetConverter("ISO-8859-15", "UTF-8").convert(records)
    return _rows(t, [(r["key"], r["name"].decode()) for r in made], "n_nationkey int, name string")


@query("q_charset_files", "select c_custkey::varchar as c_custkey, c_name || ' é€' as c_name from customer")
def _charset_files(t):
    table, spark = Table(t("customer").df.select("c_custkey", F.concat("c_name", F.lit(" é€")).alias("c_name"))), t("customer").df.sparkSession
    path = shared_dir(spark)
    write_csv(table, path, Dialect(escape="", encoding="ISO-8859-15"))
    return Reader.from_path(spark, path).set_escape("").set_encoding("ISO-8859-15").to_table(["c_custkey", "c_name"]).df.drop(OFFSET)


@query("q_swap_delimiter", _NATION)
def _swap(t):
    writer = SwapDelimiter.add_to(Writer(Dialect(delimiter="\x02", escape="")), "💩")
    writer.insert_all(_nation(t))
    if "💩" not in writer.to_string():
        raise ValueError("the delimiter was not replaced")
    reader = SwapDelimiter.add_to(_reader(t, writer.to_bytes(), None).set_delimiter("\x02"), "💩")
    return reader.to_table(["n_nationkey", "n_name", "n_regionkey"]).df.drop(OFFSET)


@query("q_rfc4180_field", "select n_nationkey::varchar as n_nationkey, 'say \"' || n_name || '\"' as said from nation")
def _rfc(t):
    text = "".join(f'{r["n_nationkey"]},"say \\"{r["n_name"]}\\""\n' for r in t("nation").records())
    return rfc4180_field(_reader(t, text, None).set_escape("\\")).set_escape("").to_table(["n_nationkey", "said"]).df.drop(OFFSET)


@query("q_enclose_field", "select '\"' || n_nationkey || '\",\"' || n_name || '\"' as line from nation")
def _enclose(t):
    writer = enclose_field(Writer(Dialect(escape="")))
    writer.insert_all(t("nation").select("n_nationkey", "n_name"))
    return _rows(t, [(x,) for x in writer.to_string().splitlines()], "line string")


@query("q_filters_read", "select n_nationkey::varchar as n_nationkey, upper(replace(n_name, 'A', 'x')) as n_name from nation")
def _filters_read(t):
    up, swap, drop = _filter("q.up", lambda data, _: data.upper()), _filter("q.swap", lambda data, pair: data.replace(*pair)), _filter("q.drop", lambda data, _: b"")
    reader = _reader(t, _text(t, header=False), None).append_filter(up).prepend_filter(swap, (b"A", b"x")).append_filter(drop).remove_filter(drop)
    return reader.to_table(["n_nationkey", "n_name", "n"]).df.select("n_nationkey", "n_name")


@query("q_filters_write", "select case when contains(r_name, ' ') then '\"' || replace(upper(r_name), 'A', '4') || '\"' else replace(upper(r_name), 'A', '4') end || ',' || r_regionkey as line from region")
def _filters_write(t):
    up, swap = _filter("q.up", lambda data, _: data.upper()), _filter("q.swap", lambda data, pair: data.replace(*pair))
    writer = Writer(Dialect(escape="")).append_filter(swap, (b"A", b"4")).prepend_filter(up)
    writer.insert_all(t("region").select("r_name", "r_regionkey"))
    return _rows(t, [(x,) for x in writer.to_string().splitlines()], "line string")


@query("q_filters_files", "select replace(c_name, '#', '-') || ';' || c_custkey as line from customer")
def _filters_files(t):
    table, swap = t("customer").select("c_name", "c_custkey"), _filter("q.swap", lambda data, pair: data.replace(*pair))
    path = shared_dir(table.df.sparkSession)
    write_csv(table, path, Dialect(delimiter=";", escape=""), filters=((swap, (b"#", b"-")),))
    return table.df.sparkSession.read.text(path).withColumnRenamed("value", "line")


@query("q_filter_registry", "select true as registered, true as listed, true as attached, false as detached, 'AB' as called, true as writes, false as gone")
def _registry(t):
    name = _filter("q.once", lambda data, _: data.upper())
    reader = _reader(t, "a").append_filter(name)
    row = (csv.is_registered(name), name in csv.registered_filters(), reader.has_filter(name), reader.remove_filter(name).has_filter(name), csv.filter_callback(name)(b"ab", None).decode(), Writer().append_filter(name).has_filter(name))
    csv.unregister_filter(name)
    return _rows(t, [(*row, csv.is_registered(name))], "registered boolean, listed boolean, attached boolean, detached boolean, called string, writes boolean, gone boolean")


@query("q_column_consistency_first", "select n_nationkey::bigint as at, 2::integer as fields from nation where n_nationkey % 5 = 3")
def _consistent(t):
    text = "".join(f"{r['n_nationkey']},{r['n_name']}" + ("" if r["n_nationkey"] % 5 == 3 else f",{r['n_regionkey']}") + "\n" for r in t("nation").records())
    return ColumnConsistency().failures(_reader(t, text, None).to_table()).df.select(F.col(OFFSET).alias("at"), F.size(FIELDS).alias("fields"))


@query("q_date_formats", "select o_orderkey, o_orderdate::timestamp as machine, date_trunc('day', o_orderdate)::timestamp as localized, date_trunc('second', o_orderdate)::timestamp as stamp from orders")
def _date_formats(t):
    d = F.col("o_orderdate")
    parse = lambda fields, c: F.coalesce(*[f.parse(c) for f in fields])
    return t("orders").df.select("o_orderkey", parse(I.DateTimeField.machine(), F.date_format(d, "yyyy-MM-dd HH:mm:ss")).alias("machine"), I.DateTimeField.from_format("d.m.Y").parse(F.date_format(d, "dd.MM.yyyy")).alias("localized"), I.DateTimeField.timestamp().parse(F.unix_timestamp(d).cast("string")).alias("stamp"))


# writers


@query("q_writer_lines", "select n_nationkey::bigint as at, n_nationkey || ';\"' || n_name || ' !\"' as line from nation")
def _writer(t):
    writer = Writer(Dialect(delimiter=";", escape="")).set_end_of_line("<>\n").set_flush_threshold(10).add_formatter(lambda r: [r["n_nationkey"], r["n_name"] + " !"]).add_validator(lambda r: len(r) == 2, "two")
    sizes = [writer.insert_one(r) for r in t("nation").select("n_nationkey", "n_name").records()]
    data = writer.to_bytes()
    rows = data.decode().removesuffix("<>\n").split("<>\n")
    if sum(sizes) != len(data):
        raise ValueError("the sizes are not those of the lines")
    return _rows(t, list(enumerate(rows)), "at long, line string")


@query("q_writer_policies", "select n_name as necessary, '\"' || n_name || '\"' as forced, n_name as bare from nation where not contains(n_name, ' ') union all select '\"' || n_name || '\"', '\"' || n_name || '\"', n_name from nation where contains(n_name, ' ')")
def _policies(t):
    made = []
    for policy in ("necessary_enclosure", "force_enclosure", "no_enclosure"):
        writer = getattr(Writer(Dialect(escape="")), policy)()
        writer.insert_all(t("nation").select("n_name"))
        made.append(writer.to_string().splitlines())
    return _rows(t, list(zip(*made, strict=True)), "necessary string, forced string, bare string")


@query("q_writer_rejects", "select 'short' as name, (select count(*) from nation where length(n_name) > 6)::bigint as rejected, (select count(*) from nation where length(n_name) <= 6)::bigint as written")
def _rejects(t):
    writer, rejected, names = Writer().add_validator(lambda r: len(r["n_name"]) <= 6, "short"), 0, set()
    for r in t("nation").select("n_name").records():
        try:
            writer.insert_one(r)
        except CannotInsertRecord as e:
            rejected += 1
            names.add(e.name)
    return _rows(t, [(names.pop(), rejected, writer.to_string().count("\n"))], "name string, rejected long, written long")


@query("q_files_with_header", "select c_custkey, c_name, c_nationkey from customer")
def _files_header(t):
    table = t("customer").select("c_custkey", "c_name", "c_nationkey")
    path = shared_dir(table.df.sparkSession)
    write_csv(table, path, Dialect(escape=""), header=True, validators={"id": lambda x: F.col("c_custkey") >= 0}, formatters=(lambda df: df.withColumn("c_name", F.trim("c_name")),))
    read = Reader.from_path(table.df.sparkSession, path).set_escape("").set_header_offset(0).fast(single_line=True).to_table().df
    return read.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"))


@query("q_files_end_of_line", "select p_partkey || ',' || p_size as line from part")
def _files_eol(t):
    table = t("part").select("p_partkey", "p_size")
    path = shared_dir(table.df.sparkSession)
    write_csv(table, path, Dialect(escape="", eol="|~\n"))
    return table.df.sparkSession.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\|~$", "").alias("line"))


@query("q_buffer_to_writer", "select 'n_nationkey,n_name,n_regionkey' as line union all select n_nationkey || ',' || case when contains(n_name, ' ') then '\"' || n_name || '\"' else n_name end || ',' || n_regionkey from nation")
def _buffer_to(t):
    writer = Writer(Dialect(escape=""))
    Buffer.of(_nation(t)).to(writer)
    return _rows(t, [(x,) for x in writer.to_string().splitlines()], "line string")


@query("q_download", "select * from (values ('nations.csv', 'text/csv', 'attachment; filename=\"nations.csv\"'), ('é.json', 'application/json', 'attachment; filename=\"_.json\"; filename*=UTF-8''''%C3%A9.json'), ('n.xml', 'application/xml', 'attachment; filename=\"n.xml\"')) v(name, kind, disposition)")
def _download(t):
    writer = Writer()
    writer.insert_all(t("region"))
    made = {"nations.csv": writer.download("nations.csv"), "é.json": JsonConverter().download(t("region"), "é.json"), "n.xml": XmlConverter().download(t("region"), "n.xml")}
    return _rows(t, [(n, h["Content-Type"], h["Content-Disposition"]) for n, (h, body) in made.items() if body], "name string, kind string, disposition string")


# converters

_JSON = """'{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}'"""


@query("q_json_document", f"select '[' || string_agg({_JSON}, ',' order by n_nationkey) || ']' as document from nation")
def _json_document(t):
    parts = list(JsonConverter().with_chunk_size(7).convert(t("nation").select("n_nationkey", "n_name")))
    return _rows(t, [("".join(parts),)], "document string")


@query("q_json_objects", f"""select '{{' || string_agg('"' || n_nationkey || '":' || {_JSON}, ',' order by n_nationkey) || '}}' as document from nation""")
def _json_objects(t):
    return _rows(t, [(JsonConverter().with_force_object().encode(t("nation").select("n_nationkey", "n_name")),)], "document string")


@query("q_json_lines", "select 'header' as kind, '[\"n_nationkey\",\"n_name\"]' as line union all select k, '[' || n_nationkey || ',\"' || n_name || '\"]' from nation, (values ('header'), ('headerless')) v(k)")
def _json_lines(t):
    rows = [(kind, x) for kind in ("header", "headerless") for x in JsonConverter(f"ndjson_{kind}").encode(t("nation").select("n_nationkey", "n_name")).splitlines()]
    return _rows(t, rows, "kind string, line string")


@query("q_json_pretty", """select '[' || chr(10) || string_agg('  {' || chr(10) || '    "r_name": "' || r_name || '"' || chr(10) || '  }', ',' || chr(10) order by r_regionkey) || chr(10) || ']' as document from region""")
def _json_pretty(t):
    return _rows(t, [(JsonConverter().with_pretty_print(2).encode(Table(t("region").df.orderBy("r_regionkey"), ordered=(F.lit(0),)).select("r_name")),)], "document string")


@query("q_json_flags", """select n_nationkey, '{"a":"\\u003Cb\\u003E \\u0026 \\u0027\\/' || n_name || '","b":' || n_regionkey || ',"c":1.0}' as line from nation""")
def _json_flags(t):
    c = JsonConverter("ndjson").with_hex_tag().with_hex_amp().with_hex_apos().with_numeric_check().add_flags("preserve_zero_fraction", "pretty_print").without_pretty_print()
    assert c.use_flags("hex_tag", "numeric_check") and not c.use_pretty_print()
    return _rows(t, [(r["n_nationkey"], c.encode([{"a": f"<b> & '/{r['n_name']}", "b": str(r["n_regionkey"]), "c": 1.0}]).strip()) for r in t("nation").records()], "n_nationkey int, line string")


@query("q_json_options", """select n_nationkey, '["' || lower(n_name) || '/é"]' as line from nation""")
def _json_options(t):
    c = JsonConverter().with_depth(3).with_formatter(lambda r: {"n": r["n_name"].lower() + "/é"}).when(True, lambda x: x.with_format("ndjson_headerless")).when(lambda x: x.depth == 3, lambda x: x.with_unescaped_slashes().with_unescaped_unicode())
    rows = t("nation").to_list()
    return _rows(t, list(zip([r["n_nationkey"] for r in rows], c.encode(rows).splitlines(), strict=True)), "n_nationkey int, line string")


@query("q_json_files", """select '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' as value from customer""")
def _json_files(t):
    table, path = t("customer").select("c_custkey", "c_name"), shared_dir(t("customer").df.sparkSession)
    JsonConverter("ndjson").write(table, path)
    return table.df.sparkSession.read.text(path)


@query("q_json_serialize", """select '{"r_regionkey": ' || r_regionkey || ', "r_name": "' || r_name || '"}' as record from region""")
def _json_serialize(t):
    return _rows(t, [(json.dumps(r),) for r in Table(t("region").df, order_key=["r_regionkey"]).to_list()], "record string")


@query("q_xml_document", "select '<nations>' || string_agg('<nation at=\"' || n_nationkey || '\"><field name=\"n_name\">' || n_name || '</field></nation>', '' order by n_nationkey) || '</nations>' as document from nation where n_regionkey = 1")
def _xml_document(t):
    some = t("nation").with_offset().filter(Col("n_regionkey", "=", 1)).select("n_name")
    return _rows(t, [(XmlConverter().root_element("nations").record_element("nation", "at").field_element("field", "name").encode(some),)], "document string")


@query("q_xml_names", "select '<csv>' || string_agg('<row><r_regionkey>' || r_regionkey || '</r_regionkey><r_name>' || lower(r_name) || '</r_name></row>', '' order by r_regionkey) || '</csv>' as document, true as names, false as odd from region")
def _xml_names(t):
    table = Table(t("region").df, order_key=["r_regionkey"])
    c = XmlConverter(formatter=lambda r: r | {"r_name": r["r_name"].lower()}).when(XmlConverter.supports_header(table.columns), lambda x: x.field_element(None))
    return _rows(t, [(c.encode(table), XmlConverter.supports_header(table.columns), XmlConverter.supports_header(["1 a"]))], "document string, names boolean, odd boolean")


@query("q_html_document", "select '<table class=\"t\" id=\"x\"><thead><tr><th scope=\"col\">key</th><th scope=\"col\">name</th></tr></thead><tbody>' || string_agg('<tr at=\"' || n_nationkey || '\"><td of=\"n_nationkey\">' || n_nationkey || '</td><td of=\"n_name\">' || lower(n_name) || '</td></tr>', '' order by n_nationkey) || '</tbody><tfoot><tr><th scope=\"col\">end</th></tr></tfoot></table>' as document from nation where n_regionkey = 2")
def _html_document(t):
    some = t("nation").with_offset().filter(Col("n_regionkey", "=", 2)).select("n_nationkey", "n_name")
    c = HtmlConverter(formatter=lambda r: r | {"n_name": r["n_name"].lower()}).table("t", "x").tr("at").when(True, lambda x: x.td("of"))
    return _rows(t, [(c.convert(some, ["key", "name"], ["end"]),)], "document string")


# statements and rows

_where("q_or_where_column", "lineitem", _LINE, _S.and_where("l_quantity", "<", 3).or_where_column("l_linenumber", ">=", "l_quantity"), "l_quantity < 3 or l_linenumber >= l_quantity")
_where("q_xor_where_column", "lineitem", _LINE, _S.and_where("l_quantity", "<", 3).xor_where_column("l_linenumber", ">=", "l_quantity"), "(l_quantity < 3) <> (l_linenumber >= l_quantity)")
_where("q_not_where_column", "lineitem", _LINE, _S.and_where("l_quantity", "<", 3).where_not_column("l_linenumber", ">=", "l_quantity"), "not (l_quantity < 3) and not (l_linenumber >= l_quantity)")
_where("q_when", "lineitem", _LINE, _S.when(True, lambda s: s.and_where("l_quantity", "<", 3), lambda s: s.limit(0)).when(False, lambda s: s.limit(0), lambda s: s.and_where("l_linenumber", "=", 1)), "l_quantity < 3 and l_linenumber = 1")
_where("q_column_closure", "part", "p_partkey, p_name", _S.and_where("p_name", lambda v: v is not None and len(v) % 2 == 0), "length(p_name) % 2 = 0")
_where("q_two_column_closure", "lineitem", _LINE, _S.where(Cols("l_linenumber", lambda a, b: a * 10 > b, "l_quantity")), "l_linenumber * 10 > l_quantity")


@query("q_regexp_columns", "select p_partkey, p_name from part where regexp_matches(p_name, '(?i)^' || left(p_type, 1))")
def _regexp_columns(t):
    table = Table(t("part").df.withColumn("pattern", F.concat(F.lit("/^"), F.left("p_type", F.lit(1)), F.lit("/i"))))
    return _S.where(Cols("p_name", "regexp", "pattern")).select("p_partkey", "p_name").process(table).df


@query("q_limit_zero", "select o_orderkey from orders where false")
def _limit_zero(t):
    return _S.offset(1).limit(0).select("o_orderkey").process(t("orders")).df


@query("q_where_closure", f"select o_orderkey, rn from {_ORD} where o_orderstatus = 'F' and rn % 3 = 0")
def _where_closure(t):
    table = t("orders").select("o_orderkey", "o_orderstatus")
    table = Table(table.df, order_key=["o_orderkey"]).filter(Where(lambda r, k: r["o_orderstatus"] == "F" and k % 3 == 0, closure=True))
    return table.df.select("o_orderkey", F.col(OFFSET).alias("rn"))


@query("q_sort_comparator", "select c_custkey, c_name, c_mktsegment, row_number() over (order by length(c_mktsegment) desc, c_mktsegment, c_custkey) as place from customer order by place limit 60")
def _comparator(t):
    by_length = CompareOn("c_mktsegment", lambda a, b: (len(a) - len(b)) or (a < b) - (a > b), "desc")
    top = t("customer").select("c_custkey", "c_name", "c_mktsegment").sorted(by_length, SortOn("c_custkey")).slice(0, 60)
    rows = [(i + 1, *r.values()) for i, r in enumerate(top.records())]
    return _rows(t, rows, "place long, c_custkey long, c_name string, c_mktsegment string")


@query("q_offset_closure", f"select o_orderkey, rn from {_ORD} where length(rn::varchar) = 2")
def _offset_closure(t):
    table = Table(t("orders").df.select("o_orderkey"), order_key=["o_orderkey"]).filter(Offset(lambda k: len(str(k)) == 2))
    return table.df.select("o_orderkey", F.col(OFFSET).alias("rn"))


@query("q_header_combine", "select n_nationkey::bigint as id, n_name as name, case when n_nationkey % 2 = 0 then n_regionkey end::bigint as region from nation")
def _combine(t):
    rows = [[r["n_nationkey"], r["n_name"], r["n_regionkey"], "cut"] if r["n_nationkey"] % 2 == 0 else [r["n_nationkey"], r["n_name"]] for r in t("nation").records()]
    return Table.from_records(t("nation").df.sparkSession, rows, ["id", "name", "region"]).df.drop(OFFSET)


@query("q_map_closure", "select p_partkey, upper(p_name) as name, length(p_name)::integer as size from part")
def _map(t):
    return t("part").select("p_partkey", "p_name").map(lambda r: {"p_partkey": r["p_partkey"], "name": r["p_name"].upper(), "size": len(r["p_name"])}, "p_partkey long, name string, size int").df


@query("q_row_values", "select n_nationkey, n_name as by_name, n_regionkey as by_ordinal, n_name as from_end from (select n_nationkey, n_regionkey, n_name from nation)")
def _row_values(t):
    table = t("nation").select("n_nationkey", "n_regionkey", "n_name")
    return table.df.select("n_nationkey", *[table.resolve(c)[0].alias(n) for c, n in (("n_name", "by_name"), (1, "by_ordinal"), (-1, "from_end"))])


@query("q_value_by_name", "select n_name as name, n_nationkey as key, true as none from nation order by n_nationkey limit 1")
def _value_by_name(t):
    table = t("nation")
    return _rows(t, [(table.value("n_name"), table.value(0), table.value("unknown") is None)], "name string, key int, none boolean")


@query("q_buffer_column", "select n_nationkey::bigint as at, nullif(n_name, 'CHINA') as name from nation")
def _buffer_column(t):
    b = Buffer.of(Table(t("nation").df.select("n_nationkey", F.nullif(F.col("n_name"), F.lit("CHINA")).alias("n_name")), order_key=["n_nationkey"]))
    return _rows(t, list(enumerate(b.fetch_column("n_name"))), "at long, name string")


@query("q_each", "select (select count(*) from nation)::bigint as visited, 6::bigint as stopped_at, true as went_through, false as whole")
def _each(t):
    seen = []
    through = t("nation").each(lambda r: seen.append(r) is None)
    some = []
    whole = t("nation").each(lambda r: some.append(r) is None and r["n_nationkey"] < 5)
    return _rows(t, [(len(seen), len(some), through, whole)], "visited long, stopped_at long, went_through boolean, whole boolean")


@query("q_reduce_closure", "select string_agg(n_name, '>' order by n_nationkey) as chain, sum(n_regionkey)::bigint as total from nation")
def _reduce_closure(t):
    chain = t("nation").reduce(lambda s, r: r["n_name"] if s is None else f"{s}>{r['n_name']}")
    total = Buffer.of(t("nation")).to_table().reduce(lambda n, r: n + r["n_regionkey"], 0)
    return _rows(t, [(chain, total)], "chain string, total long")


@query("q_buffer_facts", "select false as empty, true as header, (select count(*) - 5 from nation)::bigint as n, 5::bigint as first, (select count(*) - 1 from nation)::bigint as last, (select n_name from nation where n_nationkey = 7) as third, true as cleared")
def _buffer_facts(t):
    b = Buffer.of(t("nation"))
    b.delete(Offset("<", 5))
    row = (b.is_empty(), b.has_header(), b.record_count(), b.first_offset(), b.last_offset(), b.nth(2)["n_name"])
    b.truncate()
    return _rows(t, [(*row, b.is_empty())], "empty boolean, header boolean, n long, first long, last long, third string, cleared boolean")


@query("q_buffer_checked", "select n_nationkey, n_name, n_regionkey from nation union all select 100, 'NEW', 1")
def _buffer_checked(t):
    b = Buffer.of(t("nation")).add_formatter(lambda df: df.withColumn("n_name", F.upper("n_name"))).add_validator(lambda x: F.col("n_regionkey") < 5, "region")
    b.insert([100, "new", 1])
    try:
        b.insert([101, "bad", 9])
    except CannotInsertRecord:
        b.delete(Col("n_nationkey", "=", 101), count=False)
    return b.to_table().df.select("n_nationkey", "n_name", "n_regionkey")


@query("q_buffer_padded", "select n_nationkey, case when n_nationkey < 3 then 'X' else n_name end as n_name, case when n_nationkey >= 3 then n_regionkey end as n_regionkey from nation")
def _buffer_padded(t):
    b = Buffer.of(_nation(t))
    b.update(Col("n_nationkey", "<", 3), {1: "X", "n_regionkey": None}, count=False)
    return b.to_table().df.select("n_nationkey", "n_name", "n_regionkey")


@query("q_fragment_first", "select 'row' as what, n_name as name from nation where n_nationkey = 3 union all select 'cell', n_name from nation where n_nationkey = 1 union all select 'none', null")
def _fragment_first(t):
    nation = t("nation")
    rows = [("row", nation.matching_first("row=4")), ("cell", nation.matching_first_or_fail("cell=2,2-3,2")), ("none", nation.matching_first("row=1000"))]
    return _rows(t, [(k, x.first()["n_name"] if x is not None else None) for k, x in rows], "what string, name string")


@query("q_cursor", "select n_nationkey, n_name from nation")
def _cursor(t):
    db = sqlite3.connect(":memory:")
    db.execute("create table n (n_nationkey integer, n_name text)")
    db.executemany("insert into n values (?, ?)", [(r["n_nationkey"], r["n_name"]) for r in t("nation").records()])
    cursor = db.execute("select * from n")
    if rdbms.column_names(cursor) != ["n_nationkey", "n_name"] or next(rdbms.rows(cursor))["n_nationkey"] != 0:
        raise ValueError("the cursor has other columns")
    return rdbms.from_cursor(t("nation").df.sparkSession, db.execute("select * from n")).df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("q_try_of", "select true as table_, true as frame, true as reader, true as none")
def _try(t):
    row = (Table.try_of(t("nation")) is not None, Table.try_of(t("nation").df) is not None, Table.try_of(_reader(t, _text(t))) is not None, Table.try_of(42) is None)
    return _rows(t, [row], "table_ boolean, frame boolean, reader boolean, none boolean")


@query("q_reader_formatter", "select n_nationkey::varchar as n_nationkey, lower(n_name) || '!' as n_name from nation")
def _reader_formatter(t):
    reader = _reader(t, _text(t)).add_formatter(lambda df: df.withColumn("n_name", F.lower("n_name"))).add_formatter(lambda df: df.withColumn("n_name", F.concat("n_name", F.lit("!"))))
    return reader.to_table().df.select("n_nationkey", "n_name")


@query("q_escape_special", "select n_nationkey, case when n_name[1] in ('A', 'B') then '~' || n_name else n_name end as cell, n_name as back from nation")
def _escape_special(t):
    e = EscapeFormula("~", ("A", "B"))
    c = F.col("n_name")
    return t("nation").df.select("n_nationkey", e.escape_cell(c).alias("cell"), e.unescape_cell(e.escape_cell(c)).alias("back"))


class Status(enum.Enum):
    DONE = "F"
    OPEN = "O"
    PARTIAL = "P"


@query("q_enum_formatter", "select c_custkey, case c_custkey % 3 when 0 then 'DONE' when 1 then 'OPEN' else 'PARTIAL' end as by_name, case c_custkey % 3 when 0 then 'F' when 1 then 'O' else 'P' end as by_value, case c_custkey % 3 when 0 then 'done' when 1 then 'open' else 'partial' end as by_call from customer ")
def _enum_formatter(t):
    rows, kinds = [], list(Status)
    for r in t("customer").records():
        e = kinds[r["c_custkey"] % 3]
        rows.append((r["c_custkey"], *[f({"x": e})["x"] for f in (EnumFormatter.using_name(), EnumFormatter.using_json(), EnumFormatter.using_callback(lambda x: x.name.lower()))]))
    return _rows(t, rows, "c_custkey long, by_name string, by_value string, by_call string")


# schemas

_AGE = "case p_partkey % 4 when 0 then '' when 1 then 'x' else p_size::varchar end"
_AGE_F = lambda: F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, "x").otherwise(F.col("p_size").cast("string"))


@query("q_evaluate", f"select p_partkey, case when {_AGE} = '' then 0 when {_AGE} = 'x' then -1 else 1 end as valid from part")
def _evaluate(t):
    return t("part").df.select("p_partkey", I.NumericField().evaluate(_AGE_F()).alias("valid"))


@query("q_schema_parse", "select p_partkey::double as p_partkey, case when p_partkey % 4 > 1 then p_size::double end as age, p_name from part")
def _schema_parse(t):
    table = Table(t("part").df.select("p_partkey", _AGE_F().alias("age"), "p_name"))
    schema = I.Schema().append("p_partkey", I.NumericField()).append("age", I.StringField()).replace("age", I.NumericField.positive()).append("gone", I.BooleanField()).remove("gone")
    return schema.parse(table).df


@query("q_schema_edit", "select 'a,b' as names, 'boolean' as a, true as has_b, false as has_c, 1::bigint as at, true as taken, 1.5::double as formatted")
def _schema_edit(t):
    schema = I.Schema().append("a", I.BooleanField()).append("b", I.NumericField())
    try:
        schema.append("a", I.BooleanField())
        taken = False
    except InvalidArgument:
        taken = True
    at = [n for _, n in schema.map(lambda f, n: (f.type, n))].index("b")
    return _rows(t, [(",".join(schema.names()), schema.get("a").type, schema.has("b"), schema.has("c"), at, taken, schema.format({"a": "yes", "b": "1.5"})["b"])], "names string, a string, has_b boolean, has_c boolean, at long, taken boolean, formatted double")


@query("q_field_list", "select * from (values ('appended', 'json'), ('prepended', 'boolean'), ('replaced', 'time'), ('without offset', 'numeric,string'), ('without type', 'boolean'), ('without name', 'boolean,numeric'), ('nth', 'numeric'), ('get', 'uuid'), ('all removed', 'boolean,numeric,string')) v(what, types)")
def _field_list(t):
    base = I.FieldList((I.BooleanField(), I.NumericField(), I.StringField.uuid()))
    types = lambda x: ",".join(f.type for f in x)
    rows = [
        ("appended", base.append(I.JsonField()).nth(-1).type), ("prepended", base.prepend(I.BooleanField()).nth(0).type), ("replaced", base.replace(1, I.TimeField()).nth(1).type), ("without offset", types(base.remove_by_offset(0))),
        ("without type", types(base.remove_by_type("numeric", "string"))), ("without name", types(base.remove_by_name("uuid"))), ("nth", base.nth(1).type), ("get", base.get("string", "uuid").name), ("all removed", types(base.remove_by_offset(0, 1, 2))),
    ]
    return _rows(t, rows, "what string, types string")


@query("q_inspector", "select 'p_size' as name, 'enum' as type union all select 'p_name', 'string'")
def _inspector(t):
    sizes = I.EnumField([str(i) for i in range(1, 51)])
    table = Table(t("part").df.select(F.col("p_size").cast("string").alias("p_size"), "p_name", "p_partkey"), order_key=["p_partkey"]).select("p_size", "p_name")
    inspector = I.Inspector().with_sample_limit(30).with_fields(I.FieldList((sizes, I.BooleanField())))
    return _rows(t, list(table.infer_schema(inspector).types().items()), "name string, type string")


@query("q_custom_field", "select p_partkey, case when length(p_name) % 2 = 0 then reverse(p_name) end as odd from part")
def _custom(t):
    field = I.CustomField("turned_name", lambda v: v[::-1] if v is not None and len(v) % 2 == 0 else None)
    return t("part").df.select("p_partkey", field.parse(F.col("p_name")).alias("odd"))


@query("q_field_metadata", "select 1::double as low, 5::double as high, 'kg' as unit, 3::bigint as keys")
def _metadata(t):
    meta = I.NumericField.between(1, 5).union({"unit": "kg", "min": 7}).metadata
    return _rows(t, [(float(meta["min"]), float(meta["max"]), meta["unit"], len(meta))], "low double, high double, unit string, keys long")


@query("q_numeric_ranges", "select p_partkey, case when p_size >= 20 then p_size::double end as least, case when p_size <= 20 then p_size::double end as most, case when p_size = 20 then p_size::double end as fixed, case when p_size between 10 and 20 then p_size::double end as within from part")
def _ranges(t):
    c, n = F.col("p_size").cast("string"), I.NumericField
    return t("part").df.select("p_partkey", n.min(20).parse(c).alias("least"), n.max(20).parse(c).alias("most"), n.fixed(20).parse(c).alias("fixed"), n.between(10, 20).parse(c).alias("within"))


@query("q_structured_text", "select event_id, sha1(event_id::varchar) as sha1, '#' || substr(md5(event_id::varchar), 1, 6) as color, md5(event_id::varchar) || '.' || event_id || '.x' as jwt, '01' || upper(substr(md5(event_id::varchar), 1, 24)) as ulid from events")
def _structured(t):
    e = F.col("event_id").cast("string")
    md5 = F.md5(e.cast("binary"))
    s = I.StringField
    cells = {"sha1": (s.sha1(), F.sha1(e.cast("binary"))), "color": (s.hex_color(), F.concat(F.lit("#"), F.substring(md5, 1, 6))), "jwt": (s.jwt_token(), F.concat(md5, F.lit("."), e, F.lit(".x"))), "ulid": (s.ulid(), F.concat(F.lit("01"), F.upper(F.substring(md5, 1, 24))))}
    return t("events").df.select("event_id", *[f.parse(c).alias(n) for n, (f, c) in cells.items()])


@query("q_json_validity", "select * from (values ('{\"a\":[1]}', true), ('1 2', false), ('null', false), ('\"x\"', true), ('1,2', false), ('[1,2', false), ('{\"a\":1}}', false), ('01', false), ('NaN', false), ('''x''', false), ('', false), ('{\"a\":1,\"a\":2}', true), ('1],[2', false), ('1},{\"b\":2', false), (' [true, null] ', true)) v(text, valid)")
def _json_validity(t):
    texts = ['{"a":[1]}', "1 2", "null", '"x"', "1,2", "[1,2", '{"a":1}}', "01", "NaN", "'x'", "", '{"a":1,"a":2}', "1],[2", '1},{"b":2', " [true, null] "]
    return _rows(t, [(x,) for x in texts], "text string").select("text", I.JsonField().parse(F.col("text")).isNotNull().alias("valid"))


# objects


@mapping.record(after_mapping=("mark",), trim_first=True)
@dataclasses.dataclass
class Nation:
    n_nationkey: int
    name: str = mapping.cell(column="n_name")
    region: int | None = mapping.cell(column=2, default=None)
    marked: bool = mapping.cell(ignore=True, default=False)

    def mark(self):
        self.marked = True


@query("q_objects", "select n_nationkey::bigint as n_nationkey, n_name as name, n_regionkey::bigint as region, true as marked from nation")
def _objects(t):
    return _rows(t, [dataclasses.astuple(x) for x in _nation(t).as_objects(Nation)], "n_nationkey long, name string, region long, marked boolean")


@query("q_some_objects", "select what, n_nationkey::bigint as key, n_name as name from nation join (values ('first', 0), ('third', 2), ('last', (select max(n_nationkey) from nation)), ('assigned', 7)) v(what, k) on n_nationkey = k")
def _some_objects(t):
    table = _nation(t)
    found = {"first": table.first_as_object(Nation), "third": table.nth_as_object(2, Nation), "last": table.last_as_object(Nation), "assigned": mapping.assign(Nation, table.nth(7))}
    return _rows(t, [(k, x.n_nationkey, x.name) for k, x in found.items()], "what string, key long, name string")


@dataclasses.dataclass
class Set:
    n_nationkey: int
    n_name: str = ""

    def set_n_name(self, name: str) -> None:
        self.n_name = f"<{name}>"

    @mapping.setter(column="n_regionkey")
    def zone(self, region: int) -> None:
        self.n_name += str(region)


@query("q_setters", "select n_nationkey::bigint as n_nationkey, '<' || n_name || '>' || n_regionkey as n_name from nation")
def _setter_objects(t):
    return _rows(t, [(x.n_nationkey, x.n_name) for x in _nation(t).as_objects(Set)], "n_nationkey long, n_name string")


@dataclasses.dataclass
class Order:
    o_orderkey: int
    o_orderstatus: Status
    o_orderdate: datetime.date
    note: str | None = mapping.cell(column="o_orderpriority")


@query("q_mapped_columns", "select o_orderkey, o_orderstatus, cast(o_orderdate as timestamp) as o_orderdate, o_orderpriority as note from orders")
def _mapped(t):
    orders = Table(t("orders").df.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority"))
    return mapping.Mapper(Order).to_table(orders).df


@query("q_cast_defaults", "select p_partkey, coalesce(nullif(p_brand, 'Brand#11'), 'none') as text, coalesce(nullif(p_size, 7), -1)::bigint as size, case when p_size % 2 = 0 then 'F' else 'O' end as status from part")
def _cast_defaults(t):
    size = F.nullif(F.col("p_size"), F.lit(7)).cast("string")
    status = F.when(F.col("p_size") % 2 == 0, "F").otherwise("O")
    return t("part").df.select("p_partkey", mapping.cast_string(F.nullif(F.col("p_brand"), F.lit("Brand#11")), "t", "none").alias("text"), mapping.cast_int(size, "s", -1).alias("size"), mapping.cast_enum(status, "e", Status).alias("status"))


@query("q_cast_shapes", "select p_partkey, 3::integer as csv, p_name as quoted, 2::integer as json, p_size::bigint as second, 2::integer as longs from part")
def _cast_shapes(t):
    line = F.concat(F.lit('a,"'), "p_name", F.lit('",c'))
    listed = F.concat(F.lit("[1,"), F.col("p_size").cast("string"), F.lit("]"))
    cells, parts = mapping.cast_array(line, "a", "csv"), mapping.cast_array(listed, "b", "json", of="bigint")
    return t("part").df.select("p_partkey", F.size(cells).alias("csv"), cells[1].alias("quoted"), F.size(parts).alias("json"), parts[1].alias("second"), F.size(mapping.cast_array(F.lit("1;2"), "c", separator=";", of="bigint")).alias("longs"))


@dataclasses.dataclass
class Money:
    p_partkey: int
    p_retailprice: float = mapping.cell(cast="@cents")


@query("q_cast_alias", "select p_partkey, round(p_retailprice * 100)::bigint as cents, true as known, true as gone from part")
def _cast_alias(t):
    cents = lambda c, name, **options: F.round(c.cast("double") * 100).cast("long")
    mapping.register_alias("@cents", cents)
    try:
        known = "@cents" in mapping.registered()[1]
        df = mapping.Mapper(Money).to_table(t("part").select("p_partkey", "p_retailprice")).df
    finally:
        gone = mapping.unregister("@cents")
    return df.select("p_partkey", F.col("p_retailprice").alias("cents"), F.lit(known).alias("known"), F.lit(gone).alias("gone"))


class Loud:
    """A cast as an object."""

    def __init__(self, mark: str = "!"):
        self.mark = mark

    def to_variable(self, c, name):
        return F.concat(F.upper(c), F.lit(self.mark))


@dataclasses.dataclass
class LoudPart:
    p_partkey: int
    p_name: str = mapping.cell(cast=Loud, mark="!!")


@query("q_type_casting", "select p_partkey, upper(p_name) || '!!' as p_name from part")
def _type_casting(t):
    if not isinstance(Loud(), mapping.TypeCasting):
        raise TypeError("the protocol does not hold")
    return mapping.Mapper(LoudPart).to_table(t("part").select("p_partkey", "p_name")).df


@query("q_cast_failure", "select 'n_nationkey' as name, 'int' as target, true as has_value")
def _cast_failure(t):
    bad = Table(t("nation").df.select(F.concat("n_name", F.lit("x")).alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey")), order_key=["n_name"])
    try:
        list(bad.as_objects(Nation))
    except TypeCastingFailed as e:
        return _rows(t, [(e.column, e.target, e.value is not None)], "name string, target string, has_value boolean")
    raise ValueError("a text was taken for a number")


@query("q_type_resolution", "select * from (values ('int', false), ('float', true), ('Status', true), ('str', true)) v(type, nullable)")
def _resolution(t):
    found = [mapping.resolve(x) for x in (int, float | None, None | Status | int, str | None)]
    return _rows(t, [(k.__name__, null) for k, null in found], "type string, nullable boolean")
