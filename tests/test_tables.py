"""The table operators on small fixtures, and every query against DuckDB."""

import dataclasses
import datetime
import enum
import functools
import math
import pathlib
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from sparktab import queries, source_queries  # noqa: F401
from sparktab.errors import CannotInsertRecord, FragmentNotFound, InvalidArgument, QueryException, SyntaxProblem, TypeCastingFailed
from sparktab.functions.compare import Op
from sparktab.functions.text import Bom, EnumFormatter
from sparktab.operators import checks, mapping
from sparktab.operators.buffer import Buffer
from sparktab.operators.inference import BooleanField, Inspector, NumericField
from sparktab.plans.predicate import Col, Cols, Criteria, Offset, Where
from sparktab.plans.statement import Statement
from sparktab.sources import csv as csv_source
from sparktab.sources import rdbms
from sparktab.sources.convert import HtmlConverter, JsonConverter, XmlConverter
from sparktab.sources.csv import Dialect, Reader, Writer, format_line, parse_records, register_filter, unregister_filter, write_csv
from sparktab.table import OFFSET, Table

WEATHER = "date,temperature,place\n2011-01-01,1,Galway\n2011-01-02,-1,Galway\n2011-01-03,0,Galway\n2011-01-01,6,Berkeley\n2011-01-02,8,Berkeley\n2011-01-03,5,Berkeley\n"


@pytest.fixture(scope="module")
def weather(spark):
    return Reader.from_string(spark, WEATHER).set_header_offset(0).to_table()


@pytest.fixture(scope="module")
def volumes(spark):
    rows = [(67, 2), (86, 1), (85, 6), (98, 2), (86, 6), (67, 7)]
    return Table.from_records(spark, [{"volume": v, "edition": e} for v, e in rows])


def keys(table):
    return sorted(r[OFFSET] for r in table.with_offset().df.collect())


def test_first_record_under_a_header_has_offset_one(weather):
    assert keys(weather) == [1, 2, 3, 4, 5, 6]
    assert Statement().and_where_offset("<", 2).process(weather).count() == 1
    assert weather.nth(0)["place"] == "Galway" and weather.last()["temperature"] == "5"


def test_criteria(volumes):
    a, b = Col("volume", ">", 80), Col("edition", "<", 6)
    assert [keys(volumes.filter(c)) for c in (Criteria.all(a, b), Criteria.none(a, b), Criteria.any(a, b), Criteria.xany(a, b))] == [[1, 3], [5], [0, 1, 2, 3, 4], [0, 2, 4]]
    assert volumes.filter(Criteria.all()).count() == 6 and volumes.filter(Criteria.any()).count() == 0 and volumes.filter(Criteria.none()).count() == 6
    assert keys(Statement().where(a).where_not("edition", "<", 6).process(volumes)) == [5]


def test_null_and_type_rules(spark):
    t = Table.from_records(spark, [{"s": "10", "n": 1}, {"s": "9", "n": None}, {"s": "abc", "n": 0}, {"s": None, "n": 7}, {"s": "1e1", "n": -5}])
    at = lambda *p: keys(t.filter(Col(*p)))
    assert at("s", "=", 10) == [] and at("s", "!=", 10) == [0, 1, 2, 3, 4] and at("s", "=", None) == [3]
    assert at("s", "<", "10") == [1, 3] and at("s", ">=", "10") == [0, 2, 4]
    assert at("n", "<", 5) == [0, 1, 2, 4] and at("n", ">", 0) == [0, 3] and at("n", "<=", 0) == [1, 2, 4]
    assert at("s", "ncontain", "b") == [0, 1, 4] and at("s", "not in", ["9"]) == [0, 2, 3, 4] and at("s", "in", ["9", None]) == [1, 3]
    assert at("n", "not between", [0, 1]) == [3, 4] and at("s", "nregexp", "/^a/") == [0, 1, 4]
    assert at("s", lambda v: v is not None and len(v) == 3) == [2, 4]
    assert [r["s"] for r in Statement().order_by_asc("s").process(t).records()] == [None, "9", "10", "1e1", "abc"]


def test_operator_names_and_operands():
    assert Op.parse(" not between ") is Op.NBETWEEN and Op.parse("NOT BETWEEN", True) is Op.BETWEEN and Op.parse("is not") is Op.NEQ
    for bad in (("a", "like", 1), ("a", "between", [1]), ("a", "in", 3), ("a", "regexp", "x"), ("a", "contains", "")):
        with pytest.raises(QueryException):
            Col(*bad)


def test_unknown_columns_raise_when_processed(weather):
    with pytest.raises(QueryException):
        Statement().and_where("nope", "=", 1).process(weather)
    with pytest.raises(InvalidArgument):
        weather.select("nope")
    with pytest.raises(InvalidArgument):
        Statement().limit(-2)


def test_projection(weather):
    assert weather.select("place", 0, "place").header() == ["place", "date"]
    assert weather.select_all_except(1).header() == ["date", "place"]
    assert weather.map_header({2: "where", 9: "none"}).first() == {"where": "Galway", "none": None}


@pytest.mark.parametrize(("expression", "n"), [("row=2", 1), ("row=2-4", 3), ("row=5-*", 3), ("row=1", 0), ("ROW=2;4", 2), ("row=5-5", 0), ("row=x", 0)])
def test_row_fragments(weather, expression, n):
    found = weather.matching(expression)
    assert (found[0].count() if found else 0) == n


def test_cell_and_column_fragments(weather):
    assert weather.matching_first("cell=1,2-2,3").to_list() == [{"temperature": "1", "place": "Galway"}, {"temperature": "-1", "place": "Galway"}]
    assert weather.matching_first("col=2-9").header() == ["temperature", "place"]
    assert weather.matching_first("cell=6,1-*").to_list()[0]["date"] == "2011-01-03"
    for bad in ("col=9", "row=2;x", "nope", "row=100"):
        with pytest.raises(FragmentNotFound):
            weather.matching_first_or_fail(bad)


def test_rows_and_folds(weather):
    assert [t.count() for t in weather.chunk_by(4)] == [4, 2]
    assert weather.reduce(lambda n, r: n + int(r["temperature"]), 0) == 19
    assert dict(weather.fetch_pairs("place", "temperature")) == {"Galway": "0", "Berkeley": "5"}
    assert list(weather.fetch_column("temperature")) == ["1", "-1", "0", "6", "8", "5"]
    assert weather.exists(Col("place", "=", "Berkeley")) and not weather.exists(Offset(">", 50)) and weather.value(9) is None


def test_exact_csv(spark):
    parse = lambda text, **d: list(parse_records(text, Dialect(**d)))
    assert parse('a,,b\na\na,""\n\nx') == [["a", "", "b"], ["a"], ["a", ""], [None], ["x"]]
    assert parse('"x\\"y",1') == [['x\\"y', "1"]] and parse('"a""b",c\r\n"d\ne"', escape="") == [['a"b', "c"], ["d\ne"]]
    r = Reader.from_string(spark, "junk\nh1;h2\n1\n\n2;3;4\n").set_delimiter(";").set_header_offset(1)
    assert r.to_table().to_list() == [{"h1": "junk", "h2": None}, {"h1": "1", "h2": None}, {"h1": "2", "h2": "3"}]
    assert r.include_empty_records().to_table().count() == 4
    with pytest.raises(SyntaxProblem):
        Reader.from_string(spark, "a,a\n1,2").set_header_offset(0).to_table()
    for name in ("UTF-8", "UTF-16LE", "UTF-32BE"):
        from sparktab.functions.text import BOMS

        data = BOMS[name] + '"h",é\n1,2'.encode(name)
        assert Reader.from_string(spark, data).set_header_offset(0).header() == ["h", "é"] and Bom.from_sequence(data) == name
    register_filter("up", lambda data, _: data.upper())
    assert Reader.from_string(spark, "a,b").append_filter("up").to_table(["x", "y"]).first() == {"x": "A", "y": "B"}
    assert unregister_filter("up")


def test_writer():
    d = Dialect(escape="")
    assert [format_line(r, d) for r in (["a", "foo bar", "b"], ['So "S"', None, False, True, 1.0], ["x,y", "t\t"])] == ['a,"foo bar",b\n', '"So ""S""",,,1,1\n', '"x,y","t\t"\n']
    w = Writer(d).force_enclosure().set_output_bom("UTF-8").add_formatter(EnumFormatter.using_value())
    w.add_validator(lambda r: len(r) == 2, "two")
    assert w.insert_all([["a", 1], {"x": "b", "y": 2}]) == 16 and w.to_bytes() == b'\xef\xbb\xbf"a","1"\n"b","2"\n'
    with pytest.raises(CannotInsertRecord):
        w.insert_one(["only"])


def test_inference(spark):
    text = "id;name;flag;when;mixed\n1;a;yes;2020-01-01;x\n;b;no;2020-01-02;2\n3;c;;2020-13-40;3\n-7;d;on;2020-01-04;4\n8;e;off;2020-01-05;5\n9;f;1;2020-01-06;6\n"
    table = Reader.from_string(spark, text).set_delimiter(";").set_header_offset(0).to_table()
    schema = table.infer_schema()
    assert schema.types() == {"id": "numeric", "name": "string", "flag": "boolean", "when": "datetime", "mixed": "numeric"}
    rows = schema.parse(table).to_list()
    assert rows[0]["id"] == 1 and rows[1]["id"] is None and rows[2]["when"] is None and rows[0]["mixed"] is None and rows[2]["flag"] is None
    cells = spark.createDataFrame([(x,) for x in ("007", "+5", "5.", ".5", "1e3", "NaN", "Infinity", "5d", " 12 ", "y", "on")], "c string")
    got = [tuple(r) for r in cells.select(NumericField().parse(F.col("c")), BooleanField().parse(F.col("c"))).collect()]
    assert got == [(7.0, None), (5.0, None), (5.0, None), (0.5, None), (1000.0, None), (None, None), (None, None), (None, None), (12.0, None), (None, None), (None, True)]
    with pytest.raises(InvalidArgument):
        Inspector(sample_limit=0)


class Place(enum.Enum):
    GALWAY = "Galway"
    BERKELEY = "Berkeley"


@mapping.record(after_mapping=("seal",))
@dataclasses.dataclass
class Day:
    date: datetime.date
    temperature: int | None
    place: Place = mapping.cell(column="place")
    sealed: bool = mapping.cell(ignore=True, default=False)

    def seal(self):
        self.sealed = True


def test_mapping(weather, spark):
    days = list(weather.as_objects(Day))
    assert days[1] == Day(datetime.date(2011, 1, 2), -1, Place.GALWAY, True) and weather.last_as_object(Day).temperature == 5
    bad = Reader.from_string(spark, "date,temperature,place\n2011-01-01,007,Galway").set_header_offset(0).to_table()
    with pytest.raises(TypeCastingFailed):
        list(bad.as_objects(Day))


def test_buffer(spark, weather):
    b = Buffer.of(weather)
    assert b.delete(Col("place", "=", "Galway")) == 3 and b.first_offset() == 4
    assert b.insert(["2012-01-01", "9", "Cork"], {"place": "Cork", "date": "2012-01-02", "temperature": "10"}) == 2 and b.last_offset() == 8
    assert b.update(Col("place", "=", "Cork"), {"temperature": "0"}) == 2 and b.last() == {"date": "2012-01-02", "temperature": "0", "place": "Cork"}
    b.delete(Offset("=", 5))
    assert b.nth(1) == [] and b.nth(2)["temperature"] == "5"
    with pytest.raises(CannotInsertRecord):
        b.insert(["too", "short"])
    b.truncate()
    assert b.is_empty()


def test_converters(weather):
    two = weather.slice(0, 2)
    assert JsonConverter().encode(two.select("place")) == '[{"place":"Galway"},{"place":"Galway"}]' and JsonConverter().encode([]) == "[]"
    assert JsonConverter().with_force_object().encode([{"a": "é/"}]) == '{"0":{"a":"\\u00e9\\/"}}'
    assert JsonConverter("ndjson_header").encode(two.select("date", "place")) == '["date","place"]\n["2011-01-01","Galway"]\n["2011-01-02","Galway"]\n'
    assert XmlConverter().record_element("row", "n").encode([{"a": None, "b": "<"}]) == '<csv><row n="0"><cell /><cell>&lt;</cell></row></csv>'
    assert HtmlConverter().convert([["a"]], ["h"]) == '<table class="table-csv-data"><thead><tr><th scope="col">h</th></tr></thead><tbody><tr><td>a</td></tr></tbody></table>'


def test_cursor(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create table u (id integer, name text)")
    db.executemany("insert into u values (?, ?)", [(1, "a"), (2, None)])
    assert rdbms.from_cursor(spark, db.execute("select * from u")).to_list() == [{"id": 1, "name": "a"}, {"id": 2, "name": None}]


def test_plain_comparisons_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    t = Table.from_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet")
    plan = Statement().and_where("l_quantity", "between", [10, 20]).and_where("l_returnflag", "=", "R").process(t).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "EqualNullSafe(l_returnflag,R)" in plan


@pytest.mark.parametrize("options", [{}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}, {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}])
@pytest.mark.parametrize(("name", "key"), [("orders", "o_orderkey"), ("lineitem", "l_orderkey, l_extendedprice")])
def test_offsets_keep_every_row(spark, options, name, key):
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        path = f"/root/testdata/sf0.1/{name}.parquet"
        table = Table.from_parquet(spark, path, key.split(", ")).with_offset()
        columns = ", ".join(table.columns)
        got = table.df.agg(F.count("*"), F.count_distinct(OFFSET), F.min(OFFSET), F.max(OFFSET), F.sum(F.pmod(F.col(OFFSET) * F.col(table.columns[0]), F.lit(1_000_003)))).first()
        want = duckdb.sql(f"select count(*), count(distinct rn), min(rn), max(rn), sum((rn * {table.columns[0]}) % 1000003)::bigint from (select {columns}, row_number() over (order by {key}) - 1 as rn from '{path}')").fetchall()[0]
        assert tuple(got) == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _twisted(r, quote, sep, esc, n):
    """A document of n records with quoted fields of several lines, stray enclosures, blank lines and returns."""
    out = []
    for _ in range(n):
        cells = []
        for _ in range(r.randint(1, 4)):
            body = "".join(r.choice(["a", "é", " ", "\n", sep, quote + quote, esc + "x" if esc else "b", "\r\n"]) for _ in range(r.randint(0, 12)))
            plain = "".join(c for c in body if c not in "\r\n" + quote + sep + esc)
            cells.append(r.choice([quote + body + quote, " " + quote + body + quote + "tail", plain, plain, "x" + quote + plain if plain else "y"]))
        out.append(sep.join(cells) + r.choice(["\n", "\n", "\r\n", "\r", "\n\n"]))
    return "".join(out)


@pytest.mark.parametrize("size", ["100000", "300", "40"])
@pytest.mark.parametrize(("quote", "sep", "esc"), [('"', ",", "\\"), ('"', ";;", ""), ("'", "\t", "'")])
def test_a_file_in_pieces_is_the_whole_file(spark, tmp_path, size, quote, sep, esc):
    import random

    r = random.Random(3)
    dialect = Dialect(delimiter=sep, enclosure=quote, escape=esc)
    texts = [_twisted(r, quote, sep, esc, 60), "\ufeff" + _twisted(r, quote, sep, esc, 30) + "last", "\n", ""]
    want = []
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
        want += [(k, x) for k, x in enumerate(parse_records(text.removeprefix("\ufeff"), dialect))]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        reader = Reader(spark, f"file://{tmp_path}", dialect=dialect)
        assert csv_source.split_records(spark, reader.path, dialect) is not None
        got = [(row[OFFSET], row["__fields"]) for row in reader.raw_records().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_chunks_are_the_bytes(spark, tmp_path):
    data = [b"a,b\n1,2\r\n\n", b"x\xff\n" * 50 + b"no end", b"\n", b""]
    for i, x in enumerate(data):
        (tmp_path / f"{i}.csv").write_bytes(x)
    reader = Reader.from_path(spark, f"file://{tmp_path}")
    for n in (1, 7, 10_000):
        parts = list(reader.chunk(n))
        assert b"".join(parts) == b"".join(data) and all(len(p) == n for p in parts[:-1])


def test_delimiter_stats(spark):
    mixed = "foo;bar;baz\n1|2|3\n4|5|6\n7|8|9\n"
    assert checks.reader_delimiter_stats(Reader.from_string(spark, mixed), ["|", ";", "||"], 5) == {"|": 12, ";": 4, "||": 0}
    limited = Reader.from_string(spark, "foo;bar;hello_world\n42;1,2,3,4,5;true\n")
    assert checks.reader_delimiter_stats(limited, [";", ","]) == {";": 4, ",": 0}
    lines = spark.createDataFrame([('"a;b";c',), ("x",), ('" q ""; z";"w;w";v',)], "value string")
    assert {r.delimiter: r.fields for r in checks.delimiter_stats(lines, [";", ","], -1).collect()} == {";": 7, ",": 0}


def test_offset_attributes_are_record_keys(weather):
    some = weather.filter(Col("place", "=", "Berkeley")).select("place")
    assert XmlConverter().record_element("row", "n").encode(some).count("<row n=") == 3 and '<row n="4">' in XmlConverter().record_element("row", "n").encode(some)
    assert '<tr data-n="6">' in HtmlConverter().tr("data-n").convert(some)
    assert XmlConverter().record_element("row", "n").encode({7: {"a": "x"}}) == '<csv><row n="7"><cell>x</cell></row></csv>'


def test_writer_encoding_and_filters():
    w = Writer(Dialect(escape="")).set_encoding("ISO-8859-15")
    assert w.insert_one(["é€"]) == 3 and w.to_bytes() == b"\xe9\xa4\n" and w.to_string() == "é€\n"
    register_filter("low", lambda data, _: data.lower())
    w.append_filter("low")
    assert w.has_filter("low") and not w.remove_filter("low").has_filter("low") and csv_source.is_registered("low") and csv_source.filter_callback("low")(b"A", None) == b"a"
    assert unregister_filter("low") and not csv_source.is_registered("low")
    headers, body = w.download("é.csv")
    assert headers["Content-Type"] == "text/csv" and body == w.to_bytes()
    headers, body = JsonConverter().download([{"a": 1}], "x.json")
    assert headers["Content-Type"] == "application/json" and body == b'[{"a":1}]'
    with pytest.raises(InvalidArgument):
        JsonConverter().with_depth(1).encode([{"a": {"b": {"c": 1}}}])


@pytest.mark.parametrize("ranked", [100_000, 7])
def test_comparator_sorts_values(spark, monkeypatch, ranked):
    from sparktab.plans import order

    monkeypatch.setattr(order, "RANKED", ranked)
    rows = [{"w": None if i % 11 == 0 else f"{i * 7919 % 50}" + "x" * (i % 3), "i": i} for i in range(120)]
    table = Table.from_records(spark, rows)
    compare = lambda a, b: (a is not None) - (b is not None) if a is None or b is None else len(a) - len(b)
    for direction, turn in (("asc", False), ("desc", True)):
        got = [r["i"] for r in table.sorted(order.CompareOn("w", compare, direction)).records()]
        key = functools.cmp_to_key(lambda a, b: (compare(a["w"], b["w"]) * (-1 if turn else 1)) or a["i"] - b["i"])
        assert got == [r["i"] for r in sorted(rows, key=key)]


def test_closures_get_plain_values(spark, weather):
    assert keys(weather.filter(Where(lambda r, k: r["place"] == "Galway" and k > 1, closure=True))) == [2, 3]
    headerless = Table.from_records(spark, [["a", "b"], ["c"], [None, "d"]])
    assert keys(headerless.filter(Where(lambda r, k: len(r) == 2 and r[0] is None, closure=True))) == [2]
    assert keys(weather.filter(Cols("date", lambda a, b: a.endswith("1") and b[1] == "6", ["place", "temperature"]))) == [4]


def test_distributed_files_are_the_writer_s(spark, tmp_path):
    rows = [{"a": "x y", "b": 'q"q', "c": "p\\\"z"}, {"a": None, "b": "é", "c": "1"}, {"a": "", "b": "l\nm", "c": "\\"}]
    table = Table.from_records(spark, rows)
    for i, (d, more) in enumerate([(Dialect(escape=""), {}), (Dialect(), {}), (Dialect(eol="\r\n", delimiter=";", enclosure="'"), {}), (Dialect(escape="", encoding="ISO-8859-1"), {}), (Dialect(escape=""), {"bom": "UTF-8"})]):
        for policy, name in (("necessary", "necessary_enclosure"), ("all", "force_enclosure"), ("none", "no_enclosure")):
            path = f"{tmp_path}/{i}{policy}"
            write_csv(table, f"file://{path}", d, policy, header=True, single=True, **more)
            w = getattr(Writer(d), name)().set_output_bom(more.get("bom"))
            w.insert_all([table.columns, *rows])
            assert b"".join(p.read_bytes() for p in sorted(pathlib.Path(path).glob("part-*"))) == w.to_bytes()
    write_csv(table.filter(Col("a", "=", "none")), f"file://{tmp_path}/empty", Dialect(escape=""), header=True, single=True)
    assert b"".join(p.read_bytes() for p in pathlib.Path(f"{tmp_path}/empty").glob("part-*")) == b"a,b,c\n"
    with pytest.raises(Exception, match="rejected by `one`"):
        write_csv(table, f"file://{tmp_path}/bad", validators={"one": lambda t: F.col("c") == "1"})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    names = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in names) for r in df.collect()), key=repr)
    r = duck.execute(queries.SQL[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == names
    assert got == sorted((tuple(_norm(x[at.index(c)]) for c in names) for x in r.fetchall()), key=repr)


