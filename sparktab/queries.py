"""Queries over the driver's tables, one for each operator or small group of them, with their SQL.

Every query runs over whole tables. Row keys are row numbers by primary key, so that both engines
agree on offsets; lineitem's key is (l_orderkey, l_extendedprice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.functions.text import EscapeFormula
from sparktab.operators import inference as I  # noqa: E741, N812
from sparktab.operators.buffer import Buffer
from sparktab.operators.checks import ColumnConsistency, delimiter_stats
from sparktab.operators.mapping import cast_array, cast_bool, cast_date, cast_float, cast_int
from sparktab.plans.order import MultiSort, SortOn
from sparktab.plans.predicate import Col, Cols, Criteria, Offset
from sparktab.plans.statement import Statement
from sparktab.sources.convert import HtmlConverter, JsonConverter, XmlConverter
from sparktab.shared import shared_dir
from sparktab.sources.csv import Dialect, Reader, cell_expression, write_csv
from sparktab.table import OFFSET, Table

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYS = {"lineitem": ["l_orderkey", "l_extendedprice"], "orders": ["o_orderkey"], "part": ["p_partkey"], "customer": ["c_custkey"], "events": ["event_id"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"]}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: Table.from_parquet(spark, f"{sf_dir}/{t}.parquet", KEYS.get(t)))
        if sql:
            SQL[name] = sql
        return f

    return keep


def _where(name: str, table: str, columns: str, statement: Statement, sql: str) -> None:
    names = [c.strip() for c in columns.split(",")]
    query(name, f"select {columns} from {table} where {sql}")(lambda t: statement.select(*names).process(t(table)).df)


_S = Statement()
_LINE = "l_orderkey, l_linenumber, l_quantity, l_extendedprice"
_PART = "p_partkey, p_name, p_brand, p_type"
_where("q_eq", "orders", "o_orderkey, o_orderstatus", _S.and_where("o_orderstatus", "=", "F"), "o_orderstatus = 'F'")
_where("q_neq", "orders", "o_orderkey, o_orderstatus", _S.and_where("o_orderstatus", "<>", "F"), "o_orderstatus <> 'F'")
_where("q_gt_ge_lt_le", "lineitem", _LINE, _S.and_where("l_quantity", ">=", 10).and_where("l_quantity", "lt", 20).and_where("l_extendedprice", ">", 1000).and_where("l_linenumber", "<=", 4), "l_quantity >= 10 and l_quantity < 20 and l_extendedprice > 1000 and l_linenumber <= 4")
_where("q_between", "lineitem", _LINE, _S.and_where("l_quantity", "between", [10, 20]), "l_quantity between 10 and 20")
_where("q_nbetween", "lineitem", _LINE, _S.and_where("l_quantity", "not between", [5, 45]), "l_quantity not between 5 and 45")
_where("q_in", "part", _PART, _S.and_where("p_size", "in", [1, 5, 9, 14]), "p_size in (1, 5, 9, 14)")
_where("q_nin", "part", _PART, _S.and_where("p_size", "not in", [1, 5, 9, 14]), "p_size not in (1, 5, 9, 14)")
_where("q_contains", "part", _PART, _S.and_where("p_type", "contains", "S"), "contains(p_type, 'S')")
_where("q_ncontain", "part", _PART, _S.and_where("p_type", "does not contain", "S"), "not contains(p_type, 'S')")
_where("q_starts", "part", _PART, _S.and_where("p_type", "starts with", "S"), "starts_with(p_type, 'S')")
_where("q_ends", "part", _PART, _S.and_where("p_name", "ends with", "bolt"), "suffix(p_name, 'bolt')")
_where("q_regexp", "part", _PART, _S.and_where("p_name", "regexp", "/^(LARGE|cold) .*t$/i"), "regexp_matches(p_name, '(?i)^(LARGE|cold) .*t$')")
_where("q_nregexp", "part", _PART, _S.and_where("p_name", "not regexp", "/t$/"), "not regexp_matches(p_name, 't$')")
_where("q_or", "orders", "o_orderkey, o_orderstatus, o_totalprice", _S.and_where("o_orderstatus", "=", "F").and_where("o_totalprice", "<", 50000).or_where("o_totalprice", ">", 300000), "(o_orderstatus = 'F' and o_totalprice < 50000) or o_totalprice > 300000")
_where("q_xor", "orders", "o_orderkey, o_orderstatus, o_totalprice", _S.and_where("o_orderstatus", "=", "F").xor_where("o_totalprice", ">", 100000), "(o_orderstatus = 'F') <> (o_totalprice > 100000)")
_where("q_not_first", "orders", "o_orderkey, o_orderstatus", _S.where_not("o_orderstatus", "=", "F"), "not (o_orderstatus = 'F')")
_where("q_not_chain", "orders", "o_orderkey, o_orderstatus, o_totalprice", _S.and_where("o_orderstatus", "=", "F").where_not("o_totalprice", ">", 100000), "not (o_orderstatus = 'F') and not (o_totalprice > 100000)")
_A, _B = Col("o_orderstatus", "=", "F"), Col("o_totalprice", ">", 100000)
for _n, _c, _q in (
    ("q_all", Criteria.all(_A, _B), "a and b"), ("q_any", Criteria.any(_A, _B), "a or b"), ("q_none", Criteria.none(_A, _B), "not (a or b)"), ("q_xany", Criteria.xany(_A, _B), "a <> b"),
    ("q_and_not", Criteria.all(_A).and_not(_B), "a and not b"), ("q_or_not", Criteria.all(_A).or_not(_B), "a or not b"), ("q_xor_not", Criteria.all(_A).xor_not(_B), "a <> (not b)"),
):
    _where(_n, "(select *, o_orderstatus = 'F' as a, o_totalprice > 100000 as b from orders)", "o_orderkey, o_orderstatus, o_totalprice", _S, _q)
    QUERIES[_n] = lambda spark, d, c=_c: _S.where(c).select("o_orderkey", "o_orderstatus", "o_totalprice").process(Table.from_parquet(spark, f"{d}/orders.parquet")).df
_where("q_two_columns", "lineitem", "l_orderkey, l_extendedprice, l_linenumber, l_quantity", _S.and_where_column("l_linenumber", ">", "l_quantity"), "l_linenumber > l_quantity")
_where("q_two_columns_between", "lineitem", "l_orderkey, l_extendedprice, l_linenumber", _S.where(Cols("l_quantity", "between", ["l_linenumber", "l_suppkey"])), "l_quantity between l_linenumber and l_suppkey")
_where("q_two_columns_in", "orders", "o_orderkey, o_custkey", _S.where(Cols("o_custkey", "in", ["o_orderkey"])), "o_custkey in (o_orderkey)")


@query("q_strict_type_mismatch", "select count(*) filter (where false) as equal, count(*) as other from orders")
def _strict(t):
    orders = t("orders")
    a, b = Col("o_orderstatus", "=", 1), Col("o_orderstatus", "!=", 1)
    return orders.df.agg(F.count_if(a.total(orders).column()).alias("equal"), F.count_if(b.total(orders).column()).alias("other"))


@query("q_loose_text", "select l_orderkey, l_extendedprice, l_quantity::integer::varchar as n from lineitem where l_quantity < 9")
def _loose(t):
    table = Table(t("lineitem").df.select("l_orderkey", "l_extendedprice", F.col("l_quantity").cast("int").cast("string").alias("n")))
    return _S.and_where("n", "<", "9").process(table).df


_RN = "(select *, row_number() over (order by {key}) - 1 as rn from {table})"
_ORD = _RN.format(key="o_orderkey", table="orders")


@query("q_where_offset", f"select o_orderkey, rn from {_ORD} where rn < 100 or rn between 500 and 520")
def _where_offset(t):
    table = _S.and_where_offset("<", 100).or_where_offset("between", [500, 520]).process(t("orders"))
    return table.df.select("o_orderkey", F.col(OFFSET).alias("rn"))


@query("q_offset_parity", f"select o_orderkey, rn from {_ORD} where rn % 2 = 0")
def _parity(t):
    table = t("orders").filter(Offset(lambda k: k % 2 == 0))
    return table.df.select("o_orderkey", F.col(OFFSET).alias("rn"))


_FLAG = _S.and_where("l_returnflag", "=", "R").and_where("l_quantity", "between", [10, 20]).order_by_desc("l_extendedprice").order_by_asc("l_orderkey").limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("q_topk", "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_returnflag = 'R' and l_quantity between 10 and 20 order by l_extendedprice desc, l_orderkey limit 25")
def _topk(t):
    return _FLAG.process(t("lineitem")).df


@query("q_multisort", "select c_custkey, c_mktsegment, row_number() over (order by c_mktsegment desc, c_nationkey, c_acctbal, c_custkey) as place from customer order by place limit 50")
def _multisort(t):
    keys = MultiSort.all(SortOn("c_nationkey"), SortOn("c_acctbal"), SortOn("c_custkey")).prepend(SortOn("c_mktsegment", "desc"))
    top = t("customer").sorted(keys).slice(0, 50).df
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("c_mktsegment"), "c_nationkey", "c_acctbal", "c_custkey"))  # over 50 rows
    return top.select("c_custkey", "c_mktsegment", place.alias("place"))


@query("q_offset_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 40 offset 100")
def _offset_limit(t):
    return _S.order_by_asc("o_totalprice").order_by_asc("o_orderkey").offset(100).limit(40).select("o_orderkey", "o_totalprice").process(t("orders")).df


@query("q_select_mixed", "select o_totalprice, o_orderkey, o_orderstatus from orders")
def _select(t):
    return t("orders").select("o_totalprice", 0, "o_orderstatus", 2).df


@query("q_select_except", "select * exclude (c_name, c_acctbal) from customer")
def _except(t):
    return t("customer").select_all_except("c_name", 3).df


@query("q_map_header", "select c_mktsegment as segment, c_custkey as id, null::varchar as missing from customer")
def _map_header(t):
    return t("customer").map_header({4: "segment", 0: "id", 33: "missing"}).df


@query("q_chunk_by", f"select rn // 1000 as chunk, count(*) as n, min(o_orderkey) as first_key from {_ORD} group by 1")
def _chunk(t):
    return t("orders").chunk_id(1000).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("q_fetch_column_nonnull", "select nullif(p_brand, 'Brand#11') as value from part where nullif(p_brand, 'Brand#11') is not null")
def _fetch(t):
    return Table(t("part").df.select(F.nullif(F.col("p_brand"), F.lit("Brand#11")).alias("b"))).column("b")


@query("q_fetch_pairs", "select n_name as key, n_regionkey as value from nation where n_name is not null")
def _pairs(t):
    return t("nation").pairs("n_name", "n_regionkey")


for _name, _order, _f in (("q_first", "o_orderkey limit 1", lambda t: t.slice(0, 1)), ("q_last", "o_orderkey desc limit 1", lambda t: t.sorted(SortOn("o_orderkey", "desc")).slice(0, 1)), ("q_nth", "o_orderkey limit 1 offset 42", lambda t: t.slice(42, 1))):
    query(_name, f"select o_orderkey, o_custkey, o_totalprice from orders order by {_order}")(lambda t, f=_f: f(t("orders")).select("o_orderkey", "o_custkey", "o_totalprice").df)


@query("q_value", "select o_totalprice as value from orders order by o_orderkey limit 1")
def _value(t):
    return t("orders").slice(0, 1).column("o_totalprice")


@query("q_reduce_sum", "select sum(l_linenumber)::bigint as total, count(*) as n, max(l_quantity) as most from lineitem")
def _reduce(t):
    return t("lineitem").aggregate(total=F.sum("l_linenumber"), n=F.count("*"), most=F.max("l_quantity"))


@query("q_exists", "select bool_or(o_totalprice > 100000) as some, bool_or(o_totalprice < 0) as no from orders")
def _exists(t):
    orders = t("orders")
    return orders.aggregate(some=F.bool_or(Col("o_totalprice", ">", 100000).total(orders).column()), no=F.bool_or(Col("o_totalprice", "<", 0).total(orders).column()))


@query("q_count", "select count(*) as n from lineitem where l_returnflag = 'A'")
def _count(t):
    return t("lineitem").filter(Col("l_returnflag", "=", "A")).aggregate(n=F.count("*"))


@query("q_frag_row", f"select o_orderkey from {_ORD} where rn between 4 and 9 or rn = 20 or rn >= 1000")
def _frag_row(t):
    return t("orders").matching("row=5-10;21;1001-*")[0].df.select("o_orderkey")


@query("q_frag_col", "select n_nationkey, n_regionkey from nation")
def _frag_col(t):
    return t("nation").matching("col=1;3-9")[0].df


@query("q_frag_cell", f"select o_custkey, o_orderstatus from {_ORD} where rn between 1 and 11")
def _frag_cell(t):
    return t("orders").matching("cell=2,2-12,3")[0].df




@query("q_infer_numeric", "select p_partkey, try_cast(p_size::varchar as bigint) as size, try_cast(p_retailprice::varchar as double) as price, null::double as name from part")
def _infer_numeric(t):
    df = t("part").df
    n, w = I.NumericField(), I.NumericField(as_long=True)
    return df.select("p_partkey", w.parse(F.col("p_size").cast("string")).alias("size"), n.parse(F.col("p_retailprice").cast("string")).alias("price"), n.parse(F.col("p_name")).alias("name"))


@query("q_infer_bool", "select p_partkey, case p_size % 5 when 0 then true when 1 then false when 2 then true when 3 then false else null end as flag from part")
def _infer_bool(t):
    word = F.element_at(F.array(*map(F.lit, ("yes", "0", " On", "OFF ", "maybe"))), (F.col("p_size") % 5 + 1).cast("int"))
    return t("part").df.select("p_partkey", I.BooleanField().parse(word).alias("flag"))


@query("q_infer_time", "select event_id, strftime(ts, '%H:%M:%S') as time, case when event_id % 24 < 24 then lpad((event_id % 24)::varchar, 2, '0') || ':' || lpad((event_id % 60)::varchar, 2, '0') end as short from events")
def _infer_time(t):
    e = F.col("event_id")
    return t("events").df.select("event_id", I.TimeField().parse(F.concat_ws(":", F.hour("ts"), F.minute("ts"), F.second("ts"))).alias("time"), I.TimeField().parse(F.concat_ws(":", e % 24, e % 60)).alias("short"))


@query("q_infer_datetime", "select o_orderkey, o_orderdate::timestamp as at, null::timestamp as bad from orders")
def _infer_date(t):
    field = I.DateTimeField("Y-m-d H:i:s")
    return t("orders").df.select("o_orderkey", field.parse(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("at"), field.parse(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("bad"))


@query("q_infer_uuid", "select event_id, substr(md5(event_id::varchar), 1, 8) || '-' || substr(md5(event_id::varchar), 9, 4) || '-' || substr(md5(event_id::varchar), 13, 4) || '-' || substr(md5(event_id::varchar), 17, 4) || '-' || substr(md5(event_id::varchar), 21) as id, md5(event_id::varchar) as digest from events")
def _infer_uuid(t):
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return t("events").df.select("event_id", I.StringField.uuid().parse(F.concat_ws("-", *parts)).alias("id"), I.StringField.md5().parse(h).alias("digest"))


@query("q_infer_types", "select * from (values ('event_id', 'numeric'), ('ts', 'datetime'), ('event_type', 'string'), ('value', 'numeric'), ('props', 'json')) v(name, type)")
def _infer_types(t):
    df = t("events").df.select(F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", F.col("value").cast("string").alias("value"), "props", F.col("event_id").alias("k"))
    table = Table(df, order_key=["k"])
    types = table.infer_schema(I.Inspector(sample_limit=50)).types()
    return df.sparkSession.createDataFrame([(n, x) for n, x in types.items() if n != "k"], "name string, type string")


@query("q_json_field", "select event_id, props is not null as ok, json_extract(props, '$.k')::int as k from events")
def _json(t):
    return t("events").df.select("event_id", I.JsonField().parse(F.col("props")).isNotNull().alias("ok"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("q_set_field", "select p_partkey, array_to_string(list_filter(list_distinct_ordered, lambda x: x in ('large', 'small', 'bolt')), '|') as kept from (select p_partkey, string_split(p_name, ' ') as list_distinct_ordered from part) where len(list_filter(list_distinct_ordered, lambda x: x in ('large', 'small', 'bolt'))) > 0")
def _set(t):
    kept = I.SetField(["large", "small", "bolt"], " ").parse(F.col("p_name"))
    return t("part").df.select("p_partkey", F.array_join(kept, "|").alias("kept")).where("kept is not null")


@query("q_enum_field", "select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment end as segment from customer")
def _enum(t):
    return t("customer").df.select("c_custkey", I.EnumField(["BUILDING", "MACHINERY"]).parse(F.col("c_mktsegment")).alias("segment"))


@query("q_string_length", "select p_partkey, case when length(trim(p_name)) between 5 and 8 then trim(p_name) end as short from part")
def _length(t):
    return t("part").df.select("p_partkey", I.StringField(5, 8).parse(F.col("p_name")).alias("short"))


@query("q_cast_array", "select p_partkey, len(string_split(p_name, ' ')) as n, string_split(p_name, ' ')[1] as first_word from part")
def _array(t):
    parts = cast_array(F.col("p_name"), "p_name", separator=" ")
    return t("part").df.select("p_partkey", F.size(parts).alias("n"), parts[0].alias("first_word"))


@query("q_cast_strict", "select o_orderkey, o_custkey as cust, o_totalprice as price, o_orderstatus = '1' as flag, o_orderdate::timestamp as at from orders")
def _cast(t):
    s = lambda c: F.col(c).cast("string")
    return t("orders").df.select("o_orderkey", cast_int(s("o_custkey"), "cust").alias("cust"), cast_float(s("o_totalprice"), "price").alias("price"), cast_bool(F.col("o_orderstatus"), "flag").alias("flag"), cast_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "at", format="Y-m-d H:i:s").alias("at"))


_RISKY = "case p_partkey % 4 when 0 then '=' || p_name when 1 then '''' || p_name when 2 then '@' || p_name else p_name end"
_RISKY_F = lambda: F.concat(F.element_at(F.array(*map(F.lit, ("=", "'", "@", ""))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_name"))


@query("q_escape_formula", f"select p_partkey, case when p_partkey % 4 < 3 then '''' || x else x end as cell from (select p_partkey, {_RISKY} as x from part)")
def _escape(t):
    return EscapeFormula().escape_records(t("part").df.select("p_partkey", _RISKY_F().alias("cell")))


@query("q_unescape_formula", f"select p_partkey, {_RISKY} as cell from part")
def _unescape(t):
    e = EscapeFormula()
    return e.unescape_records(e.escape_records(t("part").df.select("p_partkey", _RISKY_F().alias("cell"))))


@query("q_column_consistency", "select p_partkey, len(string_split(p_name, ' ')) = 2 as two from part")
def _consistency(t):
    return t("part").df.select("p_partkey", ColumnConsistency(2).expression(F.split("p_name", " ")).alias("two"))


_FIELDS = "sum(case when len(string_split(p_name, '{d}')) > 1 then len(string_split(p_name, '{d}')) + 1 else 0 end)::bigint"


@query("q_delimiter_stats", f"select ' ' as delimiter, {_FIELDS.format(d=' ')} as fields from part union all select ';', {_FIELDS.format(d=';')} from part union all select '||', 0")
def _delimiters(t):
    return delimiter_stats(t("part").df, [" ", ";", "||"], -1, "p_name")


@query("q_to_ndjson", """select n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as line from nation""")
def _ndjson(t):
    nation = t("nation")
    return nation.df.select("n_nationkey", JsonConverter("ndjson").expression(nation).alias("line"))


@query("q_to_html_rows", "select n_nationkey, '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td><td>' || n_regionkey || '</td></tr>' as line from nation")
def _html(t):
    nation = t("nation")
    return nation.df.select("n_nationkey", HtmlConverter().expression(nation).alias("line"))


@query("q_to_xml_rows", "select n_nationkey, '<row><cell>' || n_nationkey || '</cell><cell>' || n_name || '</cell><cell>' || n_regionkey || '</cell></row>' as line from nation")
def _xml(t):
    nation = t("nation")
    return nation.df.select("n_nationkey", XmlConverter().expression(nation).alias("line"))


@query("q_csv_cells", """select p_partkey, case when contains(p_name, ' ') then '"' || p_name || '"' else p_name end as cell from part""")
def _cells(t):
    part = t("part")
    return part.df.select("p_partkey", cell_expression(F.col("p_name"), part.df.schema["p_name"].dataType, Dialect(escape="")).alias("cell"))


@query("q_csv_roundtrip", "select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as c_nationkey, c_mktsegment from customer")
def _roundtrip(t):
    table = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = shared_dir(table.df.sparkSession)
    write_csv(table, path, Dialect(escape=""))
    return Reader.from_path(table.df.sparkSession, path).set_escape("").fast().to_table(table.columns).df


@query("q_csv_exact", "select n_nationkey::varchar as a, n_name as b, '' as c from nation")
def _exact(t):
    table = t("nation")
    df = table.df.select(F.concat(F.col("n_nationkey"), F.lit(',"'), F.col("n_name"), F.lit('",')).alias("value"))
    path = shared_dir(df.sparkSession)
    df.write.text(path)
    return Reader.from_path(df.sparkSession, path).to_table(["a", "b", "c"]).df.select("a", "b", "c")


@query("q_buffer_insert", "select n_nationkey, n_name, n_regionkey from nation union all select 99, 'ATLANTIS', 9")
def _insert(t):
    b = Buffer.of(t("nation"))
    b.insert({"n_nationkey": 99, "n_name": "ATLANTIS", "n_regionkey": 9})
    return b.table.df.select("n_nationkey", "n_name", "n_regionkey")


@query("q_buffer_update", "select c_custkey, case when c_acctbal < 0 then 'DEBT' else c_mktsegment end as c_mktsegment from customer")
def _update(t):
    b = Buffer.of(t("customer"))
    b.update(Col("c_acctbal", "<", 0), {"c_mktsegment": "DEBT"}, count=False)
    return b.table.df.select("c_custkey", "c_mktsegment")


@query("q_buffer_delete", f"select o_orderkey, rn as offset_kept from {_ORD} where not o_orderstatus = 'F'")
def _delete(t):
    b = Buffer.of(t("orders"))
    b.delete(Col("o_orderstatus", "=", "F"), count=False)
    return b.table.df.select("o_orderkey", F.col(OFFSET).alias("offset_kept"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_topk"](spark, sf_dir)


