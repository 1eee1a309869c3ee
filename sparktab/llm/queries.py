"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.llm import decontam, langid, license, ngramlm, packing, quality, sharding, simhash, substring, tokenstore

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), PIECES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no file names; source and language stand for folders, and a licence file is one that a template covers."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license.scan(table(spark, sf_dir, "documents"), "doc_id", path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_and_index(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_ngramlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_langid, op3_quality, op4_license, op5_sharding, op6_substring, op7_decontam, op8_packing, op9_tokenstore, op10_ngramlm)}

_WORD = r"[^\x20\x09-\x0D]+"

OP3_SQL = rf"""
with t as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
tri as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from t where len(w) >= 3),
win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from tri),
often as (select doc_id, g from win group by 1, 2 having count(*) > 1),
rep as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select win.doc_id, unnest([i, i + 1, i + 2]) as p from win join often using (doc_id, g)) group by 1),
line as (select doc_id, unnest(string_split(text, chr(10))) as l from t),
dup as (
  select doc_id, sum(c - 1) as n_dup_lines
  from (select doc_id, l, count(*) as c from line where regexp_matches(l, '{_WORD}') group by 1, 2) group by 1),
base as (
  select t.doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from t left join dup using (doc_id) left join rep using (doc_id)),
judged as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from base),
host as (select source, count(*)::double as n, sum(base_failed::int)::double as f from judged group by 1),
sums as (select sum(n) as n, sum(f) / sum(n) as m, sum(f * f / n) as sq, count(*) as h, sum(n) - sum(n * n) / sum(n) as spread from host),
vary as (select n, m, case when spread > 0 then (sq - n * m * m - m * (1 - m) * (h - 1)) / spread else 0 end as b from sums),
prior as (select m, case when b > 0 then least(greatest(m * (1 - m) / b - 1, 0), n) else n end as s from vary),
rate as (select source, (f + m * s) / (host.n + s) as r, host.n + s as total from host, prior),
verdict as (select source, r - {quality.HOST_MARGIN} * sqrt(r * (1 - r) / (total + 1)) > {quality.HOST_RATE} as rejected from rate)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept
from judged join verdict on judged.source is not distinct from verdict.source
"""


def op5_sql() -> str:
    names = [f"shard-{i:05d}" for i in range(sharding.SHARDS)]
    slots = ",".join(map(str, sharding.fill(names)))
    return f"""
with place as (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.SLOTS})::integer as slot from documents),
filled as (select unnest(range({sharding.SLOTS}))::integer as slot, unnest(string_split('{slots}', ','))::integer as shard)
select doc_id, slot, shard from place join filled using (slot)
"""


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7_SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') as w from benchmark where text is not null),
test as (
  select item_id, j, least(len(w), {decontam.WINDOW}) as n, array_to_string(w[j : j + least(len(w), {decontam.WINDOW}) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - {decontam.WINDOW - 1}, 1) + 1)) as j from b where len(w) > 0)),
sizes as (select distinct n from test),
win as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select doc_id, item_id::varchar as item, i, j, test.n from win join test using (n, g)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as joined from (select distinct doc_id, item from hit) group by 1),
-- windows that follow each other in both texts are one match
step as (select *, i - row_number() over (partition by doc_id, item, i - j order by i) as k from hit),
match as (select doc_id, item, count(*) + max(n) - 1 as words, min(i) - 1 as start from step group by doc_id, item, i - j, k),
best as (select * from (select *, row_number() over (partition by doc_id order by words desc, start, item) as place from match) where place = 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(joined, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(words, 0)::bigint as longest, start::bigint as longest_start, item as longest_item
from d left join words using (doc_id) left join items using (doc_id) left join best using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": OP3_SQL, "op5_sharding": op5_sql(), "op7_decontam": OP7_SQL}
