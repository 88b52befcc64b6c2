"""Queries of the general data problems (change feeds, small files, drifting schemas) and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.operators import changes, drift, smallfiles
from lodevec.session import cut_lineage, remove_folder, shared_folder, table

INDEX = "ailake_vector_index"  # name of the given table of file entries


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    now = changes.apply_changes(table(spark, d, "read_changes"))
    return now.select("table_key", "id", F.col("_sequence_number").alias("sequence_number"))


def p1_current_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rebuilt rows with their text; the vector is given by its length and the sum of its usable components, as engines print arrays differently."""
    now = changes.apply_changes(table(spark, d, "read_changes"))
    good = F.filter("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30))
    total = F.aggregate(good, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return now.select("table_key", "id", F.col("_sequence_number").alias("sequence_number"), "text", F.size("embedding").cast("long").alias("n_components"), (F.round(total, 4) + 0.0).alias("vector_sum"))


def p4_plan(spark: SparkSession, d: str) -> DataFrame:
    return smallfiles.plan_merge(smallfiles.listed_files(table(spark, d, INDEX)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources of all targets, each target checked: its files lie end to end, without a gap or an overlap."""
    return smallfiles.checked_plan(p4_plan(spark, d)).select("table_key", "path")


def p4_targets(spark: SparkSession, d: str) -> DataFrame:
    """What the merge makes: files, rows and bytes before and after, for each table."""
    plan = smallfiles.checked_plan(p4_plan(spark, d))
    first = F.when(F.col("target_offset") == 0, 1).otherwise(0)
    return plan.groupBy("table_key").agg(
        F.count(F.lit(1)).alias("files_before"), F.sum(first).alias("files_after"), F.sum("record_count").alias("n_rows"), F.sum("file_size_bytes").alias("n_bytes")
    )


def p4_merge(spark: SparkSession, d: str) -> DataFrame:
    """The merge itself, over the records at hand: the records of each file of ``raw_ingest`` are written as a small file of lines, the files of each table are planned and
    joined byte by byte against their listed bytes and lines, and each target is counted: lines and bytes before and after."""
    root = f"{shared_folder(spark)}/lines/{uuid.uuid4().hex}"
    rows = table(spark, d, "raw_ingest").where("record is not null").select("table_key", "path", "row_no", "record")
    listed = smallfiles.write_lines(rows, root).select("table_key", "path", "record_count", "file_size_bytes", F.lit(None).cast("string").alias("partition_value"), F.lit(True).alias("active"))
    plan = smallfiles.plan_merge(cut_lineage(listed))
    before = plan.groupBy("table_key").agg(F.count(F.lit(1)).alias("files_before"), F.sum("record_count").alias("lines_before"), F.sum("file_size_bytes").alias("bytes_before"))
    done = cut_lineage(smallfiles.merge_files(plan, root, f"{root}/merged", count_lines=True))
    after = done.groupBy("table_key").agg(F.count(F.lit(1)).alias("files_after"), F.sum("lines").alias("lines_after"), F.sum("bytes").alias("bytes_after"))
    out = cut_lineage(before.join(after, "table_key"))
    remove_folder(spark, root)
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "file_schema")).select("table_key", "path", "change_kind", "field_name")


def _vector_fields(spark: SparkSession, d: str) -> DataFrame:
    index = smallfiles.listed_files(table(spark, d, INDEX).select("table_key", "path", "vector_column"))
    return index.where(F.col("table_key").endswith(".docs_ingest"))


def p6_union_schema(spark: SparkSession, d: str) -> DataFrame:
    return drift.union_schema(table(spark, d, "file_schema"), _vector_fields(spark, d))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """Every record in one table; the vector field is the one that the file entries name."""
    return drift.read_drifting(table(spark, d, "file_schema"), table(spark, d, "raw_ingest"), _vector_fields(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_current_rows, p4_found, p4_plan, p4_targets, p4_merge, p6_found, p6_union_schema, p6_table)
}

_NOW = """
with k as (
  select *, case when t in ('+i') then 'insert' when t = '-d' then 'delete' when t = '-u' then 'update_before'
    when t = '+u' then 'update_after' else regexp_replace(t, '[\\s-]+', '_', 'g') end kind
  from (select *, lower(trim(_change_type)) t from read_changes)),
s as (select table_key, _snapshot_id, max(_sequence_number) seq from k where _snapshot_id is not null group by all),
r as (
  select k.table_key, k.id, k.kind, coalesce(k._sequence_number, s.seq) seq, k.arrival_no, k.text, k.embedding
  from k left join s on k.table_key is not distinct from s.table_key and k._snapshot_id = s._snapshot_id
  where kind in ('insert', 'delete', 'update_after')),
w as (
  select *, row_number() over (partition by table_key, id
    order by seq desc nulls last, (kind = 'delete') asc, arrival_no desc nulls last) rn from r),
now as (select table_key, id, seq sequence_number, text, embedding from w where rn = 1 and kind <> 'delete')
"""

_SMALL = """
with f as (
  select distinct table_key, partition_value, file_size_bytes, record_count,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(url_decode(replace(path, '+', '%2B')),
      '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?', ''), '(^|/)(\\./)+', '\\1', 'g'), '/+', '/', 'g'), '^/?(warehouse/)?', '') path
  from ailake_vector_index
  where active and file_size_bytes > 0 and file_size_bytes < 16777216),
g as (select table_key, partition_value from f group by all having count(*) >= 2),
small as (
  select f.* from f join g on f.table_key is not distinct from g.table_key
    and f.partition_value is not distinct from g.partition_value)
"""

# the order within a group is by size only where the group is one part, as all are here
_TARGETS = _SMALL + """,
b as (select *, coalesce(sum(file_size_bytes) over (partition by table_key, partition_value order by file_size_bytes desc, path rows between unbounded preceding and 1 preceding), 0) before from small),
bins as (select *, before // 134217728 bin from b),
final as (select *, case when count(*) over (partition by table_key, partition_value, bin) = 1 and bin > 0 then bin - 1 else bin end t from bins)
"""

_FIELDS = """
with spell(a, b) as (values ('int','int'),('integer','int'),('int32','int'),('long','long'),('bigint','long'),('int64','long'),
  ('float','float'),('float32','float'),('double','double'),('float64','double'),('string','string'),('utf8','string'),
  ('varchar','string'),('boolean','boolean'),('bool','boolean'),('timestamp','timestamp'),('datetime','timestamp'),
  ('list<float>','list<float>'),('list<float32>','list<float>'),('array<float>','list<float>')),
once as (select table_key, path, sequence_number, any_value(schema_json) js from file_schema group by table_key, path, sequence_number),
files as (select *, row_number() over (partition by table_key order by sequence_number, path) no from once),
fl as (
  select table_key, path, no, cast(f->>'id' as int) id, lower(f->>'name') name, lower(f->>'type') raw
  from (select *, unnest(cast(js::json->'fields' as json[])) f from files)),
e as (select fl.*, coalesce(spell.b, raw) type from fl left join spell on raw = spell.a),
ids as (select table_key, no, bool_and(id is not null) has from e group by all),
pr as (
  select a.table_key, a.path, a.no, (x.has and y.has) by_id from files a
  join ids x on x.table_key = a.table_key and x.no = a.no
  join ids y on y.table_key = a.table_key and y.no = a.no - 1),
cur as (select pr.*, e.id, e.name, e.type, case when by_id then cast(e.id as varchar) else e.name end k from pr join e using (table_key, no)),
old as (select pr.*, e.id, e.name, e.type, case when by_id then cast(e.id as varchar) else e.name end k from pr join e on e.table_key = pr.table_key and e.no = pr.no - 1)
"""

SQL: dict[str, str] = {
    "p1_found": _NOW + "select table_key, id, sequence_number from now",
    "p1_current_rows": _NOW
    + """
select table_key, id, sequence_number, text, len(embedding) n_components,
  round(coalesce(list_sum(list_filter(embedding, lambda x: x is not null and not isnan(x) and abs(x) < 1e30)::double[]), case when embedding is not null then 0 end), 4) + 0.0 vector_sum from now""",
    "p4_found": _SMALL + "select table_key, path from small",
    "p4_plan": _TARGETS
    + """
select table_key, partition_value, path, file_size_bytes, record_count, t::bigint target_no, (before - min(before) over w)::bigint target_offset, count(*) over w target_files,
  (sum(file_size_bytes) over w)::bigint target_bytes, case when count(record_count) over w = count(*) over w then (sum(record_count) over w)::bigint end target_rows
from final window w as (partition by table_key, partition_value, t)""",
    "p4_targets": _TARGETS
    + """
select table_key, count(*) files_before, count(distinct (partition_value is null, partition_value, t)) files_after, sum(record_count)::bigint n_rows, sum(file_size_bytes)::bigint n_bytes
from final group by all""",
    "p4_merge": """
with w as (
  select table_key, path, count(*) n, sum(strlen(replace(replace(record, chr(13), ' '), chr(10), ' ')) + 1) b from raw_ingest where record is not null group by all)
select table_key, count(*) files_before, sum(n)::bigint lines_before, sum(b)::bigint bytes_before, 1::bigint files_after, sum(n)::bigint lines_after, sum(b)::bigint bytes_after
from w group by all having count(*) >= 2""",
    "p6_found": _FIELDS + """
select table_key, path, 'added' change_kind, name field_name from cur anti join old using (table_key, no, k)
union select table_key, path, 'removed', name from old anti join cur using (table_key, no, k)
union select cur.table_key, cur.path, 'renamed', cur.name from cur join old using (table_key, no, k) where cur.name <> old.name
union select cur.table_key, cur.path, 'type_changed', cur.name from cur join old using (table_key, no, k) where cur.type <> old.type
""",
}
