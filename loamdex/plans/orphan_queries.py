"""Queries of problem 5: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.operators.orphans import index_orphans, orphan_report
from loamdex.sources.tables import table

FIELDS = (("embedding_records", "chunk_id"), ("embedding_records", "site_id"), ("crawl_queue", "site_id"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("sites", "crawl_queue", "indexed_chunks", "chunk_deletions", "embedding_records")
    return index_orphans(*(table(spark, sf_dir, n) for n in names))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct orphans of the three reference fields, once per record."""
    wanted = F.struct("src_table", "src_field").isin([F.struct(F.lit(t), F.lit(f)) for t, f in FIELDS])
    return _orphans(spark, sf_dir).where((F.col("kind") == "direct") & wanted).select("src_table", "src_field", "record_key", "ref_month")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field and month, direct and inherited ones apart, over all foreign keys."""
    return orphan_report(_orphans(spark, sf_dir))


_UUID = r"""case when trim(regexp_replace({c}, '^\s+|\s+$', '', 'g')) = '' then null
 when regexp_matches(replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '^urn:uuid:', ''), '^\{{(.*)\}}$', '\1'), '-', ''), '^[0-9a-f]{{32}}$')
 then replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '^urn:uuid:', ''), '^\{{(.*)\}}$', '\1'), '-', '')
 else '?' || regexp_replace({c}, '^\s+|\s+$', '', 'g') end"""

P5_FOUND_SQL = f"""
with chunk_rows as (select {_UUID.format(c="vector_id")} as k, max(indexed_date) as w from indexed_chunks group by 1),
gone as (select {_UUID.format(c="vector_id")} as k, max(deleted_at) as d from chunk_deletions group by 1),
live as (select chunk_rows.k from chunk_rows left join gone using (k) where d is null or d <= w),
e as (select id, {_UUID.format(c="chunk_id")} as chunk_key, regexp_replace(site_id, '^\\s+|\\s+$', '', 'g') as site_text,
  coalesce(strftime(try_cast(created_at as timestamp), '%Y-%m'), 'unknown') as ref_month from embedding_records)
select distinct 'embedding_records' as src_table, 'chunk_id' as src_field, id as record_key, ref_month from e
 where chunk_key is not null and chunk_key not in (select k from live where k is not null)
union all
select distinct 'embedding_records', 'site_id', id, ref_month from e
 where site_text <> '' and coalesce(try_cast(case when regexp_matches(site_text, '^[+-]?[0-9]+$') then site_text end as hugeint) not in (select id from sites), true)
union all
select distinct 'crawl_queue', 'site_id', cast(id as varchar), coalesce(strftime(created_date, '%Y-%m'), 'unknown') from crawl_queue
 where site_id is not null and site_id not in (select id from sites)
"""

_INTEGER = "case when {c} = '' then null when regexp_matches({c}, '^[+-]?[0-9]+$') then cast(cast({c} as hugeint) as varchar) else '?' || {c} end"

#: Direct orphans of all four keys, and records whose chunk is a row of a missing site: those inherit, unless the reference is a direct orphan itself.
P5_REPORT_SQL = f"""
with chunk_rows as (select {_UUID.format(c="vector_id")} as k, max(indexed_date) as w from indexed_chunks group by 1),
gone as (select {_UUID.format(c="vector_id")} as k, max(deleted_at) as d from chunk_deletions group by 1),
live as (select chunk_rows.k from chunk_rows left join gone using (k) where chunk_rows.k is not null and (d is null or d <= w)),
e as (select id, {_UUID.format(c="chunk_id")} as chunk_key, {_INTEGER.format(c="site_text")} as site_key, month from (select id, chunk_id, regexp_replace(site_id, '^\\s+|\\s+$', '', 'g') as site_text,
  coalesce(strftime(try_cast(created_at as timestamp), '%Y-%m'), 'unknown') as month from embedding_records where id is not null)),
s as (select cast(id as varchar) as k from sites where id is not null),
c as (select cast(id as varchar) as id, {_UUID.format(c="vector_id")} as self, cast(site_id as varchar) as site_key, coalesce(strftime(indexed_date, '%Y-%m'), 'unknown') as month from indexed_chunks where id is not null),
direct as (select 'embedding_records' as t, 'chunk_id' as f, id, chunk_key as ref, month from e where chunk_key is not null and chunk_key not in (select k from live)
 union all select 'embedding_records', 'site_id', id, site_key, month from e where site_key is not null and site_key not in (select k from s)
 union all select 'crawl_queue', 'site_id', cast(id as varchar), cast(site_id as varchar), coalesce(strftime(created_date, '%Y-%m'), 'unknown') from crawl_queue where id is not null and site_id is not null and cast(site_id as varchar) not in (select k from s)
 union all select 'indexed_chunks', 'site_id', id, site_key, month from c where site_key is not null and site_key not in (select k from s)),
one as (select t, f, id, min(ref) as ref, min(month) as month, 'direct' as kind from direct group by t, f, id),
heirs as (select 'embedding_records' as t, 'chunk_id' as f, id, min(chunk_key) as ref, min(month) as month, 'inherited' as kind from e
  where chunk_key in (select self from c where self is not null and site_key is not null and site_key not in (select k from s)) and id not in (select id from one where t = 'embedding_records' and f = 'chunk_id') group by id)
select t as src_table, f as src_field, month as ref_month, count(*) filter (kind = 'direct') as direct_orphans, count(*) filter (kind = 'inherited') as inherited_orphans, count(distinct ref) as missing_keys from (select * from one union all select * from heirs) group by all
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLES = {"p5_found": P5_FOUND_SQL, "p5_report": P5_REPORT_SQL}
