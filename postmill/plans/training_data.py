"""Queries of the general operators for training-data tables: p1 and p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.bounds import small_side
from postmill.operators.snapshots import snapshot_changes
from postmill.operators.timestamps import resolve_instants


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(spark.read.parquet(f"{d}/slice_rows.parquet"))


def _time_values(spark: SparkSession, d: str) -> DataFrame:
    sources = small_side(spark.read.parquet(f"{d}/ats_sources.parquet").select(F.lower("ats_type").alias("s"), F.coalesce("tz_name", F.lit("UTC")).alias("tz"), F.col("date_order")))
    raw = spark.read.parquet(f"{d}/raw_jobs.parquet").select(F.lit("posted_at").alias("field_name"), F.col("row_id").cast("string").alias("rec_key"), F.col("posted_at").alias("value"), F.lower("ats_type").alias("s"))
    raw = raw.join(sources, "s", "left").select("field_name", "rec_key", "value", F.concat(F.lit("posted_at:"), F.coalesce("s", F.lit(""))).alias("mixture"), "tz", "date_order")
    own = lambda t, f, k: spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(f).alias("field_name"), F.col(k).cast("string").alias("rec_key"), F.col(f).alias("value"), F.lit(f).alias("mixture"), F.lit("America/Los_Angeles").alias("tz"), F.lit("mdy").alias("date_order"))
    return raw.unionByName(own("jobs", "first_seen_at", "global_id")).unionByName(own("errors", "ts", "error_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_instants(_time_values(spark, d), "value", "mixture", "tz", "date_order").where("ts_status = 'resolved'").select("field_name", "rec_key", "utc_us")


def p4_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Every value that was not resolved, with the reason."""
    return resolve_instants(_time_values(spark, d), "value", "mixture", "tz", "date_order").where("ts_status not in ('resolved', 'missing')").select("field_name", "rec_key", "value", "ts_status", "ts_format")


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_unresolved": p4_unresolved}

SQL = {
    "p1_found": """
with t as (select distinct * exclude (slice_file, slice_pos) from slice_rows where snapshot_no is not null),
d as (select ats_type, snapshot_no, lag(snapshot_no) over (partition by ats_type order by snapshot_no) as prev from (select distinct ats_type, snapshot_no from t)),
n as (select t.* from t join d on t.ats_type is not distinct from d.ats_type and t.snapshot_no = d.snapshot_no where d.prev is not null),
o as (select t.* replace (d.snapshot_no as snapshot_no) from t join d on t.ats_type is not distinct from d.ats_type and t.snapshot_no = d.prev)
select coalesce(n.ats_type, o.ats_type) as ats_type, coalesce(n.snapshot_no, o.snapshot_no) as snapshot_no, coalesce(n.global_id, o.global_id) as global_id,
  case when o.snapshot_no is null then 'added' when n.snapshot_no is null then 'removed' else 'changed' end as change_kind
from n full join o on n.ats_type = o.ats_type and n.snapshot_no = o.snapshot_no and n.global_id = o.global_id
where o.snapshot_no is null or n.snapshot_no is null
  or (n.requisition_id, n.company, n.title, n.location, n.country_iso, n.apply_url, n.posted_at, n.description_sha)
     is distinct from (o.requisition_id, o.company, o.title, o.location, o.country_iso, o.apply_url, o.posted_at, o.description_sha)
""",
    # the notations that the tables hold, one by one; nothing of it is shared with the operator
    "p4_found": r"""
with v as (
  select 'posted_at' as field_name, row_id::varchar as rec_key, posted_at as v, coalesce(s.tz_name, 'UTC') as tz, s.date_order as o from raw_jobs r join ats_sources s on lower(r.ats_type) = s.ats_type
  union all select 'first_seen_at', global_id, first_seen_at, 'America/Los_Angeles', 'mdy' from jobs
  union all select 'ts', error_id::varchar, ts, 'America/Los_Angeles', 'mdy' from errors),
t as (select * replace (trim(regexp_replace(v, '\s+', ' ', 'g')) as v) from v where v is not null),
z as (select *, regexp_extract(v, '[ ]\[?([A-Z][a-z]+/[A-Za-z_]+|UTC)\]?$', 1) as named, regexp_extract(v, ' ([A-Z]{3,4})$', 1) as abbr,
  case when regexp_matches(v, '[0-9]:[0-9]{2}|T[0-9]{6}') then regexp_extract(v, '( ?[+-][0-9]{2}:?[0-9]{2}|Z)$', 1) else '' end as off from t),
w as (select *, case when named <> '' then regexp_replace(v, ' \[?[A-Za-z_/]+\]?$', '') when off <> '' then v[:length(v) - length(off)] when abbr in ('EST','EDT','CST','CDT','MST','MDT','PST','PDT','CET','CEST','GMT') then v[:length(v) - length(abbr) - 1] else v end as body,
  case when named <> '' then null when trim(off) = 'Z' then 0 when off <> '' then (case when contains(off, '-') then -1 else 1 end) * (regexp_extract(off, '([0-9]{2}):?[0-9]{2}$', 1)::int * 60 + regexp_extract(off, '([0-9]{2})$', 1)::int)
    else map {'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'MST': -420, 'MDT': -360, 'PST': -480, 'PDT': -420, 'CET': 60, 'CEST': 120, 'GMT': 0}[abbr] end as minutes from z),
b as (select *, regexp_replace(replace(body, ',', case when regexp_matches(body, '^[0-9]{4}-') then '.' else ',' end), '(\.[0-9]{6})[0-9]+$', '\1') as x from w),
p as (select *, case
  when regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then try_strptime(x, '%Y-%m-%d')
  when regexp_matches(x, '^[0-9]{4}[-/]') then try_strptime(replace(replace(x, '/', '-'), 'T', ' '), ['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M'])
  when regexp_matches(x, '^[0-9]{8}T[0-9]{6}$') then try_strptime(x, '%Y%m%dT%H%M%S')
  when regexp_matches(x, '^[0-9]+\.[0-9]+\.[0-9]{4}') then try_strptime(x, ['%d.%m.%Y %H:%M', '%d.%m.%Y'])
  when regexp_matches(x, '^[A-Z][a-z]{2}, ') then try_strptime(x[6:], '%d %b %Y %H:%M:%S')
  when regexp_matches(x, '^[0-9]{1,2} [A-Z]') then try_strptime(x, '%d %b %Y %H:%M')
  when regexp_matches(x, '^[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}$') then try_strptime(x, '%B %d, %Y')
  when regexp_matches(x, '^[0-9]{2}/[A-Z]') then try_strptime(x, '%d/%b/%Y:%H:%M:%S')
  when regexp_matches(x, '^[0-9]+/[0-9]+/[0-9]{2}$') then case o when 'dmy' then try_strptime(x, '%d/%m/%y') else try_strptime(x, '%m/%d/%y') end
  when regexp_matches(x, '^[0-9]+/[0-9]+/') then case o when 'dmy' then try_strptime(x, ['%d/%m/%Y %I:%M %p', '%d/%m/%Y %H:%M', '%d/%m/%Y']) else try_strptime(x, ['%m/%d/%Y %I:%M %p', '%m/%d/%Y %H:%M', '%m/%d/%Y']) end end as wall from b),
u as (select *, coalesce(nullif(named, ''), tz) as zone from p),
r as (select *, case
  when regexp_matches(v, '^[0-9]{10}$') then v::bigint * 1000000 when regexp_matches(v, '^[0-9]{13}$') then v::bigint * 1000 when regexp_matches(v, '^[0-9]{16}$') then v::bigint
  when regexp_matches(v, '^[0-9]{10}\.[0-9]{6}$') then replace(v, '.', '')::bigint
  when minutes is not null then epoch_us(wall) - minutes::bigint * 60000000
  when ((wall at time zone zone) at time zone zone) = wall
    -- an hour on either side of a time that the zone has twice, the other reading shows the same wall clock
    and (((wall at time zone zone) + interval 1 hour) at time zone zone) <> wall and (((wall at time zone zone) - interval 1 hour) at time zone zone) <> wall
  then epoch_us(wall at time zone zone) end as utc_us from u)
select field_name, rec_key, utc_us from r where utc_us is not null
""",
}
