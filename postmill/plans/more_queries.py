"""Queries of lookups, views, queues, lists and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import keys as K
from postmill.functions import numbers as N
from postmill.functions import text as X
from postmill.functions.sections import Rules, sections_dropped, sections_kept
from postmill.operators import ranking as G
from postmill.operators import upsert as U
from postmill.plans.key_queries import _COMPANY
from postmill.plans.query import Registry, Tables

R = Registry()
query = R.query
QUERIES, SQL = R.QUERIES, R.SQL

ZONE = "America/Los_Angeles"
# Companies to leave out, as they might be typed in a list of blocks.
BLOCKED = ["Zinlonti & Huna Financial", "Delenbur Tizin Engineering, Co.", "Jubargel-Tihur University"]


@query("select r.row_id, r.url from raw_jobs r where r.global_id in (select global_id from jobs where status = 'scored' and score >= 80)")
def s09_point_lookup(t: Tables) -> DataFrame:
    wanted = t.jobs.where("status = 'scored' and score >= 80").select("global_id")
    return t.raw_jobs.select("row_id", "url", "global_id").join(wanted, "global_id", "left_semi").select("row_id", "url")


@query("select global_id, url from raw_jobs where url is not null qualify row_number() over (partition by global_id order by row_id) = 1")
def s11_first_url(t: Tables) -> DataFrame:
    return t.raw_jobs.where("url is not null").groupBy("global_id").agg(F.min_by("url", "row_id").alias("url"))


@query("select ats_type, count(*) as n_rows, count(distinct global_id) as n_keys, count(*) - count(location) as n_unplaced from raw_jobs group by 1")
def s13_snapshot_read(t: Tables) -> DataFrame:
    return t.raw_jobs.groupBy("ats_type").agg(F.count("*").alias("n_rows"), F.countDistinct("global_id").alias("n_keys"), (F.count("*") - F.count("location")).alias("n_unplaced"))


@query("select row_id, company from (select row_id, company, " + _COMPANY.format("company") + " as k from raw_jobs) where k is null or k not in (" + ", ".join("'" + x + "'" for x in ("zinlontihunafinancial", "delenburtizinengineering", "jubargeltihuruniversity")) + ")")
def f03_block_list(t: Tables) -> DataFrame:
    blocked = t.spark.createDataFrame([(b,) for b in BLOCKED], "b string").select(K.company_key(F.col("b")).alias("k"))
    return t.raw_jobs.select("row_id", "company", K.company_key(F.col("company")).alias("k")).join(blocked, "k", "left_anti").select("row_id", "company")


@query("select global_id, score from jobs where score >= 80 and ats_type = 'tallgrass' and ((scored_at at time zone 'UTC') at time zone 'America/Los_Angeles')::date between date '2026-08-01' and date '2026-10-20' and contains(lower(concat_ws(' ', title, company, location)), 'engineer')")
def v01_view_filter(t: Tables) -> DataFrame:
    day = N.local_day(F.col("scored_at"), ZONE)
    return t.jobs.where((F.col("score") >= 80) & (F.col("ats_type") == "tallgrass") & day.between(F.lit("2026-08-01").cast("date"), F.lit("2026-10-20").cast("date")) & X.contains_text("engineer", "title", "company", "location")).select("global_id", "score")


@query(
    """with l as (select ats_type, max(snapshot_no) as latest, sum(row_count)::bigint as n_rows from slice_state group by 1), s as (select a.ats_type, n_rows, case when a.ats_type = 'saltbox' then 'held' when latest < 4 or latest is null then 'queued' else 'up_to_date' end as status from ats_sources a left join l using (ats_type))
select ats_type, n_rows, status, case when status = 'queued' then row_number() over (partition by status order by n_rows desc nulls last, ats_type) end as queue_pos from s"""
)
def w08_queue(t: Tables) -> DataFrame:
    latest = t.slice_state.groupBy("ats_type").agg(F.max("snapshot_no").alias("latest"), F.sum("row_count").alias("n_rows"))
    status = F.when(F.col("ats_type") == "saltbox", "held").when(F.coalesce("latest", F.lit(-1)) < 4, "queued").otherwise("up_to_date")
    s = t.ats_sources.join(latest, "ats_type", "left").select("ats_type", "n_rows", status.alias("status"))
    w = Window.partitionBy("status").orderBy(F.col("n_rows").desc_nulls_last(), "ats_type")
    return s.withColumn("queue_pos", F.when(F.col("status") == "queued", F.row_number().over(w)).cast("bigint"))


@query("select company, n, best, row_number() over (order by best desc nulls last, n desc, lower(company) nulls last, company) as pos from (select company, count(*) as n, max(score) as best from jobs group by 1)")
def w20_group_sort(t: Tables) -> DataFrame:
    order = [F.col("best").desc_nulls_last(), F.desc("n"), F.lower("company").asc_nulls_last(), F.col("company").asc_nulls_last()]
    groups = t.jobs.groupBy("company").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return G.positions(groups, order, "pos")


@query("select company, string_agg(global_id, ', ' order by score desc, global_id) as applied from jobs join job_state using (global_id) where state = 'applied' group by 1")
def w27_applied_here(t: Tables) -> DataFrame:
    j = t.jobs.join(t.job_state.where("state = 'applied'").select("global_id"), "global_id")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "global_id")))  # the marks of one company, set by hand
    return j.groupBy("company").agg(F.array_join(F.transform(F.filter(ordered, lambda x: x["global_id"].isNotNull()), lambda x: x["global_id"]), ", ").alias("applied"))


@query("select event_type, d as day, count(*) as n, round(sum(value), 2) as total from (select *, strftime(ts, '%Y-%m-%d') as d from events) group by grouping sets ((), (d), (event_type, d))")
def a22_grouping_sets(t: Tables) -> DataFrame:
    e = t.events.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return e.groupingSets([[], [F.col("day")], [F.col("event_type"), F.col("day")]], "event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select user_id, count(*) as n, round(count(*) filter (event_type = 'purchase') * 100.0 / nullif(count(*) filter (event_type = 'click'), 0), 3) as per_click from events group by 1")
def a23_ratio(t: Tables) -> DataFrame:
    n = lambda k: F.count_if(F.col("event_type") == k)
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(n("purchase") * 100.0 / F.nullif(n("click"), F.lit(0)), 3).alias("per_click"))


@query("select count(*) filter (ats_type in ('gatepost', 'tallgrass', 'inkwell')) as n_checkable, count(*) filter (ats_type not in ('gatepost', 'tallgrass', 'inkwell')) as n_unverifiable from jobs where status = 'scored' and score >= 80")
def a25_checkable(t: Tables) -> DataFrame:
    known = F.col("ats_type").isin("gatepost", "tallgrass", "inkwell")
    return t.jobs.where("status = 'scored' and score >= 80").agg(F.count_if(known).alias("n_checkable"), F.count_if(~known).alias("n_unverifiable"))


@query("select snapshot_no, count(*) as n_rows, sum(n_files)::bigint as n_files from (select snapshot_no, slice_file, count(*) as n_files from slice_state group by all) group by 1")
def a36_run_stats(t: Tables) -> DataFrame:
    return t.slice_state.groupBy("snapshot_no", "slice_file").agg(F.count("*").alias("n_files")).groupBy("snapshot_no").agg(F.count("*").alias("n_rows"), F.sum("n_files").alias("n_files"))


@query("select global_id, score from jobs where not regexp_matches(coalesce(title, ''), '(?i)\\b(?:machine operator|tax accountant)\\b') or global_id in (select global_id from job_state)")
def m03_purge_titles(t: Tables) -> DataFrame:
    doomed = t.jobs.where(F.col("title").rlike(X.words_pattern(["machine operator", "tax accountant"]))).join(t.job_state.select("global_id"), "global_id", "left_anti")
    return U.remove_rows(t.jobs, doomed, "global_id").select("global_id", "score")


@query("select global_id, case when r.apply_url is not null and regexp_matches(j.apply_url, 'apply\\.') then r.apply_url else j.apply_url end as link from jobs j left join (select global_id, arg_min(url, row_id) as apply_url from raw_jobs where url is not null group by 1) r using (global_id)")
def m08_backfill_links(t: Tables) -> DataFrame:
    first = t.raw_jobs.where("url is not null").groupBy("global_id").agg(F.min_by("url", "row_id").alias("apply_url"))
    walled = first.join(t.jobs.where(F.col("apply_url").rlike(r"apply\.")).select("global_id"), "global_id", "left_semi")
    return U.set_columns(t.jobs.select("global_id", "apply_url"), walled, "global_id", ["apply_url"]).withColumnRenamed("apply_url", "link")


@query("select s.global_id, s.state from job_state s where s.global_id in (select global_id from jobs) union all select 'restored:' || split_part(global_id, ':', 2), state from job_state where global_id not in (select global_id from raw_jobs where batch_no > 0)")
def m09_restore_marks(t: Tables) -> DataFrame:
    live = t.job_state.join(t.jobs.select("global_id"), "global_id", "left_semi").select("global_id", "state")
    lost = t.job_state.join(t.raw_jobs.where("batch_no > 0").select("global_id"), "global_id", "left_anti")
    return live.unionByName(lost.select(F.concat(F.lit("restored:"), F.get(F.split("global_id", ":"), F.lit(1))).alias("global_id"), "state"))


@query("select status, lower(coalesce(provider_used, '-')) as provider, count(*) as n, sum(count(*)) over (partition by status)::bigint as in_status from jobs group by 1, 2")
def r05_by_provider(t: Tables) -> DataFrame:
    n = t.jobs.groupBy("status", F.lower(F.coalesce("provider_used", F.lit("-"))).alias("provider")).agg(F.count("*").alias("n"))
    return n.withColumn("in_status", F.sum("n").over(Window.partitionBy("status")))


@query("select error_id, sum(retry_count) over (partition by stage order by error_id rows unbounded preceding)::bigint as used, sum(retry_count) over (partition by stage order by error_id rows unbounded preceding) >= 200 as over_limit from errors")
def r07_running_budget(t: Tables) -> DataFrame:
    used = G.running_total(t.errors.select("error_id", "stage", "retry_count"), "stage", "error_id", "retry_count", "used", 1_000)
    return used.select("error_id", "used", (F.col("used") >= 200).alias("over_limit"))


# No SQL: patterns that look ahead, tested against cases.
@query(None)
def x09_sections_dropped(t: Tables) -> DataFrame:
    rules = Rules(unwanted=r"about (?!the (?:role|job)|you)|who we are|company|what we offer|benefits|how to apply", unless=r"citizen|clearance")
    return t.raw_jobs.where("description is not null").select("row_id", sections_dropped(F.col("description"), rules).alias("body"))


@query(None)
def x10_sections_kept(t: Tables) -> DataFrame:
    return t.raw_jobs.where("description is not null").select("row_id", sections_kept(F.col("description"), r"what you (?:will do|bring)|profile|requirements|tasks").alias("body")).where("body is not null")
