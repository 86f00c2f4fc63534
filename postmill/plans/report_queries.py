"""Queries of aggregations, series, ranks, and the reports built of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import numbers as N
from postmill.operators import ranking as G
from postmill.operators import summaries as S
from postmill.operators.timestamps import resolve_instants
from postmill.plans.query import Registry, Tables
from postmill.session import written

R = Registry()
query = R.query
QUERIES, SQL = R.QUERIES, R.SQL

#: The reports' now and time zone.
NOW, ZONE = "2026-10-20 18:00:00", "America/Los_Angeles"
STATUSES = ["pending", "scored", "excluded", "excluded_location", "excluded_stack", "excluded_sponsorship", "failed", "delisted", "archived"]
_LOCAL = f"(scored_at at time zone 'UTC') at time zone '{ZONE}'"


def _now():
    return F.lit(NOW).cast("timestamp")


def _count():
    return F.count("*").alias("n")


def _first_seen(jobs: DataFrame) -> DataFrame:
    """jobs with seen: the instant of first_seen_at. A local time that the zone has twice is the first of both, one that it leaves out is moved on by the gap."""
    in_zone = lambda df, zone: resolve_instants(df.withColumns({"source": F.lit("first_seen_at"), "zone": F.lit(zone), "date_order": F.lit("mdy")}), "first_seen_at", "source", "zone", "date_order")
    at = written(in_zone(jobs, ZONE), "seen")
    unsure = F.col("ts_status").isin("twice", "skipped")
    walls = in_zone(at.where(unsure).select(*jobs.columns), "UTC").select(*jobs.columns, F.to_utc_timestamp(F.timestamp_micros("utc_us"), ZONE).alias("seen"))
    return at.where(~unsure).select(*jobs.columns, F.timestamp_micros("utc_us").alias("seen")).unionByName(walls)


@query("select coalesce(sum(row_count), 0)::bigint as n_rows, coalesce(max(row_count), 0)::bigint as largest, count(*) as n_deliveries from slice_state where snapshot_no >= 3")
def a01_totals_since(t: Tables) -> DataFrame:
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("bigint").alias(n)
    return t.slice_state.where("snapshot_no >= 3").agg(zero(F.sum("row_count"), "n_rows"), zero(F.max("row_count"), "largest"), F.count("*").alias("n_deliveries"))


@query("select distinct provider_used from jobs where provider_used is not null")
def a03_providers_used(t: Tables) -> DataFrame:
    return t.jobs.where("provider_used is not null").select("provider_used").distinct()


@query("select count(*) as n_unresolved from errors where not resolved")
def a05_unresolved_errors(t: Tables) -> DataFrame:
    return t.errors.where("not resolved").agg(F.count("*").alias("n_unresolved"))


@query("select count(*) || ':' || coalesce(strftime(max(scored_at), '%Y-%m-%d %H:%M:%S'), '-') as token from jobs")
def a08_data_version(t: Tables) -> DataFrame:
    return t.jobs.agg(F.concat(F.count("*").cast("string"), F.lit(":"), F.coalesce(F.date_format(F.max("scored_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("-"))).alias("token"))


@query(
    f"""select count(*) as n_jobs, count(score) as n_scored, count(*) filter (score >= 80) as n_strong, count(*) filter (score < 80) as n_rest, max(score) as best, median(score)::double as middle, count(distinct company) as n_companies,
count(*) filter (({_LOCAL})::date = date '2026-10-20') as n_today from jobs"""
)
def a09_metrics(t: Tables) -> DataFrame:
    return t.jobs.agg(
        F.count("*").alias("n_jobs"), F.count("score").alias("n_scored"), F.count_if(F.col("score") >= 80).alias("n_strong"), F.count_if(F.col("score") < 80).alias("n_rest"), F.max("score").alias("best"), F.median("score").alias("middle"),
        F.countDistinct("company").alias("n_companies"), F.count_if(N.local_day(F.col("scored_at"), ZONE) == F.lit("2026-10-20").cast("date")).alias("n_today"),
    )


@query("select s.status, count(j.global_id) as n from (select unnest([" + ", ".join(f"'{s}'" for s in STATUSES) + "]) as status) s left join jobs j using (status) group by 1")
def a10_status_counts(t: Tables) -> DataFrame:
    return S.complete_counts(t.jobs, "status", STATUSES)


@query("select 'jobs' as table_name, count(*) as n_rows from jobs union all select 'errors', count(*) from errors union all select 'slice_rows', count(*) from slice_rows")
def a11_table_counts(t: Tables) -> DataFrame:
    return S.table_counts({"jobs": t.jobs, "errors": t.errors, "slice_rows": t.slice_rows})


@query("select ats_type, sum(n)::bigint as n, max(best) as best, sum(total)::bigint as total, sum(total) * 1.0 / nullif(sum(scored), 0) as mean, strftime(max(latest), '%Y-%m-%d %H:%M:%S') as latest from (select ats_type, status, count(*) as n, count(score) as scored, sum(score) as total, max(score) as best, max(scored_at) as latest from jobs group by all) group by 1")
def a12_source_rollup(t: Tables) -> DataFrame:
    parts = t.jobs.groupBy("ats_type", "status").agg(_count(), F.count("score").alias("scored"), F.sum("score").alias("total"), F.max("score").alias("best"), F.max("scored_at").alias("latest"))
    return parts.groupBy("ats_type").agg(F.sum("n").alias("n"), F.max("best").alias("best"), F.sum("total").alias("total"), (F.sum("total") / F.nullif(F.sum("scored"), F.lit(0))).alias("mean"), F.date_format(F.max("latest"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query(
    """select stage, n from (select unnest(['stored', 'located', 'eligible', 'scored', 'strong']) as stage, unnest([count(*), count(*) filter (location_flag <> 'rejected'), count(*) filter (eligibility_flag <> 'excluded'), count(score), count(*) filter (score >= 80)]) as n from jobs)"""
)
def a15_funnel(t: Tables) -> DataFrame:
    one = t.jobs.agg(F.count("*").alias("stored"), F.count_if(F.col("location_flag") != "rejected").alias("located"), F.count_if(F.col("eligibility_flag") != "excluded").alias("eligible"), F.count("score").alias("scored"), F.count_if(F.col("score") >= 80).alias("strong"))
    return one.unpivot([], ["stored", "located", "eligible", "scored", "strong"], "stage", "n")


@query("select b.low, count(j.score) as n from (select unnest(range(0, 100, 10)) as low) b left join jobs j on least(j.score // 10, 9) * 10 = b.low group by 1")
def a16_histogram(t: Tables) -> DataFrame:
    scored = t.jobs.where("score is not null").select(N.bucket(F.col("score"), 10, 10).alias("low"))
    return S.complete_counts(scored, "low", list(range(0, 100, 10)))


@query("select count(*) filter (score_band <> case when score >= 80 then 'strong' else 'reject' end) as n_disagree, count(*) filter (eligible) as n_eligible, count(*) filter (score is null) as n_unscored from jobs")
def a17_band_disagreements(t: Tables) -> DataFrame:
    return t.jobs.agg(F.count_if(F.col("score_band") != N.band(F.col("score"), 80)).alias("n_disagree"), F.count_if("eligible").alias("n_eligible"), F.count_if(F.col("score").isNull()).alias("n_unscored"))


@query("select coalesce(resume_used, '-') as slot, count(*) as n, sum(score)::bigint as total, max(score) as best, avg(score) as mean, count(*) filter (score >= 80) as n_strong from jobs group by 1")
def a18_by_slot(t: Tables) -> DataFrame:
    return t.jobs.groupBy(F.coalesce("resume_used", F.lit("-")).alias("slot")).agg(_count(), F.sum("score").alias("total"), F.max("score").alias("best"), F.avg("score").alias("mean"), F.count_if(F.col("score") >= 80).alias("n_strong"))


@query("select skill, count(*) as n from (select unnest(matched_skills) as skill from jobs) group by 1 order by n desc, skill limit 15")
def a19_top_skills(t: Tables) -> DataFrame:
    return S.most_common(t.jobs.select(F.explode("matched_skills").alias("skill")), "skill", 15)


@query("select ats_type, list_sort(list(score))[round_even(0.5 * (count(score) - 1), 0)::int + 1] as p50, list_sort(list(score))[round_even(0.9 * (count(score) - 1), 0)::int + 1] as p90 from jobs where score is not null group by 1")
def a20_percentiles(t: Tables) -> DataFrame:
    return S.nearest_ranks(t.jobs, "ats_type", "score", {"p50": 0.5, "p90": 0.9})


@query(f"select d.day::date as day, count(j.global_id) as n from (select unnest(generate_series(date '2026-09-01', date '2026-10-20', interval 1 day)) as day) d left join jobs j on ({_LOCAL})::date = d.day::date group by 1")
def a21_daily_series(t: Tables) -> DataFrame:
    return S.dense_days(t.jobs, N.local_day(F.col("scored_at"), ZONE), "2026-09-01", "2026-10-20")


@query(f"select h.hour, count(j.global_id) as n from (select unnest(range(24))::int as hour) h left join jobs j on hour({_LOCAL}) = h.hour group by 1")
def a21_hourly_series(t: Tables) -> DataFrame:
    return S.dense_hours(t.jobs, N.local_hour(F.col("scored_at"), ZONE))


@query("select d.day::date as day, count(e.event_id) as n from (select unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day)) as day) d left join events e on ((e.ts at time zone 'UTC') at time zone 'America/Los_Angeles')::date = d.day::date group by 1")
def a21_event_days(t: Tables) -> DataFrame:
    return S.dense_days(t.events, N.local_day(F.col("ts"), ZONE), "2024-01-01", "2024-01-31")


@query("select kind, label, n from (select 'reason' as kind, delist_reason as label, count(*) as n from jobs where delist_reason is not null group by 2 union all select 'source', ats_type, count(*) from jobs where delist_reason is not null group by 2 union all select 'day', strftime(delisted_at, '%Y-%m-%d'), count(*) from jobs where delist_reason is not null group by 2)")
def a24_delisted(t: Tables) -> DataFrame:
    gone = t.jobs.where("delist_reason is not null").select(F.col("delist_reason").alias("reason"), F.col("ats_type").alias("source"), F.date_format("delisted_at", "yyyy-MM-dd").alias("day"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("reason", "source", "day")]))
    return gone.select(kinds.alias("x")).groupBy("x.kind", "x.label").agg(_count())


@query("select location_reason, count(*) as n, count(*) filter (location_flag = 'uncertain') as n_held, count(*) filter (location_flag = 'uncertain') * 1.0 / nullif(count(score), 0) as held_per_scored from jobs group by 1")
def a26_location_health(t: Tables) -> DataFrame:
    held = F.count_if(F.col("location_flag") == "uncertain")
    return t.jobs.groupBy("location_reason").agg(_count(), held.alias("n_held"), (held / F.nullif(F.count("score"), F.lit(0))).alias("held_per_scored"))


@query("with d as (select 'scored' as kind, scored_at::date as day from jobs where scored_at is not null union all select 'delisted', delisted_at::date from jobs where delisted_at is not null), c as (select kind, day, count(*) as n from d group by all) select kind, sum(n)::bigint as n, count(*) as active_days, max(n) as most, min(day) filter (n = m) as busiest from (select *, max(n) over (partition by kind) as m from c) group by 1")
def a27_timeline(t: Tables) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("ts")) for k, c in (("scored", "scored_at"), ("delisted", "delisted_at"))])
    when = t.jobs.select(F.inline(kinds))
    days = when.where("ts is not null").groupBy("kind", F.to_date("ts").alias("day")).agg(_count())
    best = F.max(F.struct("n", (-F.unix_date("day")).alias("d")))
    return days.groupBy("kind").agg(F.sum("n").alias("total"), F.count("*").alias("active_days"), best.alias("b")).select("kind", F.col("total").alias("n"), "active_days", F.col("b.n").alias("most"), F.date_from_unix_date((-F.col("b.d")).cast("int")).alias("busiest"))


@query("select stage, coalesce(error_type, '?') as error_type, count(*) as n, count(*) filter (not resolved) as n_open, max(retry_count) as retries from errors group by all")
def a29_errors(t: Tables) -> DataFrame:
    return t.errors.groupBy("stage", F.coalesce("error_type", F.lit("?")).alias("error_type")).agg(_count(), F.count_if(~F.col("resolved")).alias("n_open"), F.max("retry_count").alias("retries"))


@query("select company, count(*) filter (score >= 80) as n_strong, count(*) as n, max(score) as best from jobs group by 1 order by n_strong desc, n desc, company limit 15")
def a30_companies(t: Tables) -> DataFrame:
    return t.jobs.groupBy("company").agg(F.count_if(F.col("score") >= 80).alias("n_strong"), _count(), F.max("score").alias("best")).orderBy(F.desc("n_strong"), F.desc("n"), F.col("company")).limit(15)


@query("select count(*) filter (s.state = 'applied') as n_applied, count(*) filter (s.state = 'declined') as n_declined, greatest(count(*) filter (j.score >= 80) - count(*) filter (j.score >= 80 and s.state is not null), 0) as n_untouched, count(*) filter (s.state = 'applied') * 1.0 / nullif(count(s.state), 0) as share_applied from jobs j left join job_state s using (global_id)")
def a31_decisions(t: Tables) -> DataFrame:
    j = t.jobs.join(t.job_state.select("global_id", "state"), "global_id", "left")
    applied, strong = F.count_if(F.col("state") == "applied"), F.col("score") >= 80
    return j.agg(applied.alias("n_applied"), F.count_if(F.col("state") == "declined").alias("n_declined"), F.greatest(F.count_if(strong) - F.count_if(strong & F.col("state").isNotNull()), F.lit(0)).alias("n_untouched"), (applied / F.nullif(F.count("state"), F.lit(0))).alias("share_applied"))


@query("select company, count(*) as n, max(score) as best, arg_max(score_band, (score, global_id)) filter (score is not null) as best_band, count(*) filter (scored_at >= timestamp '2026-10-01') as n_new from jobs group by 1")
def a32_group_summary(t: Tables) -> DataFrame:
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", "global_id", "score_band")))
    return t.jobs.groupBy("company").agg(_count(), F.max("score").alias("best"), best.getField("score_band").alias("best_band"), F.count_if(F.col("scored_at") >= F.lit("2026-10-01").cast("timestamp")).alias("n_new"))


@query("select resume_used, ats_type, count(*) as n, max(score) as best, case when grouping(ats_type) = 1 then 1 else 2 end as level from jobs group by grouping sets ((resume_used), (resume_used, ats_type))")
def a33_tree(t: Tables) -> DataFrame:
    return S.tree(t.jobs, ["resume_used", "ats_type"], [_count(), F.max("score").alias("best")]).select("resume_used", "ats_type", "n", "best", F.col("level").cast("int").alias("level"))


@query("with s as (select company, count(*) as n from jobs group by 1), k as (select count(*) filter (n = 1) as singles from s) select case when n = 1 and singles >= 2 then '(one each)' else company end as grp, sum(n)::bigint as n from s, k group by 1")
def a34_singles(t: Tables) -> DataFrame:
    return S.singles_together(t.jobs, "company")


@query("select title, count(*) as n from raw_jobs group by 1 order by n desc, title nulls first limit 20")
def a35_most_common(t: Tables) -> DataFrame:
    return S.most_common(t.raw_jobs, "title", 20)


@query(f"select case when scored_at is null then 'none' when d <= 30 then '30' when d <= 90 then '90' when d <= 365 then '365' else 'over' end as age, count(*) as n from (select scored_at, (epoch_us(timestamp '{NOW}') - epoch_us(scored_at)) / 86400000000.0 as d from jobs) group by 1")
def a38_age_buckets(t: Tables) -> DataFrame:
    d = N.age_days(F.col("scored_at"), _now())
    return t.jobs.groupBy(F.when(d.isNull(), "none").when(d <= 30, "30").when(d <= 90, "90").when(d <= 365, "365").otherwise("over").alias("age")).agg(_count())


@query("select b.country_iso as \"before\", a.country_iso as \"after\", count(*) as n from (select global_id, min(country_iso) as country_iso from slice_rows where snapshot_no = 0 group by 1) b full join (select global_id, min(country_iso) as country_iso from slice_rows where snapshot_no = 4 group by 1) a using (global_id) group by all")
def a39_transitions(t: Tables) -> DataFrame:
    at = lambda n: t.slice_rows.where(f"snapshot_no = {n}").groupBy("global_id").agg(F.min("country_iso").alias("country_iso"))
    return S.transitions(at(0), at(4), "global_id", "country_iso")


@query(f"select global_id, coalesce((epoch_us(timestamp '{NOW}') - epoch_us(scored_at)) / 86400000000.0 <= 15, true) as fresh from jobs")
def f04_fresh(t: Tables) -> DataFrame:
    return t.jobs.select("global_id", N.is_fresh(F.col("scored_at"), _now(), 15).alias("fresh"))


@query(
    """with used as (select company as grp, count(*) as n_used from jobs where scored_at >= timestamp '2026-10-19' group by 1)
select global_id, case when nullif(company, '') is null then true else row_number() over (partition by nullif(company, '') order by score desc nulls last, global_id) <= 2 - coalesce(n_used, 0) end as takes
from jobs left join used on company = grp where status in ('scored', 'pending')"""
)
def w05_quota(t: Tables) -> DataFrame:
    used = t.jobs.where("scored_at >= timestamp '2026-10-19'").groupBy(F.col("company").alias("grp")).agg(F.count("*").alias("n_used"))
    return G.quota(t.jobs.where("status in ('scored', 'pending')"), F.col("company"), [F.col("score").desc_nulls_last(), F.col("global_id")], 2, used).select("global_id", "takes")


@query("select ats_type, row_number() over (order by case ats_type when 'pinhole' then 0 when 'gatepost' then 1 else 2 end, tz_name nulls first, ats_type) as queue_pos from ats_sources where ats_type <> 'saltbox'")
def w06_priority(t: Tables) -> DataFrame:
    return G.by_priority(t.ats_sources, "ats_type", ["pinhole", "gatepost"], ["saltbox"], "tz_name").select("ats_type", F.col("queue_pos").cast("bigint").alias("queue_pos"))


@query(
    """with all_ as (select 0 as p, company as k, 'applied' as kind, j.scored_at as happened from jobs j join job_state s using (global_id) where s.state = 'applied' union all
select 1, company, 'cooldown', s.updated_at from jobs j join job_state s using (global_id) where s.state = 'rejected' union all select 2, company, 'delisted', delisted_at from jobs where status = 'delisted')
select k as company, kind, strftime(happened, '%Y-%m-%d %H:%M:%S') as happened from (select *, row_number() over (partition by k order by p desc, happened desc nulls last) as rn from all_) where rn = 1"""
)
def w09_precedence(t: Tables) -> DataFrame:
    marked = t.jobs.join(t.job_state.select("global_id", "state", "updated_at"), "global_id")
    part = lambda df, kind, at: df.select("company", F.lit(kind).alias("kind"), F.col(at).alias("happened"))
    out = G.precedence([part(marked.where("state = 'applied'"), "applied", "scored_at"), part(marked.where("state = 'rejected'"), "cooldown", "updated_at"), part(t.jobs.where("status = 'delisted'"), "delisted", "delisted_at")], "company", F.col("happened"))
    return out.select("company", "kind", F.date_format("happened", "yyyy-MM-dd HH:mm:ss").alias("happened"))


@query("select company, max(updated_at)::varchar is not null as has, arg_max(j.global_id, s.updated_at) as latest from jobs j join job_state s using (global_id) where s.state = 'rejected' group by 1")
def w10_latest_rejection(t: Tables) -> DataFrame:
    j = t.jobs.join(t.job_state.where("state = 'rejected'").select("global_id", "updated_at"), "global_id")
    return j.groupBy("company").agg(F.max("updated_at").isNotNull().alias("has"), F.max_by("global_id", "updated_at").alias("latest"))


@query("select global_id, score from jobs where status = 'scored' and score >= 60 order by score desc, scored_at desc nulls last, global_id limit 5000")
def w12_scored_list(t: Tables) -> DataFrame:
    return t.jobs.where("status = 'scored' and score >= 60").orderBy(F.desc("score"), F.col("scored_at").desc_nulls_last(), F.col("global_id")).limit(5000).select("global_id", "score")


@query("select global_id from jobs where status = 'excluded_location' order by first_seen_at desc, global_id limit 500")
def w13_held_back(t: Tables) -> DataFrame:
    return t.jobs.where("status = 'excluded_location'").orderBy(F.desc("first_seen_at"), F.col("global_id")).limit(500).select("global_id")


# No SQL: first_seen_at is in mixed notations; tested over a table of its own.
@query(None)
def w15_digest(t: Tables) -> DataFrame:
    seen = _first_seen(t.jobs.select("global_id", "score", "scored_at", "first_seen_at"))
    since = seen.where(F.date_trunc("second", F.coalesce("scored_at", "seen")) >= F.lit("2026-09-01").cast("timestamp"))
    return G.positions(since.select("global_id", "score"), [F.col("score").desc_nulls_last(), F.col("global_id")], "pos").select("global_id", "pos")


@query("select * from (select 'strong' as section, global_id from jobs where status = 'scored' and score >= 80 union all (select 'location', global_id from jobs where status = 'excluded_location' and location_flag = 'uncertain' order by first_seen_at desc, global_id limit 25) union all select 'unsure', global_id from jobs where status = 'scored' and eligibility_flag = 'uncertain')")
def w16_sections(t: Tables) -> DataFrame:
    part = lambda df, name: df.select(F.lit(name).alias("section"), "global_id")
    held = t.jobs.where("status = 'excluded_location' and location_flag = 'uncertain'").orderBy(F.desc("first_seen_at"), F.col("global_id")).limit(25)
    return part(t.jobs.where("status = 'scored' and score >= 80"), "strong").unionAll(part(held, "location")).unionAll(part(t.jobs.where("status = 'scored' and eligibility_flag = 'uncertain'"), "unsure"))


@query(f"select global_id, (epoch_us(timestamp '{NOW}') - epoch_us(coalesce(scored_at, delisted_at))) / 86400000000.0 as age from jobs where (epoch_us(timestamp '{NOW}') - epoch_us(coalesce(scored_at, delisted_at))) / 86400000000.0 > 180 and global_id not in (select global_id from job_state)")
def w18_stale(t: Tables) -> DataFrame:
    aged = t.jobs.withColumn("age", N.age_days(F.coalesce("scored_at", "delisted_at"), _now())).where("age > 180")
    return aged.join(t.job_state.select("global_id"), "global_id", "left_anti").select("global_id", "age")


@query("select row_id, row_number() over (order by nullif(trim(location), '') is null, case when nullif(trim(location), '') is not null then location end desc, row_id) as pos from raw_jobs")
def w19_blanks_last(t: Tables) -> DataFrame:
    order = [G.blanks_last("location", descending=True), F.col("row_id")]
    return G.positions(t.raw_jobs.select("row_id", "location"), order, "pos").select("row_id", "pos")


@query("select ats_type, company, global_id, score from jobs where score is not null qualify row_number() over (partition by ats_type order by score desc, global_id) <= 3")
def w29_top_per_source(t: Tables) -> DataFrame:
    w = Window.partitionBy("ats_type").orderBy(F.desc("score"), F.col("global_id"))
    return t.jobs.where("score is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("ats_type", "company", "global_id", "score")


# Scans, joins and aggregations over the star-schema tables.
@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def t01_pricing(t: Tables) -> DataFrame:
    l = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), _count())


@query("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as n_orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1")
def t05_revenue_by_nation(t: Tables) -> DataFrame:
    r = t.region.where("r_name = 'ASIA'").join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.customer.join(r.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("select o_orderpriority, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45) group by 1")
def t04_semi_join(t: Tables) -> DataFrame:
    big = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(_count())
