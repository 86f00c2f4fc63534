"""Queries of keys, text functions, joins, duplicates and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions import keys as K
from postmill.functions import numbers as N
from postmill.functions import text as X
from postmill.operators import dedupe as D
from postmill.operators import upsert as U
from postmill.plans.query import Registry, Tables
from postmill.sources.tables import changed

R = Registry()
query = R.query
QUERIES, SQL = R.QUERIES, R.SQL

_HOST = r"coalesce(nullif(lower(regexp_extract(coalesce({0}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), ''), 'no-host')"
_COMPANY_T = r"case when regexp_matches(lower(trim({0})), '^[a-z0-9-]+(\.[a-z0-9-]+)+$') then regexp_extract(lower(trim({0})), '^(?:www\.|careers\.|jobs\.)?([a-z0-9-]+)', 1) else lower(trim({0})) end"
_COMPANY = (
    r"replace(regexp_replace(trim(regexp_replace(regexp_replace(" + _COMPANY_T + r", '[.'']', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '^(.+?)(?: (?:" + "|".join(K.LEGAL_FORMS) + r"))+$', '\1'), ' ', '')"
)


@query(
    f"""select row_id, case when coalesce(s.per_employer_ids, false) then concat_ws(':', r.ats_type, {_HOST.format('r.url')}, own) else concat_ws(':', r.ats_type, own) end as made_key
from (select *, coalesce(case when trim(requisition_id) = '' or lower(trim(requisition_id)) = 'nan' then null else regexp_replace(trim(requisition_id), '^(-?\\d+)\\.0+$', '\\1') end, 'url-' || sha1(coalesce(url, ''))[1:16]) as own from raw_jobs) r
left join ats_sources s using (ats_type)"""
)
def n01_global_key(t: Tables) -> DataFrame:
    s = t.ats_sources.select("ats_type", "per_employer_ids")
    return t.raw_jobs.join(s, "ats_type", "left").select("row_id", K.global_key(F.col("ats_type"), F.col("requisition_id"), F.col("url"), F.col("per_employer_ids")).alias("made_key"))


@query(f"select row_id, {_HOST.format('url')} as host from raw_jobs")
def n03_host(t: Tables) -> DataFrame:
    return t.raw_jobs.select("row_id", K.host(F.col("url")).alias("host"))


@query(r"select global_id, case when coalesce(per_employer_ids, false) then regexp_extract(global_id, '^[^:]*:[^:]*:(.*)$', 1) else regexp_extract(global_id, '^[^:]*:(.*)$', 1) end as source_id from jobs left join ats_sources using (ats_type)")
def n04_id_of_key(t: Tables) -> DataFrame:
    s = t.ats_sources.select("ats_type", "per_employer_ids")
    return t.jobs.join(s, "ats_type", "left").select("global_id", K.id_of(F.col("global_id"), F.col("per_employer_ids")).alias("source_id"))


@query(f"select distinct company, {_COMPANY.format('company')} as company_key from jobs where company is not null")
def n05_company_key(t: Tables) -> DataFrame:
    return t.jobs.where("company is not null").select("company", K.company_key(F.col("company")).alias("company_key")).distinct()


@query(r"""select row_id, case when regexp_matches(nullif(trim(apply_url), ''), 'apply\.') then coalesce(nullif(trim(url), ''), nullif(trim(apply_url), '')) else coalesce(nullif(trim(apply_url), ''), nullif(trim(url), '')) end as link from raw_jobs""")
def n08_best_link(t: Tables) -> DataFrame:
    return t.raw_jobs.select("row_id", K.best_link(F.col("apply_url"), F.col("url"), r"apply\.").alias("link"))


@query("select coalesce(lower(trim(is_remote)) not in ('', 'false', '0', 'no', 'f', 'n', 'none', 'null'), false) as remote, count(*) as n from raw_jobs group by 1")
def n10_truth(t: Tables) -> DataFrame:
    return t.raw_jobs.groupBy(K.truth(F.col("is_remote")).alias("remote")).agg(F.count("*").alias("n"))


@query("select coalesce(nullif(trim(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]+', ' ', 'g')), ''), '?') as fold, count(*) as n from raw_jobs group by 1")
def n11_company_fold(t: Tables) -> DataFrame:
    return t.raw_jobs.groupBy(K.company_fold(F.col("company")).alias("fold")).agg(F.count("*").alias("n"))


@query("select global_id, count(distinct title) as n_titles from raw_jobs group by 1 having count(distinct title) > 1")
def n12_shared_keys(t: Tables) -> DataFrame:
    return t.raw_jobs.groupBy("global_id").agg(F.countDistinct("title").alias("n_titles")).where("n_titles > 1")


@query("select count(*) as n_legacy from jobs join ats_sources using (ats_type) where per_employer_ids and not (global_id like ats_type || ':%:%')")
def n13_legacy_keys(t: Tables) -> DataFrame:
    s = t.ats_sources.where("per_employer_ids").select("ats_type")
    return t.jobs.join(s, "ats_type").where("not global_id like concat(ats_type, ':%:%')").agg(F.count("*").alias("n_legacy"))


@query(
    f"""select global_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(printf('%02x', (('0x' || h[17:18])::int & 63) | 128)) || h[19:20], h[21:32]) as event_id
from (select global_id, sha1(unhex('{K.URL_NAMESPACE}') || encode('posting:' || global_id)) as h from jobs)"""
)
def n14_event_id(t: Tables) -> DataFrame:
    return t.jobs.select("global_id", K.name_uuid("posting:", F.col("global_id")).alias("event_id"))


_ENT = "x"
for _e, _c in X.ENTITIES.items():
    _e = _e.replace("'", "''")
    _ENT = f"replace({_ENT}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"


@query(
    rf"""select row_id, array_to_string(list_filter(list_transform(string_split({_ENT}, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> ''), chr(10)) as plain
from (select row_id, regexp_replace(regexp_replace(description, '(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g') as x from raw_jobs)"""
)
def x01_html_text(t: Tables) -> DataFrame:
    return t.raw_jobs.select("row_id", X.html_text(F.col("description")).alias("plain"))


@query("select row_id from raw_jobs where contains(lower(concat_ws(' ', title, company, location, description)), 'platform engineer')")
def x02_search(t: Tables) -> DataFrame:
    return t.raw_jobs.where(X.contains_text("Platform Engineer", "title", "company", "location", "description")).select("row_id")


# A vocabulary to look for, in the order of the result.
VOCABULARY = ["Python", "Java", "C++", "Go", "Rust", "SQL", "Spark", "Kafka", "Airflow", "Kubernetes", "Terraform", "React", "Swift", "Kotlin", "dbt"]


@query(
    "select row_id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(description, '(?i)(?:^|[^\\p{{L}}\\p{{N}}+#.]){w.replace('+', chr(92) + '+')}(?:$|[^\\p{{L}}\\p{{N}}+#])') then '{w}' end" for w in VOCABULARY) + "], lambda x: x is not null), '; ') as found from raw_jobs where description is not null"
)
def x03_mentions(t: Tables) -> DataFrame:
    return t.raw_jobs.where("description is not null").select("row_id", F.array_join(X.mentions(F.col("description"), VOCABULARY), "; ").alias("found"))


@query(
    """select row_id, replace(nullif(list_filter(string_split(case when json_valid(raw) then json_extract_string(raw, '$.externalPath') end, '/'), lambda x: x <> '')[2], ''), '-', ' ') as place_slug, case when json_valid(raw) then json_extract_string(raw, '$.dept') end as dept from raw_jobs where json_valid(raw)"""
)
def x04_json_values(t: Tables) -> DataFrame:
    valid = t.raw_jobs.where(F.try_parse_json("raw").isNotNull())
    return valid.select("row_id", X.path_segment(F.col("raw"), "externalPath", 2).alias("place_slug"), F.get_json_object("raw", "$.dept").alias("dept"))


@query(
    """select global_id, array_to_string(list_filter(missing_skills, lambda x: not list_contains(matched_skills, x)), '; ') as still_missing, array_to_string(list_filter(matched_skills, lambda x: list_contains(missing_skills, x)), '; ') as in_both from jobs where matched_skills is not null and missing_skills is not null"""
)
def x05_list_difference(t: Tables) -> DataFrame:
    j = t.jobs.where("matched_skills is not null and missing_skills is not null")
    return j.select("global_id", F.array_join(X.in_order(F.col("missing_skills"), F.col("matched_skills"), False), "; ").alias("still_missing"), F.array_join(X.in_order(F.col("matched_skills"), F.col("missing_skills")), "; ").alias("in_both"))


@query(
    """select event_id, case when value <= 10 then 100.0 when value <= 20 then 100.0 + (value - 10) * -2.0 when value <= 40 then 80.0 + (value - 20) * -2.0 when value is not null then 15.0 end as fit from events"""
)
def x06_pieces(t: Tables) -> DataFrame:
    return t.events.select("event_id", N.pieces(F.col("value"), [(10, 100), (20, 80), (40, 40)], 15).alias("fit"))


@query("select o_orderkey, round_even(o_totalprice * 0.5 + o_custkey * 0.25 + o_orderkey * 0.25, 0)::int as score from orders")
def x07_weighted(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", N.weighted([(F.col("o_totalprice"), 0.5), (F.col("o_custkey"), 0.25), (F.col("o_orderkey"), 0.25)]).alias("score"))


@query(
    """select row_id, case when title is null or trim(title) = '' then 'empty' when regexp_matches(title, '(?i)\\b(?:principal|staff)\\b') then 'drop' when regexp_matches(title, '(?i)\\b(?:engineer|developer)\\b') then 'keep' else 'drop' end as flag,
case when title is null or trim(title) = '' then 'no_title' when regexp_matches(title, '(?i)\\b(?:principal|staff)\\b') then 'deny' when regexp_matches(title, '(?i)\\b(?:engineer|developer)\\b') then 'allow' else 'no_match' end as reason from raw_jobs"""
)
def x08_cascade(t: Tables) -> DataFrame:
    title = F.col("title")
    rules = [(title.isNull() | (F.trim(title) == ""), "empty", "no_title"), (title.rlike(X.words_pattern(["principal", "staff"])), "drop", "deny"), (title.rlike(X.words_pattern(["engineer", "developer"])), "keep", "allow")]
    return t.raw_jobs.select("row_id", N.cascade(rules, ("drop", "no_match")).alias("c")).select("row_id", "c.flag", "c.reason")


@query("select global_id from raw_jobs where batch_no = 0 union select global_id from jobs where status <> 'pending'")
def j03_seen_keys(t: Tables) -> DataFrame:
    return D.seen_keys(t.raw_jobs.where("batch_no = 0"), t.jobs.where("status <> 'pending'"))


@query(
    """with seen as (select distinct global_id from raw_jobs where batch_no = 0), req as (select distinct company, requisition_id, location from raw_jobs where batch_no = 0),
fresh as (select b.* from raw_jobs b where b.batch_no > 0 and b.global_id not in (select global_id from seen where global_id is not null)
  and not exists (select 1 from req where req.company = b.company and req.requisition_id = b.requisition_id and req.location is not distinct from b.location)),
one as (select * from fresh qualify row_number() over (partition by global_id order by posted_at is null, row_id) = 1)
select row_id, global_id from (select *, row_number() over (partition by company, requisition_id, location order by posted_at is null, row_id) as rn from one) where rn = 1 or requisition_id is null"""
)
def w01_dedupe(t: Tables) -> DataFrame:
    seen = t.raw_jobs.where("batch_no = 0")
    return D.dedupe(t.raw_jobs.where("batch_no > 0"), seen, seen, position="row_id").select("row_id", "global_id")


@query("select j.global_id, j.score from jobs j where not exists (select 1 from job_state s where s.global_id = j.global_id)")
def j04_unmarked(t: Tables) -> DataFrame:
    return t.jobs.join(t.job_state.select("global_id"), "global_id", "left_anti").select("global_id", "score")


@query("select j.global_id, j.status, s.state as mark, s.note from jobs j left join job_state s using (global_id)")
def j05_with_mark(t: Tables) -> DataFrame:
    return t.jobs.join(t.job_state.select("global_id", F.col("state").alias("mark"), "note"), "global_id", "left").select("global_id", "status", "mark", "note")


@query(
    """select coalesce(s.ats_type, d.ats_type, j.ats_type) as ats_type, coalesce(d.n_deliveries, 0) as n_deliveries, coalesce(d.n_rows, 0)::bigint as n_rows, coalesce(j.n_jobs, 0) as n_jobs, coalesce(j.n_scored, 0) as n_scored, j.best
from ats_sources s full join (select ats_type, count(*) as n_deliveries, sum(row_count) as n_rows from slice_state group by 1) d on s.ats_type = d.ats_type
full join (select ats_type, count(*) as n_jobs, count(score) as n_scored, max(score) as best from jobs group by 1) j on coalesce(s.ats_type, d.ats_type) = j.ats_type"""
)
def j08_sources(t: Tables) -> DataFrame:
    d = t.slice_state.groupBy("ats_type").agg(F.count("*").alias("n_deliveries"), F.sum("row_count").alias("n_rows"))
    j = t.jobs.groupBy("ats_type").agg(F.count("*").alias("n_jobs"), F.count("score").alias("n_scored"), F.max("score").alias("best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return t.ats_sources.select("ats_type").join(d, "ats_type", "full_outer").join(j, "ats_type", "full_outer").select("ats_type", zero("n_deliveries"), zero("n_rows"), zero("n_jobs"), zero("n_scored"), "best")


@query(
    """with s as (select *, max(snapshot_no) over (partition by slice_file) as latest from slice_state)
select a.slice_file, a.last_sha256 from s a left join s b on a.slice_file = b.slice_file and b.snapshot_no = a.latest - 1 where a.snapshot_no = a.latest and a.last_sha256 is distinct from b.last_sha256"""
)
def s07_changed_slices(t: Tables) -> DataFrame:
    latest = t.slice_state.groupBy("slice_file").agg(F.max("snapshot_no").alias("latest"))
    s = t.slice_state.join(latest, "slice_file")
    now = s.where("snapshot_no = latest").select("slice_file", F.col("last_sha256").alias("sha256"))
    return changed(now, s.where("snapshot_no = latest - 1"), "slice_file").select("slice_file", F.col("sha256").alias("last_sha256"))


@query(
    """select global_id, title, location from (select j.global_id, r.title, r.location, row_number() over (partition by j.global_id order by (r.location is distinct from j.location), r.row_id) as rn
from jobs j join raw_jobs r on j.global_id = r.global_id and j.company = r.company) where rn = 1"""
)
def j10_best_match(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    r = t.raw_jobs.select("global_id", "company", "row_id", F.col("title").alias("r_title"), F.col("location").alias("r_location"))
    w = Window.partitionBy("global_id").orderBy(~F.col("location").eqNullSafe(F.col("r_location")), "row_id")
    return t.jobs.select("global_id", "company", "location").join(r, ["global_id", "company"]).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("global_id", F.col("r_title").alias("title"), F.col("r_location").alias("location"))


@query(
    """select j.global_id, any_value(r.title) as title from jobs j join raw_jobs r on j.global_id = r.global_id and j.company = r.company and j.location = r.location where r.title is not null group by 1 having count(distinct r.title) = 1"""
)
def j11_unique_match(t: Tables) -> DataFrame:
    r = t.raw_jobs.where("title is not null").select("global_id", "company", "location", "title")
    j = t.jobs.select("global_id", "company", "location").join(r, ["global_id", "company", "location"])
    return j.groupBy("global_id").agg(F.min("title").alias("title"), F.max("title").alias("last")).where("title = last").select("global_id", "title")


@query("select s.global_id, s.state from job_state s where s.global_id not in (select global_id from jobs where status = 'scored')")
def j12_marks_without_job(t: Tables) -> DataFrame:
    return t.job_state.join(t.jobs.where("status = 'scored'").select("global_id"), "global_id", "left_anti").select("global_id", "state")


@query(
    """with n as (select r.global_id, case when j.global_id is null then 'pending' when score is null then 'failed' else 'scored' end as status, score + 1 as score, 'later' as first_seen_at
from (select distinct global_id from raw_jobs where global_id is not null) r left join jobs j on j.global_id = r.global_id)
select coalesce(o.global_id, n.global_id) as global_id, coalesce(o.first_seen_at, n.first_seen_at) as first_seen_at,
  case when take then n.status else o.status end as status, case when take then n.score else o.score end as score
from (select o, n, n.global_id is not null and (o.global_id is null or o.status not in ('scored', 'delisted') or n.status in ('scored', 'delisted')) as take from jobs o full join n on o.global_id = n.global_id)"""
)
def k01_upsert(t: Tables) -> DataFrame:
    j = t.jobs.select("global_id", "status", "score", "first_seen_at")
    fetched = t.raw_jobs.where("global_id is not null").select("global_id").distinct().join(j.select("global_id", "score", F.lit(True).alias("known")), "global_id", "left")
    status = F.when(F.col("known").isNull(), "pending").when(F.col("score").isNull(), "failed").otherwise("scored")
    incoming = fetched.select("global_id", status.alias("status"), (F.col("score") + 1).alias("score"), F.lit("later").alias("first_seen_at"))
    return U.guarded_upsert(j, incoming, "global_id", ["first_seen_at"], "status", ["scored", "delisted"])


@query(
    """select global_id, score, status, case when score is null then '' else score::varchar end as score_text, coalesce(array_to_string(matched_skills, '; '), '') as skills from jobs"""
)
def k02_csv_rows(t: Tables) -> DataFrame:
    from postmill.sinks.tables import csv_rows

    j = t.jobs.select("global_id", "score", "status", "matched_skills")
    text = csv_rows(j.select("global_id", F.col("score").alias("score_text"), F.col("matched_skills").alias("skills")), lists=("skills",))
    return j.select("global_id", "score", "status").join(text, "global_id")


@query(
    """select coalesce(s.global_id, n.global_id) as global_id, case when n.global_id is not null then 'declined' else s.state end as state from job_state s full join (select global_id from jobs where status = 'delisted') n on s.global_id = n.global_id"""
)
def k06_put_marks(t: Tables) -> DataFrame:
    new = t.jobs.where("status = 'delisted'").select("global_id", F.lit("declined").alias("state"))
    return U.put_rows(t.job_state.select("global_id", "state"), new, "global_id")


@query(
    """select 'kept' as part, global_id from jobs where not (status = 'failed' and global_id not in (select global_id from job_state)) union all select 'tombstone', global_id from jobs where status = 'failed' and global_id not in (select global_id from job_state)"""
)
def k10_prune(t: Tables) -> DataFrame:
    doomed = t.jobs.where("status = 'failed'").join(t.job_state.select("global_id"), "global_id", "left_anti").select("global_id")
    kept, graves = U.prune(t.jobs.select("global_id"), t.jobs.select("global_id").where("false"), doomed, "global_id")
    return kept.select(F.lit("kept").alias("part"), "global_id").unionByName(graves.select(F.lit("tombstone").alias("part"), "global_id"))


@query(
    """select global_id, score, case when gone then 'delisted' else status end as status, case when gone then 'no_longer_listed' else delist_reason end as delist_reason
from (select *, status = 'scored' and not exists (select 1 from slice_rows s where s.snapshot_no = 4 and s.global_id = jobs.global_id) as gone from jobs)"""
)
def k11_delist(t: Tables) -> DataFrame:
    listed = t.slice_rows.where("snapshot_no = 4").select("global_id").distinct()
    gone = t.jobs.where("status = 'scored'").join(listed, "global_id", "left_anti").select("global_id", F.lit("delisted").alias("status"), F.lit("no_longer_listed").alias("delist_reason"))
    return U.set_columns(t.jobs.select("global_id", "score", "status", "delist_reason"), gone, "global_id", ["status", "delist_reason"])


@query("select global_id, coalesce(s.state, 'queued') as state from (select global_id from job_state union select global_id from jobs where score >= 90) left join job_state s using (global_id)")
def k13_insert_absent(t: Tables) -> DataFrame:
    return U.insert_absent(t.job_state.select("global_id", "state"), t.jobs.where("score >= 90").select("global_id", F.lit("queued").alias("state")), "global_id")

