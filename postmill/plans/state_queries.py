"""Queries of stored state: company memory, spend, digests, outbox, row builders, manifests and control lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import keys as K
from postmill.functions import numbers as N
from postmill.functions import text as X
from postmill.operators import memory as M
from postmill.operators import upsert as U
from postmill.plans.query import Registry, Tables
from postmill.plans.report_queries import NOW, ZONE

R = Registry()
query = R.query
QUERIES, SQL = R.QUERIES, R.SQL

_LEGAL = "ag|bv|co|com|company|corp|corporation|gmbh|inc|limited|llc|ltd|nv|plc|platforms|pty|sa|technologies|technology"
_KEY = rf"""replace(regexp_replace(trim(regexp_replace(regexp_replace(case when regexp_full_match(lower(trim({{0}})), '[a-z0-9-]+(\.[a-z0-9-]+)+') then regexp_extract(lower(trim({{0}})), '^(?:www\.|careers\.|jobs\.)?([a-z0-9-]+)', 1) else lower(trim({{0}})) end, '[.'']', '', 'g'), '[^\p{{{{L}}}}\p{{{{N}}}}]+', ' ', 'g')), '^(.+?)(?: (?:{_LEGAL}))+$', '\1'), ' ', '')"""
_DAY = f"((({{0}}) at time zone 'UTC') at time zone '{ZONE}')::date"
_AGE = f"((epoch_us(timestamp '{NOW}') - epoch_us({{0}})) / 86400000000.0)"
TODAY = "2026-10-20"


def _now():
    return F.lit(NOW).cast("timestamp")


def _memory(t: Tables) -> DataFrame:
    marks = t.jobs.join(t.job_state.select("global_id", "state", "updated_at"), "global_id").select("company", "state", "updated_at")
    blocked = t.jobs.where("location_flag = 'rejected' and score >= 95").select("company")
    return M.company_memory(marks, blocked, _now(), cooldown_days=90, window_days=90, most=2)


_MEMORY = f"""m as (select {_KEY.format('company')} as company_key, state, updated_at from jobs join job_state using (global_id)),
per as (select company_key, count(*) filter (state = 'applied' and {_AGE.format('updated_at')} between 0 and 90) as n_recent, max(updated_at) filter (state = 'rejected') as rejected_at from m where company_key <> '' group by 1),
bl as (select distinct {_KEY.format('company')} as company_key from jobs where location_flag = 'rejected' and score >= 95),
mem as (select coalesce(per.company_key, bl.company_key) as company_key, coalesce(n_recent, 0) as n_recent, rejected_at, bl.company_key is not null as is_blocked,
  bl.company_key is not null or coalesce({_AGE.format('rejected_at')} between 0 and 90, false) or coalesce(n_recent, 0) >= 2 as hides from per full join (select * from bl where company_key <> '') bl on per.company_key = bl.company_key)"""


@query(f"with {_MEMORY} select company_key, n_recent, strftime(rejected_at, '%Y-%m-%d') as rejected_on, is_blocked, hides from mem")
def f17_company_memory(t: Tables) -> DataFrame:
    return _memory(t).withColumn("rejected_on", F.date_format("rejected_at", "yyyy-MM-dd")).drop("rejected_at")


@query(f"with {_MEMORY} select row_id, company from raw_jobs where {_KEY.format('company')} is null or {_KEY.format('company')} not in (select company_key from mem where hides)")
def f18_not_hidden(t: Tables) -> DataFrame:
    return M.not_hidden(t.raw_jobs.select("row_id", "company"), _memory(t))


@query(f"with {_MEMORY} select j.global_id, s.state, n_recent, coalesce(hides, false) as hides, case when score >= 80 then 'strong' when score is not null then 'reject' end as band from (select *, {_KEY.format('company')} as k from jobs) j left join job_state s using (global_id) left join mem on k = company_key")
def j07_listing(t: Tables) -> DataFrame:
    j = t.jobs.select("global_id", "score", K.company_key(F.col("company")).alias("company_key"))
    out = j.join(t.job_state.select("global_id", "state"), "global_id", "left").join(_memory(t).select("company_key", "n_recent", "hides"), "company_key", "left")
    return out.select("global_id", "state", "n_recent", F.coalesce("hides", F.lit(False)).alias("hides"), N.band(F.col("score"), 80).alias("band"))


@query(f"with {_MEMORY} select company_key, case when is_blocked then 1 when hides then 2 else 3 end as kind, row_number() over (order by case when is_blocked then 1 when hides then 2 else 3 end, company_key) as pos from mem")
def w14_companies(t: Tables) -> DataFrame:
    from postmill.operators.ranking import positions

    kinds = _memory(t).select("company_key", F.when(F.col("is_blocked"), 1).when(F.col("hides"), 2).otherwise(3).alias("kind"))
    return positions(kinds, [F.col("kind"), F.col("company_key")], "pos")


#: Prices by model: for fresh, repeated and written tokens.
PRICES = [("model-a", 3, 1, 15), ("model-b", 1, 0, 5), ("model-c", 10, 2, 30)]
_CALLS = """calls as (select global_id, provider_used as model, length(reasoning) as input, length(title) as cached, coalesce(score, 0) as output, scored_at from jobs where scored_at is not null and reasoning is not null and title is not null),
prices as (select * from (values ('model-a', 3, 1, 15), ('model-b', 1, 0, 5), ('model-c', 10, 2, 30)) p(model, a, b, c)),
spent as (select calls.*, greatest(input - cached, 0) * a + cached * b + output * c as cost from calls left join prices using (model))"""


def _spent(t: Tables) -> DataFrame:
    calls = t.jobs.where("scored_at is not null and reasoning is not null and title is not null").select("global_id", F.col("provider_used").alias("model"), F.length("reasoning").alias("input"), F.length("title").alias("cached"), F.coalesce("score", F.lit(0)).alias("output"), "scored_at")
    return M.priced(calls, t.spark.createDataFrame(PRICES, "model string, input_price int, cached_price int, output_price int"))


@query(f"with {_CALLS} select global_id, model, cost from spent")
def a02_cost_per_call(t: Tables) -> DataFrame:
    return _spent(t).select("global_id", "model", "cost")


@query(f"with {_CALLS} select coalesce(sum(cost), 0)::bigint as spent, coalesce(sum(cost), 0) >= 0.8 * 50000 as warn, coalesce(sum(cost), 0) >= 50000 as over_limit, round(coalesce(sum(cost), 0) * 100.0 / 50000, 3) as limit_share from spent where {_DAY.format('scored_at')} = date '{TODAY}'")
def a02_today_spend(t: Tables) -> DataFrame:
    s = _spent(t).where(N.local_day(F.col("scored_at"), ZONE) == F.lit(TODAY).cast("date")).agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("bigint").alias("spent"))
    return s.select("spent", (F.col("spent") >= 40000).alias("warn"), (F.col("spent") >= 50000).alias("over_limit"), F.round(F.col("spent") * 100.0 / 50000, 3).alias("limit_share"))


@query(
    f"""with {_CALLS}, s as (select *, strftime({_DAY.format('scored_at')}, '%Y-%m-%d') as day from spent)
select case when grouping(day) = 0 then 'day' when grouping(model) = 0 then 'model' else 'total' end as level, day, model, count(*) as n_calls, sum(input)::bigint as input, sum(cached)::bigint as cached, sum(output)::bigint as output, sum(cost)::bigint as cost, round(sum(cached) * 100.0 / nullif(sum(input), 0), 3) as cached_share
from s group by grouping sets ((), (day), (model))"""
)
def a22_spend(t: Tables) -> DataFrame:
    return M.spend_by(_spent(t), "scored_at", ZONE).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"select {_KEY.format('company')} as company_key, count(*) as n_scored from jobs where scored_at >= timestamp '2026-10-01' and scored_at < timestamp '2026-10-21' and provider_used is not null group by 1")
def a04_scored_between(t: Tables) -> DataFrame:
    between = (F.col("scored_at") >= F.lit("2026-10-01").cast("timestamp")) & (F.col("scored_at") < F.lit("2026-10-21").cast("timestamp"))
    return t.jobs.where(between & F.col("provider_used").isNotNull()).groupBy(K.company_key(F.col("company")).alias("company_key")).agg(F.count("*").alias("n_scored"))


# A delivery log is read for what was sent: a delivery with rows is a success.
@query("select ats_type, strftime(max(last_processed_at) filter (row_count > 0), '%Y-%m-%d %H:%M:%S') as last_sent, count(*) filter (row_count > 0) as n_sent, count(*) filter (row_count = 0) as n_failed, coalesce(bool_or(row_count > 0 and last_processed_at >= timestamp '2026-10-19'), false) as sent_lately from slice_state group by 1")
def a06_last_sent(t: Tables) -> DataFrame:
    ok = F.col("row_count") > 0
    return t.slice_state.groupBy("ats_type").agg(
        F.date_format(F.max(F.when(ok, F.col("last_processed_at"))), "yyyy-MM-dd HH:mm:ss").alias("last_sent"), F.count_if(ok).alias("n_sent"), F.count_if(F.col("row_count") == 0).alias("n_failed"),
        F.coalesce(F.bool_or(ok & (F.col("last_processed_at") >= F.lit("2026-10-19").cast("timestamp"))), F.lit(False)).alias("sent_lately"),
    )


@query("with w as (select ats_type, coalesce(max(last_processed_at) filter (row_count > 0 and snapshot_no < 1), timestamp '2026-10-01') as since from slice_state group by 1) select global_id, ats_type from jobs join w using (ats_type) where scored_at > since")
def st04_digest_window(t: Tables) -> DataFrame:
    sent = F.when((F.col("row_count") > 0) & (F.col("snapshot_no") < 1), F.col("last_processed_at"))
    since = t.slice_state.groupBy("ats_type").agg(F.coalesce(F.max(sent), F.lit("2026-10-01").cast("timestamp")).alias("since"))
    return t.jobs.join(since, "ats_type").where("scored_at > since").select("global_id", "ats_type")


@query("select count(*) as n_rows, count(distinct global_id) as n_jobs from (select global_id from jobs where score >= 80 union all select global_id from jobs where eligibility_flag = 'uncertain' union all select global_id from jobs where location_flag = 'uncertain')")
def w17_digest_distinct(t: Tables) -> DataFrame:
    parts = [t.jobs.where(c).select("global_id") for c in ("score >= 80", "eligibility_flag = 'uncertain'", "location_flag = 'uncertain'")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(F.count("*").alias("n_rows"), F.count_distinct("global_id").alias("n_jobs"))


@query(f"select count(*) filter (score >= 80) as n_strong, count(*) filter (score >= 80 and {_DAY.format('scored_at')} = date '{TODAY}') as n_new, max(score) as best, count(distinct company) filter (score >= 80) as n_companies from jobs")
def a28_digest_stats(t: Tables) -> DataFrame:
    strong, today = F.col("score") >= 80, N.local_day(F.col("scored_at"), ZONE) == F.lit(TODAY).cast("date")
    return t.jobs.agg(F.count_if(strong).alias("n_strong"), F.count_if(strong & today).alias("n_new"), F.max("score").alias("best"), F.count_distinct(F.when(strong, F.col("company"))).alias("n_companies"))


# The outbox: jobs above a score, one message each; job_state tells how the last round went.
_OUTBOX = """o as (select global_id, case when status = 'delisted' then 'sent' else 'pending' end as status, score % 4 as n_attempts, scored_at from jobs where score >= 70 and scored_at is not null),
r as (select global_id, state = 'applied' as ok from job_state union all select global_id, false from jobs where score % 4 >= 2 and global_id not in (select global_id from job_state))"""


def _outbox(t: Tables) -> tuple[DataFrame, DataFrame]:
    box = t.jobs.where("score >= 70 and scored_at is not null").select("global_id", F.when(F.col("status") == "delisted", "sent").otherwise("pending").alias("status"), (F.col("score") % 4).alias("n_attempts"), "scored_at")
    marked = t.job_state.select("global_id", (F.col("state") == "applied").alias("ok"))
    refused = t.jobs.where("score % 4 >= 2").join(marked, "global_id", "left_anti").select("global_id", F.lit(False).alias("ok"))
    return box, marked.unionByName(refused)


@query(f"with {_OUTBOX} select global_id, case when status = 'pending' and ok then 'sent' when status = 'pending' and not ok and n_attempts + 1 >= 4 then 'failed' else status end as status, case when status = 'pending' and ok is not null then n_attempts + 1 else n_attempts end as n_attempts from o left join r using (global_id)")
def k14_outbox_round(t: Tables) -> DataFrame:
    box, outcome = _outbox(t)
    return M.after_round(box.select("global_id", "status", "n_attempts"), outcome, "global_id", rounds=4)


@query(f"with {_OUTBOX} select global_id, row_number() over (order by scored_at, global_id) as pos from o where status = 'pending' and n_attempts < 4")
def w21_pending(t: Tables) -> DataFrame:
    from postmill.operators.ranking import positions

    box, _ = _outbox(t)
    return positions(box.where("status = 'pending' and n_attempts < 4").select("global_id", "scored_at"), [F.col("scored_at"), F.col("global_id")], "pos").select("global_id", "pos")


@query(f"with {_OUTBOX} select o.global_id, case when j.ats_type in (select ats_type from slice_state where snapshot_no < 3) then o.status else 'suppressed' end as status from o join jobs j using (global_id)")
def st03_first_run(t: Tables) -> DataFrame:
    box, _ = _outbox(t)
    known = t.slice_state.where("snapshot_no < 3").select("ats_type").distinct().withColumn("known", F.lit(True))
    out = box.join(t.jobs.select("global_id", "ats_type"), "global_id").join(known, "ats_type", "left")
    return out.select("global_id", F.when(F.col("known"), F.col("status")).otherwise("suppressed").alias("status"))


@query("select row_id, case when location is null or trim(location) = '' then 'excluded_location' when title is null then 'excluded' when raw is null then 'delisted' else 'pending' end as status, case when location is null or trim(location) = '' then 'unresolved' end as location_reason, case when raw is null and title is not null and trim(location) <> '' then 'not_found' end as delist_reason, case when raw is null and title is not null and trim(location) <> '' then 'uncertain' else 'passed' end as eligibility_flag from raw_jobs")
def b01_rows_by_branch(t: Tables) -> DataFrame:
    r = t.raw_jobs.select("row_id", "title", F.nullif(F.trim("location"), F.lit("")).alias("place"), "raw")

    def built(where: str, status: str, location_reason=None, delist_reason=None, eligibility="passed") -> DataFrame:
        text = lambda v, name: F.lit(v).cast("string").alias(name)
        return r.where(where).select("row_id", text(status, "status"), text(location_reason, "location_reason"), text(delist_reason, "delist_reason"), text(eligibility, "eligibility_flag"))

    placed = "place is not null and title is not null"
    return (
        built("place is null", "excluded_location", location_reason="unresolved")
        .unionByName(built("place is not null and title is null", "excluded"))
        .unionByName(built(f"{placed} and raw is null", "delisted", delist_reason="not_found", eligibility="uncertain"))
        .unionByName(built(f"{placed} and raw is not null", "pending"))
    )


@query("select global_id, eligible::int as eligible, coalesce(array_to_string(matched_skills, '|'), '-') as skills, coalesce(len(missing_skills), -1) as n_missing, score from jobs")
def b05_round_trip(t: Tables) -> DataFrame:
    j = t.jobs.select("global_id", "eligible", "matched_skills", "missing_skills", "score")
    stored = j.select("global_id", F.col("eligible").cast("int").alias("eligible"), F.to_json("matched_skills").alias("m"), F.to_json("missing_skills").alias("x"), F.col("score").cast("string").alias("score"))
    back = stored.select("global_id", F.col("eligible").cast("boolean").alias("eligible"), X.json_list(F.col("m")).alias("m"), X.json_list(F.col("x")).alias("x"), F.col("score").cast("int").alias("score"))
    return back.select("global_id", F.col("eligible").cast("int").alias("eligible"), F.coalesce(F.array_join("m", "|"), F.lit("-")).alias("skills"), F.coalesce(F.size("x"), F.lit(-1)).cast("bigint").alias("n_missing"), "score")


@query("select row_id, case when requisition_id is null or trim(requisition_id) = '' or lower(trim(requisition_id)) = 'nan' then null else trim(requisition_id) end as requisition_id, case when starts_with(ltrim(raw), '{') then raw end as raw from raw_jobs")
def b02_raw_record(t: Tables) -> DataFrame:
    return t.raw_jobs.select("row_id", X.present(F.col("requisition_id")).alias("requisition_id"), F.when(F.startswith(F.ltrim("raw"), F.lit("{")), F.col("raw")).alias("raw"))


@query("select global_id, coalesce(array_to_string(list_filter([global_id, nullif(trim(title), ''), nullif(trim(company), ''), nullif(trim(location), '')], lambda x: x is not null), ' | '), '') as payload from jobs")
def b03_payload(t: Tables) -> DataFrame:
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t.jobs.select("global_id", F.concat_ws(" | ", "global_id", part("title"), part("company"), part("location")).alias("payload"))


@query("select provider_used, sum(u.input)::bigint as input, sum(u.cached)::bigint as cached, sum(u.output)::bigint as output from (select provider_used, case provider_used when 'model-a' then {'input': length(title) + 7, 'cached': 7, 'output': score} when 'model-b' then {'input': length(title), 'cached': 0, 'output': score} else {'input': coalesce(length(title), 0), 'cached': 0, 'output': coalesce(score, 0)} end as u from jobs where provider_used is not null and score is not null and title is not null) group by 1")
def b15_usage(t: Tables) -> DataFrame:
    usage = t.jobs.where("provider_used is not null and score is not null and title is not null").select(
        "provider_used",
        F.when(F.col("provider_used") == "model-a", F.struct(F.length("title").alias("input_tokens"), F.lit(7).alias("cache_read"), F.lit(None).cast("int").alias("prompt"), F.lit(None).cast("int").alias("total"), F.col("score").alias("out")))
        .when(F.col("provider_used") == "model-b", F.struct(F.lit(None).cast("int").alias("input_tokens"), F.lit(None).cast("int").alias("cache_read"), F.length("title").alias("prompt"), F.lit(None).cast("int").alias("total"), F.col("score").alias("out")))
        .otherwise(F.struct(F.lit(None).cast("int").alias("input_tokens"), F.lit(None).cast("int").alias("cache_read"), F.lit(None).cast("int").alias("prompt"), (F.length("title") + F.col("score")).alias("total"), F.col("score").alias("out")))
        .alias("u"),
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    given = F.coalesce(F.col("u.input_tokens") + n("u.cache_read"), F.col("u.prompt"), F.col("u.total") - F.col("u.out"))
    return usage.groupBy("provider_used").agg(F.sum(given).alias("input"), F.sum(n("u.cache_read")).alias("cached"), F.sum(n("u.out")).alias("output"))


# The manifest is what a state table knows of the latest deliveries.
@query("select ats_type, slice_file, last_sha256, row_count from (select * from slice_state qualify row_number() over (partition by slice_file order by snapshot_no desc) = 1) where row_count > 0 and last_sha256 is not null and ats_type not in ('saltbox', 'inkwell')")
def s06_relevant_slices(t: Tables) -> DataFrame:
    from postmill.sources.tables import without

    w = Window.partitionBy("slice_file").orderBy(F.desc("snapshot_no"))
    latest = t.slice_state.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and row_count > 0 and last_sha256 is not null")
    return without(latest, "ats_type", ["saltbox", "inkwell"]).select("ats_type", "slice_file", "last_sha256", "row_count")


@query("select m.ats_type, count(*) filter (s.last_sha256 is distinct from m.last_sha256) as n_outstanding, count(*) as n_files from (select * from slice_state where snapshot_no = 4) m left join (select * from slice_state where snapshot_no = 3) s using (slice_file) group by 1")
def j09_outstanding(t: Tables) -> DataFrame:
    before = t.slice_state.where("snapshot_no = 3").select("slice_file", F.col("last_sha256").alias("old"))
    return t.slice_state.where("snapshot_no = 4").join(before, "slice_file", "left").groupBy("ats_type").agg(F.count_if(~F.col("last_sha256").eqNullSafe(F.col("old"))).alias("n_outstanding"), F.count("*").alias("n_files"))


@query("with l as (select ats_type, row_number() over (order by sum(row_count) desc, ats_type) as rank, max(snapshot_no) < 4 as behind from slice_state group by 1) select a.ats_type, (select count(*) from l b where b.rank < a.rank and b.behind) as n_ahead, (select count(*) from l b where b.rank < a.rank and b.behind) > 0 as yields from l a")
def w07_yields(t: Tables) -> DataFrame:
    s = t.slice_state.groupBy("ats_type").agg(F.sum("row_count").alias("n"), (F.max("snapshot_no") < 4).alias("behind"))  # one row a source
    w = Window.orderBy(F.desc("n"), "ats_type").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.col("behind").cast("bigint")).over(w), F.lit(0))
    return s.select("ats_type", ahead.alias("n_ahead"), (ahead > 0).alias("yields"))


@query("select row_id, global_id from raw_jobs where global_id in (select global_id from jobs)")
def j15_known_ids(t: Tables) -> DataFrame:
    return t.raw_jobs.select("row_id", "global_id").join(t.jobs.select("global_id"), "global_id", "left_semi")


@query("select ats_type, count(*) as n from jobs where status = 'pending' and global_id not in (select global_id from job_state) and ats_type in ('tallgrass', 'gatepost') group by 1")
def j13_pending_sweep(t: Tables) -> DataFrame:
    return t.jobs.where("status = 'pending'").where(F.col("ats_type").isin("tallgrass", "gatepost")).join(t.job_state.select("global_id"), "global_id", "left_anti").groupBy("ats_type").agg(F.count("*").alias("n"))


@query("select stage, array_to_string(list_distinct_ordered, ',') as ids from (select stage, list(job_ref order by first_id) as list_distinct_ordered from (select stage, job_ref, min(error_id) as first_id from errors where job_ref is not null group by all) group by 1)")
def w26_unique_ids(t: Tables) -> DataFrame:
    first = t.errors.where("job_ref is not null").groupBy("stage", "job_ref").agg(F.min("error_id").alias("i"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "job_ref"))), lambda x: x["job_ref"])  # the distinct postings that one stage failed on, for one line of a report
    return first.groupBy("stage").agg(F.array_join(ordered, ",").alias("ids"))


@query("select edit, array_to_string(l, ',') as queue from (values ('run_next', ['c', 'a', 'b', 'd']), ('hold', ['a', 'b', 'd']), ('release', ['a', 'b', 'c', 'd']), ('clear', []::varchar[])) v(edit, l)")
def w24_priority_edits(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(x) for x in "abcd"])
    c = F.lit("c")
    edits = {"run_next": F.array_prepend(F.array_remove(q, c), c), "hold": F.array_remove(q, c), "release": F.array_distinct(F.array_sort(F.array_append(F.array_remove(q, c), c))), "clear": F.slice(q, 1, 0)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("edit"), F.array_join(v, ",").alias("queue")) for k, v in edits.items()]))
    return t.spark.range(1).select(rows.alias("r")).select("r.*")


@query("select ats_type, greatest(4, 2 * count(*)) as most_yields from slice_state where snapshot_no = 4 group by 1")
def w25_most_yields(t: Tables) -> DataFrame:
    return t.slice_state.where("snapshot_no = 4").groupBy("ats_type").agg(F.greatest(F.lit(4), 2 * F.count("*")).cast("bigint").alias("most_yields"))


@query("select global_id, state, updated_at < timestamp '2026-09-01' as old from job_state where state <> 'declined' or global_id in (select global_id from jobs where score >= 60)")
def k07_clear_marks(t: Tables) -> DataFrame:
    doomed = t.job_state.where("state = 'declined'").join(t.jobs.where("score >= 60").select("global_id"), "global_id", "left_anti")
    return U.remove_rows(t.job_state, doomed, "global_id").select("global_id", "state", (F.col("updated_at") < F.lit("2026-09-01").cast("timestamp")).alias("old"))


@query("select global_id, state in ('applied', 'declined', 'rejected') and (note is null or state = 'declined' and note in ('pay', 'place', 'stack')) as valid from job_state")
def k08_mark_check(t: Tables) -> DataFrame:
    known = F.col("state").isin("applied", "declined", "rejected")
    noted = F.col("note").isNull() | ((F.col("state") == "declined") & F.col("note").isin("pay", "place", "stack"))
    return t.job_state.select("global_id", (known & noted).alias("valid"))


@query(f"select company_key, max(n) as n from (select {_KEY.format('company')} as company_key, count(*) as n from jobs where score < 30 group by 1) where company_key not in (select {_KEY.format('company')} from jobs where score >= 90 and company is not null) group by 1")
def k09_block_unblock(t: Tables) -> DataFrame:
    key = K.company_key(F.col("company")).alias("company_key")
    blocked = t.jobs.where("score < 30").groupBy(key).agg(F.count("*").alias("n")).where("company_key is not null")
    return U.remove_rows(blocked, t.jobs.where("score >= 90 and company is not null").select(key).distinct(), "company_key")


@query("select slice_file, last_sha256, snapshot_no from (select * from slice_state where snapshot_no <= 4 qualify row_number() over (partition by slice_file order by snapshot_no desc) = 1) where row_count > 0")
def k04_state_put_delete(t: Tables) -> DataFrame:
    state = t.slice_state.where("snapshot_no = 0").select("slice_file", "last_sha256", "snapshot_no", "row_count")
    for n in range(1, 5):
        state = U.put_rows(state, t.slice_state.where(F.col("snapshot_no") == n).select(*state.columns), "slice_file")
    return U.remove_rows(state, state.where("row_count = 0 or row_count is null"), "slice_file").select("slice_file", "last_sha256", "snapshot_no")


@query("select ats_type as k, arg_max(last_sha256, (last_processed_at, slice_file)) as v from slice_state where last_sha256 is not null group by 1")
def k12_key_value(t: Tables) -> DataFrame:
    return t.slice_state.where("last_sha256 is not null").groupBy(F.col("ats_type").alias("k")).agg(F.max_by("last_sha256", F.struct("last_processed_at", "slice_file")).alias("v"))


@query("select stage, count(*) as n, max(error_id) as last_id from (select error_id, stage from errors union all select row_id + (select max(error_id) + 1 from errors), 'fetch' from raw_jobs where batch_no = 7) group by 1")
def k05_append_log(t: Tables) -> DataFrame:
    last = t.errors.agg(F.max("error_id").alias("m"))
    new = t.raw_jobs.where("batch_no = 7").join(F.broadcast(last)).select((F.col("row_id") + F.col("m") + 1).alias("error_id"), F.lit("fetch").alias("stage"))  # one row of one number
    return t.errors.select("error_id", "stage").unionByName(new).groupBy("stage").agg(F.count("*").alias("n"), F.max("error_id").alias("last_id"))


@query("select global_id, status from jobs where ats_type not in ('inkwell', 'saltbox') or global_id in (select global_id from job_state)")
def m02_purge_sources(t: Tables) -> DataFrame:
    doomed = t.jobs.where(F.col("ats_type").isin("inkwell", "saltbox")).join(t.job_state.select("global_id"), "global_id", "left_anti")
    return U.remove_rows(t.jobs, doomed, "global_id").select("global_id", "status")


@query(f"with {_MEMORY} select global_id from jobs where {_KEY.format('company')} is null or {_KEY.format('company')} not in (select company_key from mem where is_blocked) or global_id in (select global_id from job_state)")
def m01_purge_companies(t: Tables) -> DataFrame:
    blocked = _memory(t).where("is_blocked").select("company_key")
    doomed = t.jobs.select("global_id", K.company_key(F.col("company")).alias("company_key")).join(blocked, "company_key", "left_semi").join(t.job_state.select("global_id"), "global_id", "left_anti")
    return U.remove_rows(t.jobs, doomed, "global_id").select("global_id")


@query(f"select part, count(*) as n from (select case when {_AGE.format('coalesce(scored_at, delisted_at)')} > 30 and global_id not in (select global_id from job_state) then 'tombstone' else 'kept' end as part from jobs) group by 1")
def m04_purge_stale(t: Tables) -> DataFrame:
    old = t.jobs.where(N.age_days(F.coalesce("scored_at", "delisted_at"), _now()) > 30).join(t.job_state.select("global_id"), "global_id", "left_anti").select("global_id")
    kept, graves = U.prune(t.jobs.select("global_id"), t.jobs.select("global_id").where("false"), old, "global_id")
    return kept.select(F.lit("kept").alias("part")).unionAll(graves.select(F.lit("tombstone").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@query(f"select ats_type, count(*) filter (score >= 60) as n_short, count(*) filter (score >= 80) as n_strong from jobs group by 1")
def a13_short_by_source(t: Tables) -> DataFrame:
    return t.jobs.groupBy("ats_type").agg(F.count_if(F.col("score") >= 60).alias("n_short"), F.count_if(F.col("score") >= 80).alias("n_strong"))


@query(f"select span, count(*) filter (inside) as n_seen, count(*) filter (inside and score is not null) as n_scored, count(*) filter (inside and score >= 80) as n_strong from (select score, unnest(['today', 'week', 'all']) as span, unnest([coalesce({_DAY.format('scored_at')} = date '{TODAY}', false), coalesce({_DAY.format('scored_at')} > date '2026-10-13' and {_DAY.format('scored_at')} <= date '{TODAY}', false), true]) as inside from jobs) group by 1")
def a14_funnel_windows(t: Tables) -> DataFrame:
    day = N.local_day(F.col("scored_at"), ZONE)
    spans = {"today": day == F.lit(TODAY).cast("date"), "week": (day > F.lit("2026-10-13").cast("date")) & (day <= F.lit(TODAY).cast("date")), "all": F.lit(True)}
    counts = [F.count_if(inside & c).alias(f"{span}_{name}") for span, inside in spans.items() for name, c in (("seen", F.lit(True)), ("scored", F.col("score").isNotNull()), ("strong", F.col("score") >= 80))]
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("span"), *[F.col(f"{s}_{n}").alias(f"n_{n}") for n in ("seen", "scored", "strong")]) for s in spans]))
    return t.jobs.agg(*counts).select(rows.alias("r")).select("r.*")  # one pass, then three rows


_STAGES = {"fetched": "true", "titled": "status <> 'excluded'", "placed": "status not in ('excluded', 'excluded_location')", "stacked": "status not in ('excluded', 'excluded_location', 'excluded_stack')", "sponsored": "status not like 'excluded%'", "scored": "score is not null", "short": "score >= 60", "strong": "score >= 80"}


@query(" union all ".join(f"select '{k}' as stage, count(*) filter ({v}) as n from jobs" for k, v in {"fetched": "true", "titled": "status <> 'excluded'", "placed": "status not in ('excluded', 'excluded_location')", "stacked": "status not in ('excluded', 'excluded_location', 'excluded_stack')", "sponsored": "not starts_with(status, 'excluded')", "scored": "score is not null", "short": "score >= 60", "strong": "score >= 80"}.items()))
def a15_eight_stages(t: Tables) -> DataFrame:
    counts = t.jobs.agg(*[F.count_if(F.expr(c)).alias(s) for s, c in _STAGES.items()])
    return counts.unpivot([], list(_STAGES), "stage", "n")


@query("select location_flag, eligibility_flag, coalesce(sponsorship, '-') as stance, count(*) as n from jobs group by all")
def a40_verdicts(t: Tables) -> DataFrame:
    return t.jobs.groupBy("location_flag", "eligibility_flag", F.coalesce("sponsorship", F.lit("-")).alias("stance")).agg(F.count("*").alias("n"))


@query("select provider_used, case when score >= 80 then 'strong' when score >= 60 then 'maybe' else 'reject' end as band, count(*) as n from jobs where score is not null group by all")
def a41_band_summary(t: Tables) -> DataFrame:
    band = F.when(F.col("score") >= 80, "strong").when(F.col("score") >= 60, "maybe").otherwise("reject")
    return t.jobs.where("score is not null").groupBy("provider_used", band.alias("band")).agg(F.count("*").alias("n"))


@query(f"select strftime({_DAY.format('updated_at')}, '%Y-%m-%d') as day, count(*) filter (state = 'applied') as applied, count(*) filter (state = 'declined') as declined, round(count(*) filter (state = 'applied') * 100.0 / count(*), 3) as rate from job_state group by 1")
def a31_decisions_by_day(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return t.job_state.groupBy(F.date_format(N.local_day(F.col("updated_at"), ZONE), "yyyy-MM-dd").alias("day")).agg(n("applied").alias("applied"), n("declined").alias("declined"), F.round(n("applied") * 100.0 / F.count("*"), 3).alias("rate"))


@query(f"select strftime((scored_at at time zone 'UTC') at time zone '{ZONE}', '%Y-%m-%d %H') as hour, count(*) as n, sum(case when score >= 80 then 1 else 0 end)::bigint as n_strong from jobs where scored_at is not null group by 1")
def a27_by_hour(t: Tables) -> DataFrame:
    hour = F.date_format(F.from_utc_timestamp("scored_at", ZONE), "yyyy-MM-dd HH")
    return t.jobs.where("scored_at is not null").groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 80).alias("n_strong"))


@query("select ats_type, location_reason, count(*) as n, row_number() over (partition by location_reason order by count(*) desc, ats_type) as place from jobs group by 1, 2 qualify place <= 5")
def a26_top_sources(t: Tables) -> DataFrame:
    w = Window.partitionBy("location_reason").orderBy(F.desc("n"), "ats_type")
    return t.jobs.groupBy("ats_type", "location_reason").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 5")


@query("select stage, error_id from errors qualify row_number() over (partition by stage order by error_id desc) <= 15")
def w11_recents(t: Tables) -> DataFrame:
    w = Window.partitionBy("stage").orderBy(F.desc("error_id"))
    return t.errors.select("stage", "error_id").withColumn("rn", F.row_number().over(w)).where("rn <= 15").drop("rn")


@query("select * from (select 'place' as held, global_id from jobs where status = 'excluded_location' order by global_id desc limit 500) union all select * from (select 'stack', global_id from jobs where status = 'excluded_stack' order by global_id desc limit 500) union all select * from (select 'sponsor', global_id from jobs where status = 'excluded_sponsorship' order by global_id desc limit 500)")
def w13_held_lists(t: Tables) -> DataFrame:
    part = lambda status, name: t.jobs.where(F.col("status") == status).orderBy(F.desc("global_id")).limit(500).select(F.lit(name).alias("held"), "global_id")
    return part("excluded_location", "place").unionAll(part("excluded_stack", "stack")).unionAll(part("excluded_sponsorship", "sponsor"))


@query(rf"select distinct company, array_to_string(list_sort(list_distinct(list_filter([trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')), replace(trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')), ' ', '')], lambda x: x <> ''))), '|') as forms from raw_jobs where company is not null")
def n07_entry_forms(t: Tables) -> DataFrame:
    return t.raw_jobs.where("company is not null").select("company", F.array_join(F.sort_array(K.entry_forms(F.col("company"))), "|").alias("forms")).distinct()


@query(rf"select distinct company, array_to_string(list_sort(list_distinct(list_filter([trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')), replace(trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')), ' ', ''), {_KEY.format('company')}, regexp_extract(lower(trim(company)), '^([a-z0-9-]+)\.[a-z0-9.-]+$', 1)], lambda x: x <> ''))), '|') as forms from jobs where company is not null")
def n06_candidates(t: Tables) -> DataFrame:
    return t.jobs.where("company is not null").select("company", F.array_join(F.sort_array(K.candidates(F.col("company"))), "|").alias("forms")).distinct()


@query(r"select row_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(description, '<[^>]*>', ' ', 'g'), '’', ''''), '[*_#`]', '', 'g'), '(?i)\b(u)\.(s)\.(a\.)?|\b(e)\.(g)\.|\b(i)\.(e)\.|\b(et)(c)\.', '\1\2\4\5\6\7\8\9', 'g'), '\s+', ' ', 'g')) as plain from raw_jobs where description is not null")
def f14_normalised(t: Tables) -> DataFrame:
    return t.raw_jobs.where("description is not null").select("row_id", X.normalised(F.col("description")).alias("plain"))


@query(r"""select row_id, list_filter(string_split_regex(regexp_replace(regexp_replace(description, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '[.;?!] '), lambda s: regexp_matches(s, '(?i)\bbachelor|degree|diploma'))[1] as sentence from raw_jobs where regexp_matches(description, '(?i)\bbachelor|degree|diploma')""")
def f13_sentence(t: Tables) -> DataFrame:
    p = r"(?i)\bbachelor|degree|diploma"
    return t.raw_jobs.where(F.col("description").rlike(p)).select("row_id", X.sentence_with(F.col("description"), p).alias("sentence"))


@query("select regexp_matches(coalesce(title, ''), '(?i)\\b(?:sr\\.?|senior|lead) [a-z]+|\\bstaff\\b') as senior, count(*) as n from raw_jobs group by 1")
def x11_pattern_alternation(t: Tables) -> DataFrame:
    return t.raw_jobs.groupBy(F.coalesce(F.col("title"), F.lit("")).rlike(X.any_pattern([r"\b(?:sr\.?|senior|lead) [a-z]+", r"\bstaff\b"])).alias("senior")).agg(F.count("*").alias("n"))


@query(f"select global_id, case when scored_at is null then 'undated' when {_AGE.format('scored_at')} < 0 then 'undated' when {_AGE.format('scored_at')} < 1 then 'today' when {_AGE.format('scored_at')} < 2 then 'yesterday' else floor({_AGE.format('scored_at')})::int || ' days' end as age from jobs")
def x12_age_label(t: Tables) -> DataFrame:
    return t.jobs.select("global_id", N.age_label(F.col("scored_at"), _now()).alias("age"))


@query("select ats_type, max(epoch_us(last_processed_at)) - min(epoch_us(last_processed_at)) as us, (max(epoch_us(last_processed_at)) - min(epoch_us(last_processed_at))) // 3600000000 || 'h ' || ((max(epoch_us(last_processed_at)) - min(epoch_us(last_processed_at))) // 60000000) % 60 || 'm' as took from slice_state group by 1")
def x13_run_duration(t: Tables) -> DataFrame:
    us = (F.unix_micros(F.max(F.col("last_processed_at").cast("timestamp"))) - F.unix_micros(F.min(F.col("last_processed_at").cast("timestamp")))).alias("us")
    return t.slice_state.groupBy("ats_type").agg(us).select("ats_type", "us", N.duration_label(F.col("us")).alias("took"))


@query("select title, count(*) as n, any_value(case when regexp_matches(lower(title), 'engineer|developer') then 'build' when regexp_matches(lower(title), 'nurse|clinical') then 'care' else 'other' end) as route from raw_jobs where title is not null group by 1")
def r03_route_once(t: Tables) -> DataFrame:
    titles = t.raw_jobs.where("title is not null").groupBy("title").agg(F.count("*").alias("n"))  # each title is routed once, however many rows have it
    return titles.withColumn("route", F.when(F.lower("title").rlike("engineer|developer"), "build").when(F.lower("title").rlike("nurse|clinical"), "care").otherwise("other"))


@query("select slice_file, snapshot_no, count(*) as n, min(slice_pos) as first_pos, max(slice_pos) as last_pos from (select * from slice_rows qualify row_number() over (partition by slice_file, snapshot_no order by slice_pos, global_id) <= 50) group by all")
def s12_sample(t: Tables) -> DataFrame:
    w = Window.partitionBy("slice_file", "snapshot_no").orderBy("slice_pos", "global_id")
    head = t.slice_rows.select("slice_file", "snapshot_no", "slice_pos", "global_id").withColumn("rn", F.row_number().over(w)).where("rn <= 50")
    return head.groupBy("slice_file", "snapshot_no").agg(F.count("*").alias("n"), F.min("slice_pos").alias("first_pos"), F.max("slice_pos").alias("last_pos"))


@query("select row_id, ats_type, global_id, title, company, location, null::int as experience from raw_jobs where ats_type not in ('saltbox')")
def s01_slice_scan(t: Tables) -> DataFrame:
    return t.raw_jobs.where("ats_type not in ('saltbox')").select("row_id", "ats_type", "global_id", "title", "company", "location", F.lit(None).cast("int").alias("experience"))


@query("select a.ats_type, count(s.slice_file) as n_files, count(s.slice_file) > 0 and count(s.slice_file) = count(s.last_sha256) as ready from ats_sources a left join slice_state s on s.ats_type = a.ats_type and s.snapshot_no = 4 group by 1")
def s16_sources_ready(t: Tables) -> DataFrame:
    files = t.slice_state.where("snapshot_no = 4").select("ats_type", "slice_file", "last_sha256")
    return t.ats_sources.select("ats_type").join(files, "ats_type", "left").groupBy("ats_type").agg(F.count("slice_file").alias("n_files"), ((F.count("slice_file") > 0) & (F.count("slice_file") == F.count("last_sha256"))).alias("ready"))


@query("select row_id, coalesce(case when json_valid(raw) then json_extract_string(raw, '$.dept') end, '') as dept from raw_jobs")
def s18_json_or_empty(t: Tables) -> DataFrame:
    return t.raw_jobs.select("row_id", F.coalesce(F.from_json("raw", "dept string")["dept"], F.lit("")).alias("dept"))
