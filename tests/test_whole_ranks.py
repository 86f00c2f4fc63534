"""Queries that rank whole tables, over small tables of their own."""

import datetime

from postmill.plans import registry


def run(spark, folder, query, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return registry.queries()[query](spark, str(folder)).collect()


def test_w15_digest_has_every_job_since_the_date_unscored_last(spark, tmp_path):
    at = datetime.datetime(2026, 9, 20)
    jobs = [(f"s{i:03}", i % 7, at, "2026-01-01T00:00:00Z") for i in range(260)]
    jobs += [("old", 99, datetime.datetime(2026, 8, 31, 23, 59, 59), "2026-09-09T00:00:00Z"), ("edge", 50, datetime.datetime(2026, 9, 1), None)]
    jobs += [("u2", None, None, "2026-08-31T17:00:00-07:00"), ("u1", None, None, "1790000000"), ("u3", None, None, "2026-08-31 23:59:59Z"), ("u4", None, None, "NaT"), ("u5", None, None, None), ("u6", None, None, "2026-11-01 01:30:00"), ("u7", None, None, "2026-03-08 02:30:00")]
    got = run(spark, tmp_path, "w15_digest", jobs=(jobs, "global_id string, score int, scored_at timestamp, first_seen_at string"))
    want = ["edge", *[g for g, *_ in sorted(jobs[:260], key=lambda r: (-r[1], r[0]))], "u1", "u2", "u6"]
    assert [g for _, g in sorted((r.pos, r.global_id) for r in got)] == want
    assert sorted(r.pos for r in got) == list(range(1, len(want) + 1))


def test_w19_blanks_last_has_every_row(spark, tmp_path):
    rows = [(i, i % 5, ("Ulm", "Köln", "Aalen")[i % 3]) for i in range(400)] + [(1000, 3, None), (1001, 3, ""), (1002, 1, "  "), (1003, 3, "Zug")]
    got = run(spark, tmp_path, "w19_blanks_last", raw_jobs=(rows, "row_id bigint, batch_no int, location string"))
    named = [r for _, places in (("Zug", ["Zug"]), ("Ulm", ["Ulm"]), ("K", ["Köln"]), ("A", ["Aalen"])) for r in sorted(i for i, _, x in rows if x in places)]
    assert [r.row_id for r in sorted(got, key=lambda r: r.pos)] == named + [1000, 1001, 1002]
    assert sorted(r.pos for r in got) == list(range(1, len(rows) + 1))


def test_w20_group_sort_has_every_company_unscored_last(spark, tmp_path):
    jobs = [(f"c{i:03}", i % 50) for i in range(150) for _ in range(1 + i % 2)] + [("b", None), ("B", None), ("a", None), ("two", None), ("two", None), (None, None)]
    got = run(spark, tmp_path, "w20_group_sort", jobs=(jobs, "company string, score int"))
    scored = sorted({(c, s) for c, s in jobs if s is not None}, key=lambda x: (-x[1], -sum(c == x[0] for c, _ in jobs), x[0]))
    assert [r.company for r in sorted(got, key=lambda r: r.pos)] == [c for c, _ in scored] + ["two", "a", "B", "b", None]
    assert sorted(r.pos for r in got) == list(range(1, 156))
    assert {(r.company, r.n, r.best) for r in got if r.company in ("two", "c001")} == {("two", 2, None), ("c001", 2, 1)}
