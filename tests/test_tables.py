import hashlib
import json

import pytest
from pyspark.sql import functions as F

from postmill.operators import dedupe as D
from postmill.operators import ranking as G
from postmill.operators import summaries as S
from postmill.operators import upsert as U
from postmill.sinks import tables as K
from postmill.sources import tables as T

JOB = "k string, status string, score int, seen string"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_guarded_upsert(spark):
    old = spark.createDataFrame([("a", "scored", 1, "t0"), ("b", "pending", None, "t0"), ("c", "delisted", 3, "t0"), ("d", None, 4, "t0")], JOB)
    new = spark.createDataFrame([("a", "failed", 9, "t1"), ("b", "failed", 8, "t1"), ("c", "scored", 7, "t1"), ("d", "failed", 6, "t1"), ("e", "failed", None, "t1")], JOB)
    assert rows(U.guarded_upsert(old, new, "k", ["seen"], "status", ["scored", "delisted"])) == {("a", "scored", 1, "t0"), ("b", "failed", 8, "t0"), ("c", "scored", 7, "t0"), ("d", "failed", 6, "t0"), ("e", "failed", None, "t1")}


def test_other_changes(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert rows(U.put_rows(old, new, "k")) == {("a", 1), ("b", 9), ("c", 3)}
    assert rows(U.insert_absent(old, new, "k")) == {("a", 1), ("b", 2), ("c", 3)}
    assert rows(U.set_columns(old, new, "k", ["v"])) == {("a", 1), ("b", 9)}
    kept, graves = U.prune(old, new, old.where("k = 'a'"), "k")
    assert rows(kept) == {("b", 2)} and rows(graves) == {("b", 9), ("c", 3), ("a", 1)}


def test_dedupe(spark):
    schema = "global_id string, requisition_id string, posted_at string, company string, location string, slice_pos bigint"
    batch = [("g1", "r1", None, "c", "l", 0), ("g1", "r1", "2026", "c", "l", 1), ("g2", "r1", "2026", "c", "l", 2), ("g3", None, None, "c", "l", 3), ("g4", None, None, "c", "l", 4), ("g5", "r5", None, "c", None, 5), ("g6", "r6", None, "c", "l", 6), (None, "r7", None, "c", "l", 7)]
    seen = [("g6", None, None, None, None, 0), ("x", "r5", None, "c", None, 0)]
    b, s = spark.createDataFrame(batch, schema), spark.createDataFrame(seen, schema)
    assert {(r.global_id, r.slice_pos) for r in D.dedupe(b, s, s).collect()} == {("g1", 1), ("g3", 3), ("g4", 4), (None, 7)}
    assert D.dedupe(b.where("false"), s, s).count() == 0


def test_quota_and_precedence(spark):
    df = spark.createDataFrame([("c", 5, 1), ("c", 9, 2), ("c", 9, 3), ("", 1, 4), (None, 1, 5), ("d", None, 6)], "company string, score int, pos int")
    used = spark.createDataFrame([("c", 1)], "grp string, n_used int")
    got = {r.pos: r.takes for r in G.quota(df, F.col("company"), [F.col("score").desc_nulls_last(), F.col("pos")], 2, used).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: True}
    a, b = (spark.createDataFrame(x, "k string, at int") for x in ([("x", 1), ("y", 1)], [("x", 0), ("x", 5)]))
    assert rows(G.precedence([a, b], "k", F.col("at"))) == {("x", 5), ("y", 1)}
    s = spark.createDataFrame([("b",), ("",), (None,), ("a",)], "v string")
    assert [r.v for r in s.orderBy(G.blanks_last("v", True)).limit(2).collect()] == ["b", "a"]


def test_summaries(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", None)], "g string, h string")
    assert rows(S.complete_counts(df, "g", ["a", "z"])) == {("a", 2), ("z", 0)}
    assert rows(S.singles_together(df, "g")) == {("a", 2), ("(one each)", 2)}
    assert rows(S.singles_together(df.where("g != 'c'"), "g")) == {("a", 2), ("b", 1)}
    assert rows(S.tree(df, ["g", "h"], [F.count("*").alias("n")])) == {("a", None, 2, 1), ("b", None, 1, 1), ("c", None, 1, 1), ("a", "x", 1, 2), ("a", "y", 1, 2), ("b", "x", 1, 2), ("c", None, 1, 2)}
    assert rows(S.transitions(df.where("h = 'x'"), df.where("h = 'y'"), "g", "h")) == {("x", "y", 1), ("x", None, 1)}
    assert [tuple(r) for r in S.most_common(df, "g", 2).collect()] == [("a", 2), ("b", 1)]


def test_sources(spark, tmp_path):
    p = str(tmp_path / "slice")
    spark.createDataFrame([(7, "c", True, "extra")], "ats_id bigint, company string, is_remote boolean, other string").write.parquet(p)
    r = T.read_slice(spark, p).first()
    assert (r.ats_id, r.company, r.is_remote, r.experience, r.description) == ("7", "c", "true", None, None) and "other" not in r
    m = tmp_path / "manifest.json"
    m.write_text(json.dumps({"by_ats": {"a": {"csv": "a.csv", "sha256": "s1", "parquet": "a.pq", "parquet_sha256": "s2", "rows": 5}, "b": {"csv": "b.csv", "sha256": "s3", "rows": 2}, "c": {"csv": "c.csv", "sha256": "s4", "rows": 0}, "d": {"csv": None, "sha256": "s5", "rows": 1}}}))
    listed = T.without(T.read_manifest(spark, str(m)), "source", ["zzz"])
    assert {(r.source, r.url, r.sha256) for r in listed.collect()} == {("a", "a.pq", "s2"), ("b", "b.csv", "s3")}
    state = spark.createDataFrame([("a", "s2"), ("b", "old")], "source string, last_sha256 string")
    assert {r.source for r in T.changed(listed, state).collect()} == {"b"}
    assert T.file_hashes(spark, str(m)).first().sha256 == hashlib.sha256(m.read_bytes()).hexdigest()


def test_versions_and_csv(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert K.current(spark, root) is None
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", None, None)], "k string, v int, l array<string>")
    K.write_version(df.limit(0), root)
    K.write_version(df, root)
    assert K.current(spark, root).count() == 2
    text = K.csv_rows(df.orderBy(F.col("v").desc_nulls_last()), lists=("l",))
    path = K.export_csv(text, str(tmp_path / "out.csv"))
    assert K.export_csv(text, path) == path
    raw = (tmp_path / "out.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\xef\xbb\xbf") == 1
    assert raw.decode("utf-8-sig").splitlines()[:3] == ['"k","v","l"', '"a","1","x; y"', '"b","",""']
    assert K.export_csv(text.drop("l"), path).endswith("out_v2.csv")


def test_stream(spark, tmp_path):
    from postmill.streaming.incremental import deliver, new_postings

    schema = "global_id string, posted_at string, row_id bigint"
    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    for part in ([("a", None, 1), ("a", "2026", 2), (None, None, 3)], [("a", "2025", 4), ("b", None, 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        new_postings(spark.readStream.schema(schema).parquet(src), root).awaitTermination()
    assert {(r.global_id, r.row_id) for r in spark.read.parquet(f"{root}/accepted").collect()} == {("a", 2), ("b", 5)}
    box = spark.createDataFrame([("a", "p", "pending", 0), ("b", "bad", "pending", 0), ("c", "bad", "pending", 2), ("d", "p", "sent", 1)], "global_id string, payload string, status string, n_attempts bigint")
    assert {(r.global_id, r.status, r.n_attempts) for r in deliver(box, lambda k, p: p != "bad").collect()} == {("a", "sent", 1), ("b", "pending", 1), ("c", "failed", 3), ("d", "sent", 1)}


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "UTC"])
def test_dense_days(spark, zone):
    from postmill.functions.numbers import local_day

    df = spark.createDataFrame([("2026-01-02 03:00:00",)], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    got = {str(r.day): r.n for r in S.dense_days(df, local_day(F.col("ts"), zone), "2026-01-01", "2026-01-03").collect()}
    assert got == {"2026-01-01": int(zone != "UTC"), "2026-01-02": int(zone == "UTC"), "2026-01-03": 0}
