"""The guarded upsert over every posting, whatever its key's length or batch."""

from postmill.plans import registry


def test_k01_upsert_takes_every_posting(spark, tmp_path):
    jobs = [("a", "scored", 5, "s"), ("bb", "pending", None, "s"), ("ccc", "pending", None, "s"), ("dd", "scored", None, "s"), ("eee", "delisted", 7, "s"), ("gone", "failed", None, "s")]
    raw = [(1, "a", 0), (2, "bb", 1), (3, "ccc", 7), (4, "dd", 0), (5, "eee", 2), (6, "new0", 0), (7, "new7", 7), (8, "new7", 7), (9, None, 3)]
    spark.createDataFrame(jobs, "global_id string, status string, score int, first_seen_at string").write.parquet(f"{tmp_path}/jobs.parquet")
    spark.createDataFrame(raw, "row_id bigint, global_id string, batch_no int").write.parquet(f"{tmp_path}/raw_jobs.parquet")
    got = sorted((r.global_id, r.status, r.score, r.first_seen_at) for r in registry.queries()["k01_upsert"](spark, str(tmp_path)).collect())
    want = [("a", "scored", 6, "s"), ("bb", "failed", None, "s"), ("ccc", "failed", None, "s"), ("dd", "scored", None, "s"), ("eee", "scored", 8, "s"), ("gone", "failed", None, "s"), ("new0", "pending", None, "later"), ("new7", "pending", None, "later")]
    assert got == want
