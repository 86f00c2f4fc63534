from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postmill.operators.snapshots import snapshot_changes

SCHEMA = "ats_type string, snapshot_no int, global_id string, slice_file string, slice_pos bigint, title string, company string"


def brute(rows):
    by, snaps = {}, {}
    for r in rows:
        if r[1] is None:
            continue
        by.setdefault((r[0], r[1]), {}).setdefault(r[2], set()).add(r[5:])
        snaps.setdefault(r[0], set()).add(r[1])
    out = set()
    for source, numbers in snaps.items():
        ordered = sorted(numbers)
        for before, now in zip(ordered, ordered[1:]):
            a, b = by[source, before], by[source, now]
            out |= {(source, now, k, "added") for k in b.keys() - a.keys()} | {(source, now, k, "removed") for k in a.keys() - b.keys()} | {(source, now, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def found(spark, rows, **kw):
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def test_kinds_nulls_and_repeats(spark):
    rows = [
        ("a", 0, "k1", "f", 0, "t", None), ("a", 0, "k2", "f", 1, "t", "c"), ("a", 0, None, "f", 2, "x", "c"), ("a", 0, "k5", "f", 3, None, ""),
        ("a", 2, "k2", "g", 9, "t", "c"), ("a", 2, "k2", "g", 8, "t", "c"), ("a", 2, "k3", "g", 1, "t", "c"), ("a", 2, None, "g", 2, "y", "c"), ("a", 2, "k5", "g", 3, "", None),
        (None, 0, "k1", "f", 0, "t", None), (None, 1, "k1", "f", 0, "t", "now"), ("b", 1, "k1", "f", 0, "t", "c"), ("a", None, "k9", "f", 0, "t", "c"),
    ]
    assert found(spark, rows) == brute(rows) == {("a", 2, "k1", "removed"), ("a", 2, "k3", "added"), ("a", 2, None, "changed"), ("a", 2, "k5", "changed"), (None, 1, "k1", "changed")}


def test_empty(spark):
    assert found(spark, []) == set()


def test_values_of_both_sides(spark):
    rows = [("a", 0, "k", "f", 0, "old", "c"), ("a", 1, "k", "f", 0, "new", "c"), ("a", 1, "n", "f", 0, "n", "c"), ("a", 2, "n", "f", 0, "n", "c")]
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), keep=("title",)).collect()
    assert {tuple(r) for r in got} == {("a", 1, "k", "changed", "old", "new"), ("a", 1, "n", "added", None, "n"), ("a", 2, "k", "removed", "new", None)}


def test_hot_key_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", s, "hot" if i % 3 else str(i), "f", i, "t", "c") for s in (0, 1) for i in range(300)], SCHEMA).withColumnsRenamed({"title": "src", "company": "bucket"})
    assert snapshot_changes(df, rows_per_group=50).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([0, 1, 3]), st.sampled_from(["x", "y", "", None]), st.just("f"), st.just(1), st.sampled_from(["1", "2", None]), st.just("c")), max_size=25))
def test_like_brute_force(spark, rows):
    assert found(spark, rows, rows_per_group=3) == brute(rows)
