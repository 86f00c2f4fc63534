from datetime import datetime, timezone

import pytest

from postmill.operators.timestamps import resolve_instants

SCHEMA = "k int, v string, src string, tz string, ord string"


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return {r.k: r for r in resolve_instants(df, "v", "src", "tz", "ord").collect()}


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2026-02-01T10:00:00Z", us(2026, 2, 1, 10), "resolved"),
    ("2026-02-01T10:00:00.123456789+02:00", us(2026, 2, 1, 8, micro=123456), "resolved"),
    ("  2026-02-01 10:00 ", us(2026, 2, 1, 18), "resolved"),
    ("2026-02-01", us(2026, 2, 1, 8), "resolved"),
    ("2026-02-01 10:00:00 [Europe/Berlin]", us(2026, 2, 1, 9), "resolved"),
    ("2026-02-01 10:00:00 America/New_York", us(2026, 2, 1, 15), "resolved"),
    ("2026-02-01 10:00:00,5 EST", us(2026, 2, 1, 15, micro=500000), "resolved"),
    ("3/4/2026 9:05 PM", us(2026, 3, 5, 5, 5), "resolved"),
    ("12/1/26", us(2026, 12, 1, 8), "resolved"),
    ("13/1/2026", None, "unparsed"),
    ("01.02.2026 12:00", us(2026, 2, 1, 20), "resolved"),
    ("Fri, 03 Apr 2026 13:46:07 -0400", us(2026, 4, 3, 17, 46, 7), "resolved"),
    ("April 10, 2026", us(2026, 4, 10, 7), "resolved"),
    ("01/Apr/2026:16:05:27 -0700", us(2026, 4, 1, 23, 5, 27), "resolved"),
    ("20260401T230527Z", us(2026, 4, 1, 23, 5, 27), "resolved"),
    ("1759431382", 1759431382 * 10**6, "resolved"),
    ("1759431382123", 1759431382123 * 1000, "resolved"),
    ("1759431382.5", 1759431382 * 10**6 + 500000, "resolved"),
    ("1759431382123456789", 1759431382123456, "resolved"),
    ("2026-03-08 02:30", None, "skipped"),
    ("2026-11-01T01:30:00", None, "twice"),
    ("2026-11-01 01:30:00 PDT", us(2026, 11, 1, 8, 30), "resolved"),
    ("2026-02-30", None, "unparsed"),
    ("2026-13-01", None, "unparsed"),
    ("2026-02-01T25:00:00", None, "unparsed"),
    ("2026-02-01 10:00 Nowhere/Land", None, "unparsed"),
    ("Apr 11 07:41:09", None, "unparsed"),
    ("2026", None, "unparsed"),
    ("yesterday", None, "unparsed"),
    ("x" * 100_000, None, "unparsed"),
    ("", None, "missing"),
    (None, None, "missing"),
]


@pytest.fixture(scope="module")
def got(spark):
    return run(spark, [(v, "s", "America/Los_Angeles", "mdy") for v, _, _ in CASES])


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(got, i):
    assert (got[i].utc_us, got[i].ts_status) == CASES[i][1:]


def test_order_is_learned_where_it_is_not_declared(spark):
    """A source whose other dates are day-first reads 3/4 day-first; one with nothing to tell stays ambiguous."""
    rows = [(f"{d}/4/2026", "eu", "UTC", None) for d in range(13, 28)] + [("3/4/2026", "eu", "UTC", None), ("3/4/2026", "none", "UTC", None), ("3/4/2026", None, None, "dmy")]
    r = run(spark, rows)
    assert (r[15].utc_us, r[15].ts_format) == (us(2026, 4, 3), "dmy")
    assert (r[16].utc_us, r[16].ts_status) == (None, "ambiguous")
    assert r[17].ts_status == "no_zone"


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resolve_instants(empty, "v", "src", "tz", "ord").count() == 0
    df = spark.createDataFrame([("2026-01-01", "s", "UTC", None, 7, 8)], "v string, src string, tz string, ord string, n int, year int")
    assert resolve_instants(df.unionAll(df), "v", "src", "tz", "ord").select("n", "year", "utc_us").collect() == [(7, 8, us(2026, 1, 1))] * 2
