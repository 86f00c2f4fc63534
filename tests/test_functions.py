import uuid

import pytest
from pyspark.sql import functions as F

from postmill.functions import keys as K
from postmill.functions import numbers as N
from postmill.functions import text as X
from postmill.operators import summaries as S


def values(spark, f, rows, schema="v string"):
    return [r.r for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).coalesce(1).select(f.alias("r")).collect()]


def test_id_text(spark):
    assert values(spark, K.id_text(F.col("v")), ["12.0", "12.5", " a ", "", "NaN", None, "007"]) == ["12", "12.5", "a", None, None, None, "007"]


def test_host(spark):
    assert values(spark, K.host(F.col("v")), ["https://Jobs.Example.COM:80/x", "/jobs/1", None, "http://u@h.example?q"]) == ["jobs.example.com", "no-host", "no-host", "h.example"]


def test_global_key(spark):
    key = K.global_key(F.col("s"), F.col("i"), F.col("u"), F.col("p"))
    rows = [("a", "1.0", "https://H.example/x", True), ("a", "1", "https://h.example/x", False), ("a", None, None, None), ("a", "", "u", False)]
    assert values(spark, key, rows, "s string, i string, u string, p boolean") == ["a:h.example:1", "a:1", "a:url-da39a3ee5e6b4b0d", "a:url-51e69892ab49df85"]
    assert values(spark, K.id_of(F.col("v"), F.col("p")), [("a:h:x:1", True), ("a:x:1", False), ("a:x", None)], "v string, p boolean") == ["x:1", "x:1", "x"]


def test_company_keys(spark):
    assert values(spark, K.company_key(F.col("v")), ["Acme Foods, Inc.", "ACME FOODS LLC Ltd", "www.acmefoods.example", "Inc", "Co. Inc", "Müller GmbH", None]) == ["acmefoods", "acmefoods", "acmefoods", "inc", "co", "müller", None]
    assert values(spark, K.company_fold(F.col("v")), ["Acme & Co.", " ", None]) == ["acme co", "?", "?"]


def test_truth(spark):
    assert values(spark, K.truth(F.col("v")), ["true", "1", "False", "0", "", " no ", None, "x"]) == [True, True, False, False, False, False, False, True]


def test_best_link(spark):
    link = K.best_link(F.col("a"), F.col("u"), "login")
    assert values(spark, link, [("x", "y"), ("login/1", "y"), ("login/1", ""), ("", "y"), (None, None)], "a string, u string") == ["x", "y", "login/1", "y", None]


def test_name_uuid(spark):
    assert values(spark, K.name_uuid("p:", F.col("v")), ["a", "ü"]) == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"p:{v}")) for v in ("a", "ü")]


def test_text(spark):
    assert values(spark, X.html_text(F.col("v")), ["<p>a &amp; b</p><ul><li> c</li></ul>d<br/>", None, ""]) == ["a & b\nc\nd", None, ""]
    assert values(spark, X.unfenced(F.col("v")), ['```json\n{"a": 1}\n```', "plain"]) == ['{"a": 1}', "plain"]
    assert values(spark, X.cleaned(F.col("v")), ["exam-\nple  text\n\n\n\nend "]) == ["example text\n\nend"]
    assert values(spark, X.mentions(F.col("v"), ["Go", "C++", "Java", "C"]), ["Java, c++ and Django", "go.", "JavaScript"]) == [["C++", "Java"], ["Go"], []]
    assert values(spark, X.mentions(F.col("v"), ["SQL", "Spark SQL", "Spark"]), ["spark sql", "Spark", None, ""]) == [["SQL", "Spark SQL", "Spark"], ["Spark"], None, []]
    assert values(spark, X.path_segment(F.col("v"), "p", 2), ['{"p": "/job/New-York/x"}', '{"p": "/job"}', "{broken", None]) == ["New York", None, None, None]
    assert values(spark, F.col("v").rlike(X.words_pattern(["ml", "c.d"])), ["an ML job", "html", "c.d", "cxd"]) == [True, False, True, False]


def test_numbers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", None), ("b", 7), ("b", 7), ("c", None), (None, 5)], "g string, v int")
    assert {tuple(r) for r in S.nearest_ranks(df, "g", "v", {"p50": 0.5, "p90": 0.9}).collect()} == {("a", 3, 4), ("b", 7, 7), (None, 5, 5)}
    assert values(spark, N.bucket(F.col("v"), 10, 10), [0, 9, 10, 100, None], "v int") == [0, 0, 10, 90, None]
    assert values(spark, N.pieces(F.col("v"), [(3.0, 100), (5.0, 80), (7.0, 40)], 15), [1.0, 4.0, 6.0, 9.0, None], "v double") == [100.0, 90.0, 60.0, 15.0, None]
    assert values(spark, N.weighted([(F.col("v"), 0.5), (F.lit(78), 0.5)]), [79.0, 81.0], "v double") == [78, 80]
    assert values(spark, N.band(F.col("v"), 80), [80, 79, None], "v int") == ["strong", "reject", None]


def test_times(spark):
    now = F.lit("2026-01-16 00:00:00").cast("timestamp")
    ts = F.col("v").cast("timestamp")
    assert values(spark, N.is_fresh(ts, now, 15), ["2026-01-01 00:00:00", "2025-12-31 23:59:59", "2027-01-01 00:00:00", None]) == [True, False, True, True]
    assert [str(x) for x in values(spark, N.local_day(ts, "America/Los_Angeles"), ["2026-01-01 07:59:59", "2026-01-01 08:00:00"])] == ["2025-12-31", "2026-01-01"]


def test_cascade(spark):
    c = N.cascade([(F.col("v") > 5, "a", "big"), (F.col("v") > 3, "b", "mid")], ("c", "rest"))
    assert [tuple(x) for x in values(spark, c, [9, 4, 1, None], "v int")] == [("a", "big"), ("b", "mid"), ("c", "rest"), ("c", "rest")]


@pytest.mark.parametrize("bad", ["", "x"])
def test_empty_cascade(spark, bad):
    assert [tuple(x) for x in values(spark, N.cascade([], ("c", bad)), [1], "v int")] == [("c", bad)]


def test_sections(spark):
    from postmill.functions.sections import Rules, heading, sections_dropped, sections_kept

    lines = ["## About us", "**Your tasks**:", "WHAT WE OFFER", "What We Offer:", "we offer a lot here.", "- Item", "plain words here", "C++", "7", "plain", "Seven Words Are Too Many For This", "Work and Life", "Ends, Here;"]
    assert values(spark, heading(F.col("v")), lines) == ["About us", "Your tasks", "WHAT WE OFFER", "What We Offer", None, None, None, "C++", None, None, None, "Work and Life", None]
    text = "Lead in, of the role.\n\n## About us\nWe are great.\n\n- and big\n\nAs an engineer you will build.\n## Tasks\nYou build many small things\nthat work.\n\n## Benefits\nLunch, for citizens only."
    rules = Rules(unwanted="about|benefit", unless="citizen", short=5)
    dropped = lambda v, r=rules: values(spark, sections_dropped(F.col("v"), r), v)
    assert dropped([text]) == ["Lead in, of the role.\n\nAs an engineer you will build.\n\nTasks\n\nYou build many small things\nthat work.\n\nLunch, for citizens only."]
    assert dropped(["no headings here.", "", None]) == ["no headings here.", "", None]
    assert dropped(["## About us\n" + "x " * 200], Rules(unwanted="about"))[0].startswith("## About us")
    assert values(spark, sections_kept(F.col("v"), "task"), [text, "plain", None]) == ["You build many small things\nthat work.", None, None]
    assert dropped(["<h3>About us</h3><p>We are.</p>\n\n<h3>Tasks</h3>\nyou build it all.", None]) == ["Tasks\n\nyou build it all.", None]
    assert dropped(["Long Text\n" + "word " * 60_000]) == ["Long Text\n\n" + ("word " * 60_000).strip()]
