"""Numbers and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(c: Column, width: int, count: int) -> Column:
    """Lower end of the bucket of width that holds a value; the last of count buckets is closed above."""
    return F.when(c.isNotNull(), F.least(F.floor(c / width), F.lit(count - 1)).cast("int") * width)


def pieces(c: Column, points: list[tuple[float, float]], beyond: float) -> Column:
    """A piecewise linear function through points, constant before the first, beyond after the last; NULL stays NULL."""
    out = F.when(c <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(c <= x1, F.lit(float(y0)) + (c - x0) * F.lit((y1 - y0) / (x1 - x0)))
    return out.when(c.isNotNull(), F.lit(float(beyond)))


def weighted(terms: list[tuple[Column, float]]) -> Column:
    """A weighted sum in the order given, rounded half to even."""
    total = terms[0][0] * terms[0][1]
    for c, w in terms[1:]:
        total = total + c * w
    return F.bround(total, 0).cast("int")


def local_day(ts: Column, zone: str) -> Column:
    """The calendar day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_hour(ts: Column, zone: str) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone))


def age_days(ts: Column, now: Column) -> Column:
    """Days, with a fraction, from an instant to now; negative for a later one, NULL for NULL."""
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def is_fresh(ts: Column, now: Column, days: float) -> Column:
    """Undated and future rows are fresh; the boundary is."""
    return F.coalesce(age_days(ts, now) <= days, F.lit(True))


def band(score: Column, threshold: int, above: str = "strong", below: str = "reject") -> Column:
    """A label by threshold; NULL without a score."""
    return F.when(score >= threshold, above).when(score.isNotNull(), below)


def cascade(rules: list[tuple[Column, str, str]], otherwise: tuple[str, str]) -> Column:
    """struct(flag, reason) of the first rule (condition, flag, reason) that holds; a NULL condition doesn't."""
    out = None
    for condition, flag, reason in rules:
        value = F.struct(F.lit(flag).alias("flag"), F.lit(reason).alias("reason"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    last = F.struct(F.lit(otherwise[0]).alias("flag"), F.lit(otherwise[1]).alias("reason"))
    return last if out is None else out.otherwise(last)


def age_label(ts: Column, now: Column) -> Column:
    """today, yesterday or a number of days; undated for NULL and for what lies ahead."""
    age = age_days(ts, now)
    return F.when(age < 0, "undated").when(age < 1, "today").when(age < 2, "yesterday").when(age.isNotNull(), F.concat(F.floor(age).cast("string"), F.lit(" days"))).otherwise("undated")


def duration_label(us: Column) -> Column:
    """Microseconds as hours and minutes."""
    return F.concat(F.floor(us / 3_600_000_000).cast("string"), F.lit("h "), (F.floor(us / 60_000_000) % 60).cast("string"), F.lit("m"))
