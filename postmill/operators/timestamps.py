"""Points in time written in many notations, brought to microseconds since 1970 in UTC.

Each value is matched against families of notations. A value may be valid under several formats
(a slashed date as month-first and day-first). Expectation-maximisation over the mixture of formats
of each source, run on counts per set of valid formats, gives the posterior of each reading; what
stays below the asked certainty is marked ambiguous and not resolved.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.bounds import small_side

# Offsets, in minutes, of abbreviations that mean one offset in job feeds.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "AWST": 480, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "BRT": -180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Month names by their first three letters.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
MONTH_NAME = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"

_CLOCK = r"(?:(?:\s*,\s*|[ Tt]\s*)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp][Mm]\b)?\s*([^|]*))?$"
_YEAR = r"(\d{4}|\d{2})"
#: family: pattern, and the order of its fields as year|month|day|hour|minute|second|fraction|am-pm|zone
_FAMILIES = {
    "iso": (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})" + _CLOCK, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*([^|]*)$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "slashed": (r"^(\d{1,2})/(\d{1,2})/" + _YEAR + _CLOCK, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "dotted": (r"^(\d{1,2})\.(\d{1,2})\." + _YEAR + _CLOCK, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "day_month": (r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})[ -]+" + MONTH_NAME + r"\.?[ ,-]+(\d{4})" + _CLOCK, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "month_day": (r"(?i)^(?:[a-z]{3,9},?\s+)?" + MONTH_NAME + r"\.?\s+(\d{1,2}),?\s+(\d{4})" + _CLOCK, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "log": (r"(?i)^\[?(\d{1,2})/" + MONTH_NAME + r"/(\d{4}):(\d{2}):(\d{2}):(\d{2})\s*([+-]\d{4}|[a-z]{1,5})?\]?$", "$3|$2|$1|$4|$5|$6|||$7"),
    "epoch": (r"^(\d{9,19})(?:[.,](\d+))?$", "$1||||||$2||"),
}
#: Formats, by bit: a value's valid ones make a mask.
FORMATS = ("iso", "compact", "mdy", "dmy", "dotted", "day_month", "month_day", "log", "epoch_s", "epoch_ms", "epoch_us", "epoch_ns")
_UNITS = {"epoch_s": 1_000_000, "epoch_ms": 1_000, "epoch_us": 1, "epoch_ns": 1}
_DAY = 86_400_000_000
#: Bare numbers count in the unit that falls between these years.
PLAUSIBLE_YEARS = (1990, 2100)
#: Most rounds of expectation-maximisation a source; it stops earlier once its weights stand still.
EM_ROUNDS = 100


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a civil date, by arithmetic alone (never raises, whatever the session's mode)."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return (era * 146_097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719_468).cast("bigint")


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def _offset(at: Column, zone: Column) -> Column:
    """Microseconds that the zone is ahead of UTC at an instant."""
    ts = F.timestamp_micros(at)
    return F.unix_micros(F.from_utc_timestamp(ts, zone)) - at


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns computed once: a generator keeps the optimiser from repeating them wherever they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _zones(df: DataFrame) -> list[str]:
    """Zone names that the JVM knows; abbreviations are treated apart."""
    return sorted(z for z in df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z or z == "UTC")


def _parsed(df: DataFrame, value: str, zone: str, order: str) -> DataFrame:
    """df with _p: the fields of each value, and _mask: the formats under which it is a possible date."""
    t = F.trim(F.regexp_replace(F.col(value), r"[\s ]+", " "))
    canon = F.lit(None).cast("string")
    for family, (pattern, fields) in reversed(_FAMILIES.items()):
        canon = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, f"{family}|{fields}")).otherwise(canon)
    df = _bound(df, _f=F.split(canon, r"\|"))
    part = lambda i: F.get(F.col("_f"), F.lit(i))
    num = lambda i: part(i).try_cast("int")
    month_of = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    df = df.withColumns({"_family": part(0), "_zone": F.upper(F.trim(part(9))), "_zone_text": F.trim(part(9))})
    month = F.coalesce(num(2), F.try_element_at(month_of, F.lower(F.substring(part(2), 1, 3))))
    year = F.when(F.length(part(1)) == 2, num(1) + 2000).otherwise(num(1))
    hour = F.coalesce(num(4), F.lit(0))
    ampm = F.lower(part(8))
    clock_ok = (
        F.when(ampm != "", hour.between(1, 12)).otherwise(hour <= 23)
        & (F.coalesce(num(5), F.lit(0)) <= 59)
        & (F.coalesce(num(6), F.lit(0)) <= 59)
    )
    hour = F.when(ampm == "pm", hour % 12 + 12).when(ampm == "am", hour % 12).otherwise(hour)
    frac = F.coalesce(F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    df = _bound(df, **{"_y": year, "_m": month, "_d": num(3), "_frac": frac, "_ok": clock_ok, "_clock": ((hour * 60 + F.coalesce(num(5), F.lit(0))) * 60 + F.coalesce(num(6), F.lit(0))).cast("bigint") * 1_000_000 + frac})
    # zones
    bare = F.regexp_replace(F.col("_zone_text"), r"^\[|\]$", "")
    named = F.when(bare.isin(_zones(df)), bare)
    hhmm = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?(?:\[.*\])?$"
    sign = F.when(F.regexp_extract("_zone", hhmm, 1) == "-", -1).otherwise(1)
    oh, om = F.regexp_extract("_zone", hhmm, 2).try_cast("int"), F.coalesce(F.regexp_extract("_zone", hhmm, 3).try_cast("int"), F.lit(0))
    offset = F.when(F.col("_zone").rlike(hhmm), F.when((oh <= 18) & (om <= 59), sign * (oh * 60 + om))).otherwise(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), F.regexp_replace("_zone", r"^\[|\]$", ""))
    )
    has_zone = F.col("_zone") != ""
    df = _bound(df, **{"_offset": F.when(has_zone, offset), "_named": F.when(has_zone & offset.isNull(), named).when(~has_zone, F.col(zone)), "_zone_ok": ~has_zone | offset.isNotNull() | named.isNotNull()})
    possible = lambda m, d: F.coalesce(F.col("_ok") & F.col("_zone_ok") & m.between(1, 12) & (d >= 1) & (d <= _month_days(F.col("_y"), m)) & (F.col("_y") >= 1), F.lit(False))
    y, m, d = F.col("_y"), F.col("_m"), F.col("_d")
    given = F.lower(F.col(order))
    number = part(1).try_cast("bigint")
    bits: list[Column] = []
    for bit, name in enumerate(FORMATS):
        if name in _UNITS:
            low, high = ((np.datetime64(f"{year}-01-01", "s").astype(int)) * 1_000_000 for year in PLAUSIBLE_YEARS)
            scaled = (int(low) // _UNITS[name], int(high) // _UNITS[name]) if name != "epoch_ns" else (int(low) * 1000, int(min(high * 1000, 2**63 - 1)))
            valid = (F.col("_family") == "epoch") & F.coalesce((number >= scaled[0]) & (number < scaled[1]), F.lit(False))
        elif name == "mdy":
            valid = (F.col("_family") == "slashed") & possible(m, d) & (given.isNull() | (given != "dmy"))
        elif name == "dmy":
            valid = (F.col("_family") == "slashed") & possible(d, m) & (given.isNull() | (given != "mdy"))
        else:
            valid = (F.col("_family") == name) & possible(m, d)
        bits.append(F.when(valid, 1 << bit).otherwise(0))
    return _bound(df, _mask=F.coalesce(reduce(lambda a, b: a + b, bits), F.lit(0)), _number=number)


def _em(counts: pd.DataFrame) -> pd.DataFrame:
    """One source: weights of its formats by expectation-maximisation; the best format of each mask and its posterior."""
    masks, n = counts["_mask"].to_numpy(), counts["n"].to_numpy(float)
    valid = (masks[:, None] >> np.arange(len(FORMATS)) & 1).astype(float)
    weight = np.full(len(FORMATS), 1 / len(FORMATS))
    for _ in range(EM_ROUNDS):
        share = valid * weight
        share /= share.sum(1, keepdims=True)
        new = (n @ share + 1e-6) / (n.sum() + 1e-6 * len(FORMATS))
        if np.abs(new - weight).max() < 1e-9:
            break
        weight = new
    share = valid * weight
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    return pd.DataFrame({"_src": counts["_src"], "_mask": masks, "ts_format": np.array(FORMATS)[best], "ts_posterior": share[np.arange(len(best)), best]})


def resolve_instants(df: DataFrame, value: str, source: str, zone: str, date_order: str, certainty: float = 0.95) -> DataFrame:
    """df with utc_us (bigint), ts_format, ts_posterior and ts_status for the text in value.

    source names the column whose values share a mixture of formats; zone holds the zone of values
    without one (NULL: unknown); date_order holds 'mdy' or 'dmy' where it is declared, which then
    rules the other out, or NULL, where EM decides from the source's own values.

    ts_status: 'resolved'; 'missing' (NULL or blank); 'unparsed' (no known notation, incomplete or
    impossible); 'ambiguous' (posterior below certainty); 'no_zone'; 'skipped' or 'twice' (wall-clock
    time that the zone leaves out or has two of). utc_us is set for 'resolved' only. Digits beyond
    microseconds are cut off, two-digit years are 20xx, a date alone is its midnight. An unknown zone
    text makes a value unparsed. Repeated rows stay repeated; the other columns stay as they are
    (names starting with an underscore and the four above are this operator's own).
    """
    known = [c for c in df.columns]
    p = _parsed(df, value, zone, date_order).withColumn("_src", F.col(source).cast("string"))
    best = small_side(p.where("_mask != 0").groupBy("_src", "_mask").agg(F.count("*").alias("n")).groupBy("_src").applyInPandas(_em, "_src string, _mask int, ts_format string, ts_posterior double"))
    best = best.withColumnsRenamed({"_src": "_s2", "_mask": "_m2"})
    j = p.join(best, p["_src"].eqNullSafe(best["_s2"]) & (p["_mask"] == best["_m2"]), "left")
    swap = F.col("ts_format") == "dmy"
    wall = _days(F.col("_y"), F.when(swap, F.col("_d")).otherwise(F.col("_m")), F.when(swap, F.col("_m")).otherwise(F.col("_d"))) * _DAY + F.col("_clock")
    j = _bound(j, _wall=F.when(~F.col("ts_format").startswith("epoch"), wall))
    local = F.when(F.col("_wall").isNotNull() & F.col("_offset").isNull() & F.col("_named").isNotNull(), F.col("_wall"))
    j = _bound(j, _o1=_offset(local - _DAY, F.col("_named")), _o2=_offset(local + _DAY, F.col("_named")))
    u1, u2 = F.col("_wall") - F.col("_o1"), F.col("_wall") - F.col("_o2")
    changes = F.col("_o1") != F.col("_o2")
    j = _bound(j, _k1=~changes | (_offset(F.when(changes, u1), F.col("_named")) == F.col("_o1")), _k2=changes & (_offset(F.when(changes, u2), F.col("_named")) == F.col("_o2")))
    epoch = (
        F.when(F.col("ts_format") == "epoch_s", F.col("_number") * 1_000_000 + F.col("_frac"))
        .when(F.col("ts_format") == "epoch_ms", F.col("_number") * 1_000 + F.floor(F.col("_frac") / 1_000))
        .when(F.col("ts_format") == "epoch_us", F.col("_number"))
        .when(F.col("ts_format") == "epoch_ns", F.floor(F.col("_number") / 1_000).cast("bigint"))
    )
    blank = F.col(value).isNull() | (F.trim(F.regexp_replace(F.col(value), r"[\s ]+", " ")) == "")
    status = (
        F.when(blank, "missing")
        .when(F.col("ts_format").isNull(), "unparsed")
        .when(F.col("ts_posterior") < certainty, "ambiguous")
        .when(F.col("_wall").isNull() | F.col("_offset").isNotNull(), "resolved")
        .when(F.col("_named").isNull(), "no_zone")
        .when(F.col("_k1") & F.col("_k2"), "twice")
        .when(F.col("_k1") | F.col("_k2"), "resolved")
        .otherwise("skipped")
    )
    utc = F.coalesce(epoch, F.when(F.col("_offset").isNotNull(), F.col("_wall") - F.col("_offset").cast("bigint") * 60_000_000), F.when(F.col("_k1"), u1).otherwise(u2))
    return _bound(j, ts_status=status).select(*known, F.when(F.col("ts_status") == "resolved", utc).cast("bigint").alias("utc_us"), "ts_format", "ts_posterior", "ts_status")
