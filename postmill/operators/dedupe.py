"""Order-sensitive removal of duplicates, against what was seen before and within a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seen_keys(*frames: DataFrame, key: str = "global_id") -> DataFrame:
    """The distinct keys of several tables."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.unionAll(f.select(key))
    return out.distinct()


def one_per(df: DataFrame, keys: list[str], dated: str, position: str, where_set: str | None = None) -> DataFrame:
    """One row for each combination of keys: the first with a date, else the first by position.

    With where_set only rows that have that column set are collapsed; the others all stay. A
    window sorts within a key, and ranks are cut before the shuffle, so a hot key costs little.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(dated).isNull(), F.col(position))
    pick = lambda x: x.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    if where_set is None:
        return pick(df)
    return pick(df.where(F.col(where_set).isNotNull())).unionByName(df.where(F.col(where_set).isNull()))


def dedupe(batch: DataFrame, seen: DataFrame, seen_requisitions: DataFrame, key: str = "global_id", requisition: tuple[str, str, str] = ("company", "requisition_id", "location"), dated: str = "posted_at", position: str = "slice_pos") -> DataFrame:
    """The batch's new rows: keys not seen, requisitions not seen, one row a key, one row a requisition.

    A missing location equals a missing location; rows without a requisition number never collapse.
    """
    company, number, location = requisition
    s = seen_requisitions.select(F.col(company).alias("_c"), F.col(number).alias("_r"), F.col(location).alias("_l"))
    fresh = batch.join(seen.select(key).distinct(), key, "left_anti")
    fresh = fresh.join(s, (fresh[company] == s["_c"]) & (fresh[number] == s["_r"]) & fresh[location].eqNullSafe(s["_l"]), "left_anti")
    return one_per(one_per(fresh, [key], dated, position), [company, number, location], dated, position, where_set=number)
