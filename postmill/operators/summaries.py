"""Aggregations: complete counts, dense series, roll-ups, group trees, differences of classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_counts(df: DataFrame, column: str, values: list, count: str = "n") -> DataFrame:
    """A count for every value in values, 0 where there is none."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema)
    return dim.join(df.groupBy(column).agg(F.count("*").alias(count)), column, "left").select(column, F.coalesce(count, F.lit(0)).cast("bigint").alias(count))


def dense_days(df: DataFrame, day: Column, first: str, last: str, count: str = "n") -> DataFrame:
    """A count for every day from first to last, 0 where there is none."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(df.select(day.alias("day")).groupBy("day").agg(F.count("*").alias(count)), "day", "left").select("day", F.coalesce(count, F.lit(0)).cast("bigint").alias(count))


def dense_hours(df: DataFrame, hour: Column, count: str = "n") -> DataFrame:
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(df.select(hour.alias("hour")).groupBy("hour").agg(F.count("*").alias(count)), "hour", "left").select("hour", F.coalesce(count, F.lit(0)).cast("bigint").alias(count))


def most_common(df: DataFrame, column: str, n: int, count: str = "n") -> DataFrame:
    """The n most frequent values; ties go by value."""
    return df.groupBy(column).agg(F.count("*").alias(count)).orderBy(F.desc(count), F.col(column)).limit(n)


def tree(df: DataFrame, levels: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates for every prefix of levels, in one pass; level tells how many of them are set."""
    sets = [levels[: i + 1] for i in range(len(levels))]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in levels]).agg(*aggs, F.grouping_id().alias("_gid"))
    return out.withColumn("level", F.lit(len(levels)) - F.bit_count("_gid")).drop("_gid")


def singles_together(df: DataFrame, group: str, label: str = "(one each)") -> DataFrame:
    """(grp, n): groups of one row, if there are two or more of them, count as one group under label."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    singles = sizes.agg(F.count_if(F.col("n") == 1).alias("_singles")).withColumn("_k", F.lit(1))  # one row
    marked = sizes.withColumn("_k", F.lit(1)).join(F.broadcast(singles), "_k")
    key = F.when((F.col("n") == 1) & (F.col("_singles") >= 2), F.lit(label)).otherwise(F.col(group))
    return marked.groupBy(key.alias("grp")).agg(F.sum("n").alias("n"))


def transitions(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """(before, after, n): how a classification of rows with a key went over into another."""
    a, b = before.select(key, F.col(column).alias("before")), after.select(key, F.col(column).alias("after"))
    return a.join(b, key, "full_outer").groupBy("before", "after").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


def nearest_ranks(df: DataFrame, group: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """(group, one column a fraction): the value at rank round(fraction * (n - 1)), rounded half to even, of a group's non-null values.

    Values are counted first, combined map-side; ranks come from running sums over distinct values, so
    no group is gathered as a list. A group without values has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    ranked = counts.withColumns({"_to": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    at = lambda f: F.bround(F.lit(f) * (F.col("_all") - 1), 0)
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("_to") > at(f), F.col(value))).alias(name) for name, f in fractions.items()])
