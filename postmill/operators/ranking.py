"""Ranks, quotas and precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import groups_for, written


def quota(df: DataFrame, group: Column, order: list[Column], most: int, used: DataFrame | None = None) -> DataFrame:
    """df with takes: whether a row is within its group's most best rows, less those used already.

    used: (grp, n_used). Rows without a group (NULL or blank) are not limited.
    """
    df = df.withColumn("_g", F.nullif(group, F.lit("")))
    free = F.lit(most)
    if used is not None:
        df = df.join(used.select(F.col("grp").alias("_ug"), "n_used"), F.col("_g") == F.col("_ug"), "left").drop("_ug")
        free = F.lit(most) - F.coalesce("n_used", F.lit(0))
    limited = df.where("_g is not null").withColumn("_rn", F.row_number().over(Window.partitionBy("_g").orderBy(*order)))
    free_rows = df.where("_g is null").withColumn("_rn", F.lit(None).cast("int"))
    out = limited.unionByName(free_rows).withColumn("takes", F.coalesce(F.col("_rn") <= free, F.lit(True)))
    return out.drop("_rn", "_g", "n_used")


def by_priority(df: DataFrame, name: str, priority: list[str], held: list[str], position: str) -> DataFrame:
    """df without held names, with queue_pos by their place in priority, then by position."""
    places = F.array(*[F.lit(p) for p in priority]).cast("array<string>")
    at = F.array_position(places, F.col(name))
    rank = F.when(at == 0, len(priority)).otherwise(at - 1)
    kept = df.where(~F.col(name).isin(*held)) if held else df
    return kept.withColumn("queue_pos", F.row_number().over(Window.orderBy(rank, F.col(position), F.col(name))))


def precedence(frames: list[DataFrame], key: str, latest: Column) -> DataFrame:
    """One row a key of several tables of like columns: that of the last table which has it, there the latest."""
    tagged = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy(key).orderBy(F.desc("_p"), latest.desc_nulls_last())
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


def blanks_last(c: str, descending: bool = False) -> Column:
    """A sort order with NULL and blank values last in either direction."""
    v = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    typed = F.when(v.isNotNull(), F.col(c))
    return typed.desc_nulls_last() if descending else typed.asc_nulls_last()


def running_total(df: DataFrame, group: str, order: str, value: str, name: str, width: int) -> DataFrame:
    """df with the running total of value within group in order of an integer column.

    Summed within stretches of width, to which the total of the stretches before is added, so that
    no task holds a whole group; the stretches' totals are as many as range / width.
    """
    cut = df.withColumn("_s", F.floor(F.col(order) / width))
    totals = cut.groupBy(group, "_s").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("_g"), F.col("_s").alias("_s2"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    joined = cut.join(offsets, cut[group].eqNullSafe(offsets["_g"]) & (cut["_s"] == offsets["_s2"]))
    within = Window.partitionBy(group, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.col("_o") + F.coalesce(F.sum(value).over(within), F.lit(0))).select(*df.columns, name)


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the place of every row, from 1, in a total order of its columns.

    Rows are split into ranges of the order and numbered within each, to which the number of rows in
    the ranges before is added, so that no task holds the whole table.
    """
    cut = written(df.repartitionByRange(groups_for(0, df.sparkSession), *order).withColumn("_r", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_r").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col("_r").alias("_r2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    numbered = cut.withColumn("_i", F.row_number().over(Window.partitionBy("_r").orderBy(*order)))
    return numbered.join(F.broadcast(starts), F.col("_r") == F.col("_r2")).select(*df.columns, (F.col("_o") + F.col("_i")).cast("bigint").alias(name))
