"""Changes to tables of rows with a key, each as a new version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guarded_upsert(stored: DataFrame, incoming: DataFrame, key: str, keep: list[str], state: str, settled: list[str]) -> DataFrame:
    """stored with incoming rows inserted or overwriting theirs.

    Columns in keep stay as stored; a stored row whose state is settled is overwritten only by one whose
    state is settled too. incoming has one row a key and stored's columns.
    """
    both = stored.select(F.struct("*").alias("o")).join(incoming.select(F.struct("*").alias("n")), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"o.{key}").isNotNull()
    take = F.col(f"n.{key}").isNotNull() & (~there | ~F.coalesce(F.col(f"o.{state}").isin(*settled), F.lit(False)) | F.coalesce(F.col(f"n.{state}").isin(*settled), F.lit(False)))
    value = lambda c: F.when(take & ~(there & F.lit(c in keep)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*[value(c) for c in stored.columns])


def put_rows(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """stored with incoming rows in place of theirs."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def remove_rows(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def insert_absent(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """stored and those incoming rows whose key it lacks."""
    return stored.unionByName(incoming.join(stored.select(key), key, "left_anti"))


def set_columns(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """stored with columns taken from the change of the same key; all else stays."""
    c = changes.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_{x}") for x in columns])
    j = stored.join(c, stored[key] == c["_k"], "left")
    return j.select(*[F.when(F.col("_k").isNotNull(), F.col(f"_{x}")).otherwise(stored[x]).alias(x) if x in columns else stored[x] for x in stored.columns])


def prune(stored: DataFrame, tombstones: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, tombstones with the doomed rows added): doomed has the tombstones' columns."""
    return remove_rows(stored, doomed, key), insert_absent(tombstones, doomed, key)
