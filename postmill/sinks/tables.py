"""Versioned tables and exports."""

from __future__ import annotations

import csv
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """df as a new immutable version below root; readers of an older version are not disturbed. Returns its path."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    point(df.sparkSession, root, path)
    return path


def point(spark: SparkSession, root: str, path: str) -> None:
    """Makes path the current version: a small file written beside and renamed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, draft = jvm.org.apache.hadoop.fs.Path(f"{root}/current.txt"), jvm.org.apache.hadoop.fs.Path(f"{root}/current-{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, True)
    out.write(bytearray(path.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version of a table, or None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/current.txt")
    if not target.getFileSystem(conf).exists(target):
        return None
    path = spark.read.text(f"{root}/current.txt").first()[0]
    return spark.read.parquet(path)


def csv_rows(df: DataFrame, lists: tuple[str, ...] = ()) -> DataFrame:
    """df as text columns: NULL as empty, lists joined by '; '."""
    return df.select(*[(F.concat_ws("; ", c) if c in lists else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])


def export_csv(df: DataFrame, path: str) -> str:
    """Appends the rows, best first as ordered by the caller, to a quoted CSV with a byte-order mark.

    A file with another header is left as it is, and a sibling _v2, _v3 ... is written. The rows stream
    through the driver a partition at a time, as a single file for a person is asked for. Returns the path.
    """
    stem, ext = os.path.splitext(path)
    version = 1
    while os.path.exists(path):
        with open(path, encoding="utf-8-sig", newline="") as f:
            if next(csv.reader(f), None) == df.columns:
                break
        version += 1
        path = f"{stem}_v{version}{ext}"
    new = not os.path.exists(path)
    with open(path, "a", encoding="utf-8-sig" if new else "utf-8", newline="") as f:
        w = csv.writer(f, quoting=csv.QUOTE_ALL)
        if new:
            w.writerow(df.columns)
        for r in df.toLocalIterator():
            w.writerow(r)
    return path
