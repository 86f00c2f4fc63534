"""Tables and files as frames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a posting as fetched.
POSTING = T.StructType([T.StructField(n, T.IntegerType() if n == "experience" else T.StringType()) for n in ("ats_id", "requisition_id", "company", "title", "location", "country_iso", "is_remote", "apply_url", "url", "ats_type", "posted_at", "description", "experience", "raw")])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; times without zone are instants in UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def read_slice(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Postings of a slice: columns that it lacks are NULL, others are not read; numbers in text fields become text."""
    have = spark.read.parquet(path)
    names = columns or POSTING.fieldNames()
    kinds = {f.name: f.dataType for f in POSTING}
    return have.select(*[(F.col(n).cast(kinds[n]) if n in have.columns else F.lit(None).cast(kinds[n])).alias(n) for n in names])


_ENTRY = "struct<csv:string, parquet:string, parquet_sha256:string, sha256:string, rows:bigint, size_bytes:bigint, parquet_size_bytes:bigint>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, url, sha256, rows, is_parquet, position) of the slices that a manifest lists: Parquet before CSV; entries without rows, link or hash are left out."""
    schema = f"by_ats map<string, {_ENTRY}>"
    listed = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("by_ats").alias("position", "source", "e"))
    parquet = F.col("e.parquet").isNotNull() & F.col("e.parquet_sha256").isNotNull()
    out = listed.select("source", F.when(parquet, F.col("e.parquet")).otherwise(F.col("e.csv")).alias("url"), F.when(parquet, F.col("e.parquet_sha256")).otherwise(F.col("e.sha256")).alias("sha256"), F.coalesce("e.rows", F.lit(0)).alias("rows"), parquet.alias("is_parquet"), "position")
    return out.where("rows > 0 and url is not null and sha256 is not null")


def without(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """df without rows whose column is one of names."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*names)) if names else df


def changed(slices: DataFrame, state: DataFrame, key: str = "source", sha: str = "sha256", known: str = "last_sha256") -> DataFrame:
    """The slices whose hash differs from the stored one, or that have none."""
    s = state.select(F.col(key).alias("_k"), F.col(known).alias("_known"))
    return slices.join(s, slices[key] == s["_k"], "left").where(~F.col(sha).eqNullSafe(F.col("_known"))).select(*slices.columns)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def read_config(path: str):
    """A JSON file of settings or word lists, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
