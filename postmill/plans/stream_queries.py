"""Queries that run as streams over all input there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.plans.query import Registry, Tables
from postmill.session import shared_folder
from postmill.streaming.incremental import new_postings, run_to_table, window_counts

R = Registry()
query = R.query
QUERIES, SQL = R.QUERIES, R.SQL


def _stream(t: Tables, name: str) -> DataFrame:
    """A table's files as a stream; a table may be a file or a folder."""
    path = f"{t.folder}/{name}.parquet"
    schema = t.spark.read.parquet(path).schema
    jvm = t.spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    where, glob = (path, "*.parquet") if fs.getFileStatus(p).isDirectory() else (t.folder, f"{name}.parquet")
    return t.spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(where)


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n from events group by all")
def st01_hourly_events(t: Tables) -> DataFrame:
    return run_to_table(window_counts(_stream(t, "events"), "ts", "event_type", "1 hour")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("select global_id, row_id from raw_jobs where global_id is not null qualify row_number() over (partition by global_id order by posted_at is null, row_id) = 1")
def st02_new_postings(t: Tables) -> DataFrame:
    import uuid

    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    new_postings(_stream(t, "raw_jobs").select("global_id", "row_id", "posted_at"), root).awaitTermination()
    return t.spark.read.parquet(f"{root}/accepted").select("global_id", "row_id")
