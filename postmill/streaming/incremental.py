"""Incremental processing with Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from postmill.operators.dedupe import one_per
from postmill.session import shared_folder


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def new_postings(stream: DataFrame, root: str, key: str = "global_id", dated: str = "posted_at", position: str = "row_id") -> StreamingQuery:
    """Writes the rows of keys not seen before to root/accepted, one row a key, and ends when the input is used up.

    What was seen lies in root/accepted itself, a folder a micro-batch, so no unbounded state is held; a
    repeated micro-batch overwrites its own folder only, and sees those before it, so each row is
    accepted once. Keys are compared by a left anti join, of which the seen side is read by key column only.
    """
    accepted = f"{root.rstrip('/')}/accepted"

    def batch(df: DataFrame, n: int) -> None:
        fresh = one_per(df.where(F.col(key).isNotNull()), [key], dated, position)
        if _exists(df.sparkSession, accepted):
            seen = df.sparkSession.read.parquet(accepted)
            if "batch" in seen.columns:
                fresh = fresh.join(seen.where(F.col("batch") < n).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{accepted}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()


def window_counts(stream: DataFrame, ts: str, by: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts by window of event time and a column; rows later than late are left out if it is given."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, length, slide or length), F.col(by)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def run_to_table(df: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a streaming frame over all input there is now, as a table in the shared folder.

    A repeated micro-batch overwrites its own rows only; in complete mode each replaces all before it.
    """
    spark, root = df.sparkSession, f"{shared_folder(df.sparkSession)}/out-{uuid.uuid4().hex}"
    last = []

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
        last.append(n)

    df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{root}/rows/batch={last[-1]}" if mode == "complete" else f"{root}/rows")


def deliver(outbox: DataFrame, send: Callable[[str, str], bool], attempts: int = 3) -> DataFrame:
    """outbox (global_id, payload, status, n_attempts) after one round of sending its pending rows.

    A row that send refuses stays pending until its last attempt, then it is failed. Rows of other
    states stay as they are. send is called on the executors, once a row and round.
    """

    def run(batches):
        for b in batches:
            sent = [send(k, p) for k, p in zip(b["global_id"], b["payload"])]
            b["n_attempts"] = b["n_attempts"] + 1
            b["status"] = ["sent" if ok else "failed" if n >= attempts else "pending" for ok, n in zip(sent, b["n_attempts"])]
            yield b

    pending = outbox.where("status = 'pending'")
    return outbox.where("status is null or status != 'pending'").unionByName(pending.mapInPandas(run, pending.schema))


class Heartbeat(StreamingQueryListener):
    """Writes a line of JSON about each micro-batch through write; a reader tells a stalled query by its age."""

    def __init__(self, write: Callable[[str], None]):
        self.write = write

    def onQueryStarted(self, event):
        self.write(json.dumps({"query": str(event.id), "state": "started"}))

    def onQueryProgress(self, event):
        p = event.progress
        self.write(json.dumps({"query": str(p.id), "state": "running", "batch": p.batchId, "rows": p.numInputRows, "at": p.timestamp}))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.write(json.dumps({"query": str(event.id), "state": "failed" if event.exception else "ended"}))
