"""New batches checked against all history by immutable suffix arrays.

Each batch becomes a segment: its records' texts end to end as words, and the suffix array over them.
A batch's substrings are looked up by binary search in the segments of the batches before it, and the
covered words are summed up per record. Segments never change; two of like size are merged into one,
so there are at most about log2(batches) of them, and a record is rewritten as often. In tables
(History) a suffix is known by the hash of the run of words that it begins with, and the suffixes of
a segment are sharded by it, so that a batch's runs meet only their shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.words import ascii_runs
from postmill.session import GROUP_ROWS, drop_written, written

_END = np.uint64(0)


class Segment:
    """Texts of a batch, end to end, each closed by a zero, and the order of their suffixes by their first depth words."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, records: np.ndarray, depth: int, order: np.ndarray | None = None):
        self.words, self.starts, self.records, self.depth = words, starts, records, depth
        self.order = self._sorted() if order is None else order

    @classmethod
    def of(cls, texts: list[np.ndarray], records: np.ndarray, depth: int) -> Segment:
        """texts: each record's words as hashes other than 0."""
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        words = np.zeros(int(lengths.sum()), np.uint64)
        for s, t in zip(starts, texts):
            words[s : s + len(t)] = t
        return cls(words, starts, np.asarray(records, np.int64), depth)

    @classmethod
    def of_keys(cls, keys: np.ndarray, records: np.ndarray) -> Segment:
        """Records of one word each."""
        words = np.zeros(2 * len(keys), np.uint64)
        words[::2] = keys
        return cls(words, np.arange(len(keys), dtype=np.int64) * 2, np.asarray(records, np.int64), 1)

    def _sorted(self) -> np.ndarray:
        """Prefix doubling until depth words are in order."""
        at = np.flatnonzero(self.words != _END)
        rank = np.zeros(len(self.words) + 1, np.int64)
        rank[at] = np.unique(self.words[at], return_inverse=True)[1] + 1
        order, k = at[np.argsort(rank[at], kind="stable")], 1
        while k < self.depth and len(at):
            # a suffix that ends within k words goes on with zeros
            nxt = np.zeros(len(self.words), np.int64)
            inside = at + k < len(self.words)
            gone = np.cumsum(self.words == _END)
            nxt[at[inside]] = np.where(gone[at[inside] + k] == gone[at[inside]], rank[at[inside] + k], 0)
            order = at[np.lexsort((nxt[at], rank[at]))]
            step = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (nxt[order][1:] != nxt[order][:-1])]
            rank = np.zeros(len(self.words) + 1, np.int64)
            rank[order] = np.cumsum(step) + 1
            k *= 2
        return order

    def find(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the depth words from each position at: the range of order that begins with them."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        for j in range(self.depth):
            want = words[at + j]
            lo, hi = self._bound(lo, hi, want, j, False), self._bound(lo, hi, want, j, True)
        return lo, hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, j: int, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            pos = self.order[np.where(open_, mid, 0)] + j
            have = self.words[np.minimum(pos, len(self.words) - 1)]
            less = open_ & ((have <= want) if right else (have < want))
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    def merged(self, other: Segment) -> Segment:
        return Segment(np.concatenate([self.words, other.words]), np.concatenate([self.starts, other.starts + len(self.words)]), np.concatenate([self.records, other.records]), self.depth)

    def record_at(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1


def covered(batch: Segment, history: list[Segment]) -> pd.DataFrame:
    """(record, first, share, best, best_share): of each of the batch's records, the share of its words
    that lie in a run of depth words found in history; the earlier record with most of them, and its share.
    """
    m, lengths = batch.depth, np.diff(np.r_[batch.starts, len(batch.words)]) - 1
    ends = np.cumsum(batch.words == _END)
    at = np.arange(max(0, len(batch.words) - m + 1))
    at = at[(ends[at + m - 1] == ends[at]) & (batch.words[at] != _END)]
    hits = []
    for seg in history:
        lo, hi = seg.find(batch.words, at)
        n = hi - lo
        pos = np.repeat(at, n)
        where = seg.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        hits.append((pos, seg.records[seg.record_at(where)]))
    pos, owner = (np.concatenate(x) for x in zip(*hits)) if hits else (np.empty(0, np.int64), np.empty(0, np.int64))
    rec = batch.record_at(pos)

    def words_of(group: np.ndarray, p: np.ndarray) -> pd.Series:
        """Words covered by windows at p, in order of group: windows that overlap count once."""
        order = np.lexsort((p, group))
        g, q = group[order], p[order]
        gap = np.r_[m, np.minimum(m, np.diff(q))] if len(q) else np.empty(0)
        gap[np.r_[True, g[1:] != g[:-1]]] = m if len(q) else 0
        return pd.Series(gap).groupby(g).sum()

    any_ = np.unique(np.stack([rec, pos], 1), axis=0) if len(pos) else np.empty((0, 2), np.int64)
    share = words_of(any_[:, 0], any_[:, 1]) if len(any_) else pd.Series(dtype=float)
    out = pd.DataFrame({"record": batch.records, "share": share.reindex(range(len(lengths)), fill_value=0).to_numpy() / np.maximum(lengths, 1)})
    if not len(pos):
        return out.assign(best=np.int64(-1), best_share=0.0)
    pairs = np.unique(np.stack([rec, owner, pos], 1), axis=0)
    key, inverse = np.unique(pairs[:, :2], axis=0, return_inverse=True)
    per = words_of(inverse, pairs[:, 2]).to_numpy()
    top = np.lexsort((key[:, 1], -per, key[:, 0]))
    first = np.flatnonzero(np.r_[True, key[top][1:, 0] != key[top][:-1, 0]])
    best = pd.Series(key[top][first, 1], index=key[top][first, 0])
    most = pd.Series(per[top][first], index=key[top][first, 0])
    return out.assign(best=best.reindex(range(len(lengths)), fill_value=-1).to_numpy(), best_share=most.reindex(range(len(lengths)), fill_value=0).to_numpy() / np.maximum(lengths, 1))


_SEGMENT = "shard bigint, words binary, starts binary, records binary, sorted binary"
_PACKED = "shard bigint, keys binary, rows binary"
#: Most keys of a batch that are broadcast to the segments; beyond, both are shuffled by shard.
BROADCAST_KEYS = 1_000_000


def _build(key: tuple, t: pa.Table) -> pa.Table:
    """Rows (key, row) of a shard -> its segment, one row."""
    k, r = t.column("key").to_numpy(), t.column("row").to_numpy()
    order = np.argsort(k, kind="stable")
    s = Segment.of_keys(k[order].view(np.uint64), r[order])
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in (("words", s.words), ("starts", s.starts), ("records", s.records), ("sorted", s.order))}})


def _pack(key: tuple, t: pa.Table) -> pa.Table:
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([t.column("key").to_numpy().tobytes()], pa.binary()), "rows": pa.array([t.column("row").to_numpy().tobytes()], pa.binary())})


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's shard and a batch's keys of that shard -> (key, row, first_row) of the keys that both have."""
    for b in batches:
        for words, starts, records, order, keys, rows in zip(*(b.column(c).to_pylist() for c in ("words", "starts", "records", "sorted", "keys", "rows"))):
            seg = Segment(np.frombuffer(words, np.uint64), np.frombuffer(starts, np.int64), np.frombuffer(records, np.int64), 1, np.frombuffer(order, np.int64))
            k, r = np.frombuffer(keys, np.int64), np.frombuffer(rows, np.int64)
            at, hi = seg.find(k.view(np.uint64), np.arange(len(k)))
            hit = hi > at
            yield pa.record_batch([pa.array(k[hit]), pa.array(r[hit]), pa.array(seg.records[seg.record_at(seg.order[at[hit]])])], ["key", "row", "first_row"])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for words, records in zip(b.column("words").to_pylist(), b.column("records").to_pylist()):
            yield pa.record_batch([pa.array(np.frombuffer(words, np.int64)[::2]), pa.array(np.frombuffer(records, np.int64))], ["key", "row"])


class History:
    """All that is accepted, as segments in tables of the shared folder.

    A key is in it once, with the row that brought it. accept() looks a batch up, adds what is new as
    one more segment, and merges segments of like size; no other segment is written again. The list
    of segments is held by the driver, a few for each power of two of their sizes.
    """

    def __init__(self, spark: SparkSession, rows_per_shard: int = GROUP_ROWS):
        self.spark, self.rows_per_shard = spark, rows_per_shard
        self.segments: list[tuple[DataFrame, int, int]] = []  # table, shards, keys

    def _shards(self, n: int) -> int:
        return max(1, -(-n // self.rows_per_shard))

    def _segment(self, keys: DataFrame, n: int) -> tuple[DataFrame, int, int]:
        shards = self._shards(n)
        table = keys.select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "row").groupBy("shard").applyInArrow(_build, _SEGMENT)
        return written(table, "segment"), shards, n

    def find(self, keys: DataFrame, n: int) -> DataFrame:
        """(key, row, first_row) of the keys (key, row), n of them, that history has."""
        hits = self.spark.createDataFrame([], "key bigint, row bigint, first_row bigint")
        for table, shards, _ in self.segments:
            packed = keys.select(F.pmod("key", F.lit(shards)).alias("shard"), "key", "row").groupBy("shard").applyInArrow(_pack, _PACKED)
            hits = hits.unionAll(table.join(F.broadcast(packed) if n <= BROADCAST_KEYS else packed, "shard").mapInArrow(_search, "key bigint, row bigint, first_row bigint"))
        return hits

    def rows(self) -> DataFrame:
        """(key, row) of all that is in it."""
        empty = self.spark.createDataFrame([], "key bigint, row bigint")
        return reduce(DataFrame.unionByName, [table.select("words", "records").mapInArrow(_rows_of, empty.schema) for table, _, _ in self.segments], empty)

    def accept(self, batch: DataFrame) -> DataFrame:
        """(key, first_row) for every key of a batch (key bigint, row bigint): the row that history has under it, else the batch's lowest.

        NULL keys and zeros are no keys. A key repeated in very many rows is combined map-side first.
        """
        keys = written(batch.where("key is not null and key != 0").groupBy("key").agg(F.min("row").alias("row")), "batch")
        n = keys.count()
        if not n:
            return keys.select("key", F.col("row").alias("first_row"))
        known = written(self.find(keys, n), "known") if self.segments else None
        new = keys if known is None else keys.join(known.select("key"), "key", "left_anti")
        added = n if known is None else n - known.count()
        first = keys.select("key", F.col("row").alias("first_row")) if known is None else keys.join(known.select("key", "first_row"), "key", "left").select("key", F.coalesce("first_row", "row").alias("first_row"))
        if added:
            self.segments.append(self._segment(new, added))
        while len(self.segments) > 1 and self.segments[-1][2] * 2 > self.segments[-2][2]:
            b, a = self.segments.pop(), self.segments.pop()
            both = a[0].unionByName(b[0]).select("words", "records").mapInArrow(_rows_of, "key bigint, row bigint")
            self.segments.append(self._segment(both, a[2] + b[2]))
            drop_written(a[0])
            drop_written(b[0])
        return first


def key_rows(keys: DataFrame, rows_per_shard: int = GROUP_ROWS) -> DataFrame:
    """(key, first_row) for every key of keys (key bigint, batch int, row bigint), once: the row that brought it.

    Batches are taken in order and looked up in the history of those before, as many at once as hold
    as many keys as all before them, and rows_per_shard at least: rounds follow the logarithm of the
    keys, not the number of batches. Of a round, the earliest batch brings a key, in it the lowest row.
    """
    history = History(keys.sparkSession, rows_per_shard)
    sizes = keys.where("batch is not null and key is not null and key != 0").groupBy("batch").count().orderBy("batch").collect()
    before, held, low = 0, 0, None
    for i, r in enumerate(sizes):
        low, held = r["batch"] if low is None else low, held + r["count"]
        if held >= max(before, rows_per_shard) or i == len(sizes) - 1:
            some = keys.where(F.col("batch").between(low, r["batch"])).groupBy("key").agg(F.min(F.struct("batch", "row")).alias("m"))
            history.accept(some.select("key", F.col("m.row").alias("row")))
            before, held, low = before + held, 0, None
    return history.rows().select("key", F.col("row").alias("first_row"))


def first_rows(keys: DataFrame, rows_per_shard: int = GROUP_ROWS) -> DataFrame:
    """(key, batch, first_row) for keys (key bigint, batch int, row bigint): the row that brought the key, see key_rows()."""
    return keys.where("batch is not null").select("key", "batch").distinct().join(key_rows(keys, rows_per_shard), "key").select("key", "batch", "first_row")


def covered_rows(texts: DataFrame, min_words: int = 12, rows_per_shard: int = GROUP_ROWS) -> DataFrame:
    """(row_id, share, best_row_id, best_runs) for the rows of every batch but the first that hold a text.

    texts: row_id bigint, batch int, text. share: how much of the text's words (runs of a-z and 0-9,
    each <...> a space) lie in runs of min_words words that a row of an earlier batch holds;
    best_row_id: the row that brought most of these runs (of several the lowest), NULL if there are
    none; best_runs: how many. Runs within one batch don't count. NULL, empty and shorter texts have
    a share of 0. Batches are taken in order, each against segments of those before it.
    """
    spark = texts.sparkSession

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                hashes, starts, known, _ = ascii_runs(some.column(2).to_pylist(), min_words, min_words)
                n = np.diff(np.r_[starts, len(hashes)])
                at = pa.array(np.repeat(np.asarray(known, np.int64), n))
                pos = np.arange(len(hashes)) - np.repeat(starts, n)
                yield pa.record_batch([some.column(0).take(at), some.column(1).take(at), pa.array(pos.astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(np.repeat(n, n).astype(np.int32))], ["row", "batch", "pos", "key", "n"])

    base = texts.where("row_id is not null and batch is not null").select("row_id", "batch", "text")
    history, out = History(spark, rows_per_shard), []
    batches = [r["batch"] for r in base.select("batch").distinct().orderBy("batch").collect()]
    for i, batch in enumerate(batches):
        found = base.where(F.col("batch") == batch).mapInArrow(runs, "row bigint, batch int, pos int, key bigint, n int")
        held = written(found, "runs")
        first = written(history.accept(held.select("key", "row")), "firsts")
        if i:
            # what the batch itself brought isn't history
            mine = held.select("row").distinct()
            old = first.join(mine.withColumnRenamed("row", "first_row"), "first_row", "left_anti")
            hits = held.join(old, "key")
            gaps = F.sort_array(F.collect_set("pos"))
            words = F.aggregate(F.transform(F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda x, k: F.least(x - gaps[k], F.lit(min_words))), F.lit(min_words), lambda x, y: x + y)
            share = hits.groupBy("row").agg((words / (F.max("n") + min_words - 1)).alias("share"))
            best = hits.groupBy("row", "first_row").agg(F.count_distinct("pos").alias("c")).groupBy("row").agg(F.max(F.struct("c", (-F.col("first_row")).alias("f"))).alias("m"))
            out.append(written(share.join(best, "row").select(F.col("row").alias("row_id"), "share", (-F.col("m.f")).alias("best_row_id"), (F.col("m.c")).cast("int").alias("best_runs")), "covered"))
        drop_written(held)
    empty = spark.createDataFrame([], "row_id bigint, share double, best_row_id bigint, best_runs int")
    later = base.where(F.col("batch") > F.lit(batches[0] if batches else 0)).select("row_id")
    return later.join(reduce(DataFrame.unionByName, out, empty), "row_id", "left").select("row_id", F.coalesce("share", F.lit(0.0)).alias("share"), "best_row_id", F.coalesce("best_runs", F.lit(0)).alias("best_runs"))
