"""What changed between consecutive full snapshots.

Every row becomes two 64-bit key hashes and two 64-bit row hashes; these compact rows are hashed
into buckets of bounded size, sorted in numpy there, and compared by sorted set differences. Only
for the keys that differ are full values fetched, by a second scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import GROUP_ROWS, groups_for

_KINDS = np.array(["added", "removed", "changed"])
_OUT = "src bigint, snapshot bigint, held bigint, k1 bigint, k2 bigint, change_kind string"


def _hashes(cols: list[str]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the values as stored. A null takes a place of its own."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string")]
    return F.xxhash64(*parts), F.xxhash64(F.lit(7919), *parts)


def _in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the sorted, distinct keys occur in the other sorted, distinct array, and where."""
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return np.where(among[at] == keys, at, -1) if len(among) else np.full(len(keys), -1)


def _compare(table: pa.Table) -> pa.Table:
    """One bucket: for every source, consecutive deliveries' sorted keys against each other."""
    src, ord_, n_ord, k1, k2, r1, r2, snap, nxt, last = (table[c].to_numpy() for c in ("src", "ord", "n_ord", "k1", "k2", "r1", "r2", "snap", "next_snap", "prev_snap"))
    key = np.empty(len(k1), dtype=[("a", "<i8"), ("b", "<i8")])
    key["a"], key["b"] = k1, k2
    out: list[tuple] = []
    order = np.lexsort((k2, k1, ord_, src))
    src, ord_, n_ord, key, r1, r2, snap, nxt, last = (x[order] for x in (src, ord_, n_ord, key, r1, r2, snap, nxt, last))
    starts = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (ord_[1:] != ord_[:-1])]) if len(src) else np.array([], int)
    ends = np.r_[starts[1:], len(src)]
    # a pair of 64-bit words as one number in order of (a, b), so that searchsorted can use it
    dense = np.unique(key, return_inverse=True)[1] if len(key) else np.array([], int)
    blocks = {(src[s], ord_[s]): (s, e) for s, e in zip(starts, ends)}
    none = np.array([], int)
    for (source, o), (s, e) in blocks.items():
        now = dense[s:e]
        if o > 0:
            ps, pe = blocks.get((source, o - 1), (0, 0))
            before = dense[ps:pe] if pe else none
            at = _in(now, before)
            new = at < 0
            both = np.flatnonzero(~new)
            differ = both[(r1[s:e][both] != r1[ps:pe][at[both]]) | (r2[s:e][both] != r2[ps:pe][at[both]])]
            for rows, kind in ((np.flatnonzero(new), 0), (differ, 2)):
                rows = rows + s
                out.append((src[rows], snap[rows], snap[rows], key["a"][rows], key["b"][rows], np.full(len(rows), kind)))
        if o + 1 < n_ord[s]:
            ns, ne = blocks.get((source, o + 1), (0, 0))
            gone = np.flatnonzero(_in(now, dense[ns:ne] if ne else none) < 0) + s
            out.append((src[gone], nxt[gone], snap[gone], key["a"][gone], key["b"][gone], np.full(len(gone), 1)))
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.array([], np.int64)] * 6
    return pa.table(
        {n: pa.array(c.astype(np.int64), pa.int64()) for n, c in zip(("src", "snapshot", "held", "k1", "k2"), cols)} | {"change_kind": pa.array(_KINDS[cols[5].astype(int)].tolist(), pa.string())}
    )


def snapshot_changes(df: DataFrame, source: str = "ats_type", snapshot: str = "snapshot_no", key: str = "global_id", ignore: tuple[str, ...] = ("slice_file", "slice_pos"), keep: tuple[str, ...] = (), rows_per_group: int = GROUP_ROWS) -> DataFrame:
    """Rows added, removed or changed between a source's consecutive deliveries.

    Result: source, snapshot (of the later delivery), key, change_kind, and the columns in keep as
    before_<c> and after_<c> (of the least row where a key has several).

    - All rows of a source with one snapshot are a delivery; it is compared with the source's latest
      earlier one. The first gives no rows; a source without rows in a snapshot has no delivery.
    - Changed: the set of distinct rows of the key differs in a column other than snapshot and those
      in ignore. NULL equals NULL and differs from an empty string; repeated rows count once.
    - A NULL source or key is a value of its own; rows without a snapshot belong to no delivery.
    - An empty table gives an empty result. Columns that the caller adds are compared as well.
    """
    spark = df.sparkSession
    values = [c for c in df.columns if c not in {source, snapshot, *ignore}]
    (k1, k2), (r1, r2), (s1, _) = _hashes([source, key]), _hashes(values), _hashes([source])
    held = df.where(F.col(snapshot).isNotNull())
    compact = held.select(s1.alias("src"), F.col(snapshot).cast("bigint").alias("snap"), k1.alias("k1"), k2.alias("k2"), r1.alias("r1"), r2.alias("r2"))
    by_source = Window.partitionBy("src").orderBy("snap")
    deliveries = (
        held.select(s1.alias("src"), F.col(snapshot).cast("bigint").alias("snap"))
        .distinct()
        .withColumns({"ord": F.row_number().over(by_source) - 1, "n_ord": F.count("*").over(Window.partitionBy("src")), "next_snap": F.coalesce(F.lead("snap").over(by_source), F.lit(0)), "prev_snap": F.coalesce(F.lag("snap").over(by_source), F.lit(0))})
    )
    n = groups_for(df.count(), spark, rows_per_group)
    # distinct rows first, combined map-side, so a key repeated in a third of all rows costs nothing
    per_key = compact.distinct().groupBy("src", "snap", "k1", "k2").agg(F.bit_xor("r1").alias("r1"), F.bit_xor("r2").alias("r2"))
    found = (
        per_key.join(deliveries, ["src", "snap"])
        .withColumn("bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(n)))
        .groupBy("bucket")
        .applyInArrow(_compare, _OUT)
    )
    # full values of the differing keys only
    full = held.select(
        F.col(source), F.col(key), s1.alias("src"), F.col(snapshot).cast("bigint").alias("held"), k1.alias("k1"), k2.alias("k2"), *([F.struct(*[F.col(c) for c in keep]).alias("_row")] if keep else [])
    )
    if not keep:
        named = found.join(full, ["src", "held", "k1", "k2"]).groupBy("src", "snapshot", "k1", "k2", "change_kind", source, key).agg(F.lit(1).alias("one"))
        return named.select(F.col(source), F.col("snapshot").cast(df.schema[snapshot].dataType).alias(snapshot), F.col(key), "change_kind")
    prior = deliveries.select("src", F.col("snap").alias("snapshot"), F.col("prev_snap").alias("before_held"))
    sides = found.join(prior, ["src", "snapshot"]).select(
        "src", "snapshot", "k1", "k2", "change_kind", F.explode(F.when(F.col("change_kind") == "added", F.array("snapshot")).when(F.col("change_kind") == "removed", F.array("before_held")).otherwise(F.array("before_held", "snapshot"))).alias("held")
    )
    got = sides.join(full, ["src", "held", "k1", "k2"]).groupBy("src", "snapshot", "k1", "k2", "change_kind", source, key).agg(
        F.min(F.when(F.col("held") < F.col("snapshot"), F.col("_row"))).alias("_before"), F.min(F.when(F.col("held") == F.col("snapshot"), F.col("_row"))).alias("_after")
    )
    return got.select(F.col(source), F.col("snapshot").cast(df.schema[snapshot].dataType).alias(snapshot), F.col(key), "change_kind", *[F.col(f"{side}.{c}").alias(f"{side[1:]}_{c}") for side in ("_before", "_after") for c in keep])
