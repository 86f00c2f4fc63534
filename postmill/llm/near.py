"""Near-duplicate records: deletion-variant signatures, equality join, exact verification.

A record's word runs (shingles) get a signature of minhash symbols, cut into segments. Two records
agree in a symbol with the probability of their similarity, so in a segment of WIDTH symbols all but
at most one agree far more often than all do. Every segment is indexed under its WIDTH variants with
one symbol left out: segments that differ in at most one symbol share a variant, found by an equality
join. Candidates are verified exactly, by the shingles of their whole texts.

Shingles weigh less in the signature the more records have them (counted over all records), so that
unrelated records that share turns of phrase seldom meet; a record of nothing but common shingles
still has a full signature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.graph import components
from postmill.llm.words import ascii_runs, mixed
from postmill.session import drop_written, groups_for, written

#: Segments of a signature, and symbols of a segment (see recall()).
SEGMENTS, WIDTH = 22, 6
#: A shingle that more than this share of the records have, and more than so many records, weighs
#: less in inverse proportion, down to the least weight.
COMMON, COMMON_ROWS, LEAST_WEIGHT = 0.02, 200, 0.25
#: Buckets in which shingles are counted: a bound of the table of weights, whatever the vocabulary.
BUCKETS = 1 << 18
#: Bits of an index key.
KEY_BITS = 56
#: Index entries aimed at in one group.
GROUP_ENTRIES = 1_000_000
#: Ids under one key beyond which its pairs are made by several tasks, block by block.
RUN = 2_000
#: Most ids of candidates that are broadcast to fetch their texts; beyond, the texts are shuffled.
BROADCAST_IDS = 1_000_000


def recall(similarity: float, segments: int = SEGMENTS, width: int = WIDTH) -> float:
    """Probability that a pair of the given (weighted) similarity shares a variant."""
    p = similarity + (1 - similarity) / 65536
    return 1 - (1 - p**width - width * p ** (width - 1) * (1 - p)) ** segments


_ROUND = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def signatures(shingles: np.ndarray, starts: np.ndarray, spread: np.ndarray | None, segments: int = SEGMENTS, width: int = WIDTH) -> np.ndarray:
    """(records, segments, width) symbols of 16 bits of records whose shingles lie end to end (each has one at least).

    spread: for each bucket the inverse of its weight. In each of width rounds every shingle falls
    into one of the segments, and the least of exponential variates of the shingles' weights wins
    there: two records have the same winner with the probability of their weighted similarity. An
    empty place takes the winner of another one, found by the same rule for all records.
    """
    n = len(starts)
    record = np.repeat(np.arange(n), np.diff(np.r_[starts, len(shingles)])) * segments
    slow = None if spread is None else spread[bucket(shingles)]
    out = np.empty((n, segments, width), np.uint16)
    for r in range(width):
        x = mixed(shingles ^ _ROUND[r])
        late = -np.log(((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52)
        if slow is not None:
            late *= slow
        low = np.full(n * segments, np.inf)
        np.minimum.at(low, record + (mixed(x) % np.uint64(segments)).astype(np.int64), late)
        low = low.reshape(n, segments)
        empty = np.isinf(low)
        filled, turn = low.copy(), 0
        while empty.any():
            i, s = np.nonzero(empty)
            place = _ROUND[(s + 131 * r) % 256] + np.uint64(turn)
            filled[i, s] = low[i, (mixed(place) % np.uint64(segments)).astype(np.int64)]
            empty, turn = np.isinf(filled), turn + 1
        out[:, :, r] = (mixed(filled.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out


def variants(symbols: np.ndarray) -> np.ndarray:
    """(records, segments, width) symbols -> (records, segments * width) keys: of KEY_BITS bits: each segment with one symbol left out, and which."""
    n, segments, width = symbols.shape
    parts = mixed(symbols.astype(np.uint64) + (np.arange(width, dtype=np.uint64) << np.uint64(16)) + np.uint64(1))
    place = _ROUND[: segments * width].reshape(segments, width)
    return (mixed((parts.sum(2, dtype=np.uint64)[:, :, None] - parts) + place[None]) >> np.uint64(64 - KEY_BITS)).reshape(n, -1)


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low bytes of 64-bit numbers, all first bytes, then all second ones: zeros lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _whole(planes: bytes, size: int) -> np.ndarray:
    p = np.frombuffer(planes, np.uint8).reshape(size, -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, :size] = p.T
    return out.view(np.int64).ravel()


def _key_bytes(groups: int) -> int:
    """Bytes of a key, once its group is known."""
    return (((1 << KEY_BITS) - 1) // groups).bit_length() + 7 >> 3


_COLD, _NOTICE, _BLOCK = 0, 1, 2
_INDEX = "grp int, kind int, key bigint, data binary"


def _expand(groups: int):
    """(id, sig) -> rows of the index: per group the keys and ids of a batch.

    A key that more than RUN / 10 records of a batch have is sent as blocks of ids, each to a group of its own, with a notice to the key's group.
    """

    size_of_key = _key_bytes(groups)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, SEGMENTS, WIDTH)
            keys = variants(sig)
            ids = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            keys = keys.ravel()
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[first, len(keys)])
            rows, cold = [], np.ones(len(keys), bool)
            for at, n in zip(first[size > RUN // 10], size[size > RUN // 10]):
                k, block = int(keys[at]), np.sort(ids[at : at + n])
                cold[at : at + n] = False
                rows.append((k % groups, _NOTICE, k, b""))
                for s in range(0, n, RUN):
                    part = block[s : s + RUN]
                    rows.append((int(mixed(keys[at : at + 1] + part[:1].view(np.uint64))[0] % np.uint64(groups)), _BLOCK, k, part.tobytes()))
            keys, ids = keys[cold], ids[cold]
            grp = (keys % np.uint64(groups)).astype(np.int64)
            order = np.argsort(grp, kind="stable")
            keys, ids, grp = keys[order], ids[order], grp[order]
            first = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]]) if len(grp) else np.empty(0, np.int64)
            for s, e in zip(first, np.r_[first[1:], len(grp)]):
                rows.append((int(grp[s]), _COLD, None, _planes(keys[s:e] // np.uint64(groups), size_of_key) + _planes(ids[s:e], 8)))
            for s in range(0, len(rows), 1000):
                g, kind, k, data = zip(*rows[s : s + 1000])
                yield pa.record_batch([pa.array(g, pa.int32()), pa.array(kind, pa.int32()), pa.array(k, pa.int64()), pa.array(data, pa.binary())], ["grp", "kind", "key", "data"])

    return expand


_MET = "a bigint, b bigint, key bigint, ids binary"


def _meet(groups: int):
    """A group of the index -> pairs (a, b) of ids under one key, and blocks (key, ids) of keys with many."""

    size_of_key = _key_bytes(groups)

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold, notices = [], set()

        def blocks(ks: list[int], ids: list[bytes]) -> pa.RecordBatch:
            return pa.record_batch([pa.nulls(len(ks), pa.int64()), pa.nulls(len(ks), pa.int64()), pa.array(ks, pa.int64()), pa.array(ids, pa.binary())], ["a", "b", "key", "ids"])

        for b in batches:
            kinds, ks = b.column("kind").to_numpy(), b.column("key").to_pylist()
            data = b.column("data")
            for i, kind in enumerate(kinds):
                if kind == _BLOCK:
                    yield blocks([ks[i]], [data[i].as_py()])
                elif kind == _NOTICE:
                    notices.add(ks[i] // groups)
                else:
                    raw = data[i].as_py()
                    n = len(raw) // (size_of_key + 8) * size_of_key
                    cold.append((_whole(raw[:n], size_of_key), _whole(raw[n:], 8)))
        if not cold:
            return
        k, ids = (np.concatenate(x) for x in zip(*cold))
        cold.clear()
        order = np.lexsort((ids, k))
        k, ids = k[order], ids[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[first, len(k)])
        large = size > RUN
        if notices:
            large |= np.isin(k[first], np.array(sorted(notices), np.int64))
        small = np.ones(len(k), bool)
        for at, n in zip(first[large], size[large]):
            small[at : at + n] = False
            whole = int(k[at]) * groups + key[0].as_py()  # the group is the remainder
            for s in range(at, at + n, RUN):
                yield blocks([whole], [ids[s : min(s + RUN, at + n)].tobytes()])
        several = np.repeat(size > 1, size) & small
        k, ids = k[several], ids[several]
        d, at, found = 1, np.arange(len(k)), []
        while len(at := at[at + d < len(k)]) and len(at := at[k[at] == k[at + d]]):
            found.append(np.stack([ids[at], ids[at + d]], 1))
            d += 1
            if sum(map(len, found)) > 500_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    return meet


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    ab = np.concatenate(found)
    ab = ab[np.lexsort((ab[:, 1], ab[:, 0]))]
    ab = ab[np.r_[True, (ab[1:] != ab[:-1]).any(1)]]
    return pa.record_batch([pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.nulls(len(ab), pa.int64()), pa.nulls(len(ab), pa.binary())], ["a", "b", "key", "ids"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right) blocks of ids -> their pairs; of a block with itself, each pair once."""
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            same = x == y
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            for i in range(len(x)):
                other = y[i + 1 :] if same else y
                yield pa.record_batch([pa.array(np.minimum(x[i], other)), pa.array(np.maximum(x[i], other))], ["a", "b"])


def _texts(column: pa.Array, step: int = 256) -> Iterator[tuple[int, list]]:
    for s in range(0, len(column), step):
        yield s, column.slice(s, step).to_pylist()


def _counter(shingle: int, least: int):
    """(id, text) -> (bucket, n): how often shingles of each bucket occur; bucket -1 counts the records."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, records = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for _, texts in _texts(b.column(0)):
                runs, starts, known, _ = ascii_runs(texts, shingle, least)
                total += np.bincount(bucket(runs), minlength=BUCKETS)
                records += len(known)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.r_[-1, at]), pa.array(np.r_[records, total[at]])], ["bucket", "n"])

    return count


def _signer(shingle: int, least: int, spread):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, texts in _texts(b.column(1)):
                runs, starts, known, copies = ascii_runs(texts, shingle, least)
                if len(known):
                    sig = signatures(runs, starts, spread.value)
                    yield pa.record_batch(
                        [b.column(0).slice(s, len(texts)).take(pa.array(known)), pa.array(copies, pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                        ["id", "copy", "sig"],
                    )

    return sign


def similarities(left: list[str], right: list[str], shingle: int) -> np.ndarray:
    """Share of the distinct shingles of either text that occur in both, for pairs of texts (at most 256)."""
    both = np.zeros(len(left), np.int64)
    either = np.zeros(len(left), np.int64)
    parts = []
    for side, texts in ((0, left), (1, right)):
        runs, starts, known, _ = ascii_runs(texts, shingle, 0)
        owner = np.repeat(np.asarray(known, np.uint64), np.diff(np.r_[starts, len(runs)]))
        # one sort: pair, shingle (55 bits), side
        parts.append((owner << np.uint64(56)) | ((runs >> np.uint64(8)) & ~np.uint64(1)) | np.uint64(side))
    x = np.sort(np.concatenate(parts))
    if len(x):
        x = x[np.r_[True, x[1:] != x[:-1]]]
        twice = (x[1:] >> np.uint64(1)) == (x[:-1] >> np.uint64(1))
        pair = (x >> np.uint64(56)).astype(np.int64)
        both += np.bincount(pair[1:][twice], minlength=len(left))
        either += np.bincount(pair, minlength=len(left)) - both
    return both / np.maximum(1, either)


def _verifier(shingle: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                sims = similarities(some.column(2).to_pylist(), some.column(3).to_pylist(), shingle)
                keep = pa.array(sims >= threshold)
                yield pa.record_batch([some.column(0).filter(keep), some.column(1).filter(keep), pa.array(sims).filter(keep)], ["a", "b", "similarity"])

    return verify


def _spread(source: DataFrame, shingle: int, least: int) -> np.ndarray:
    """For each bucket the inverse weight of its shingles."""
    counts = source.select("text").mapInArrow(_counter(shingle, least), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = counts.column(0).to_numpy(), counts.column(1).to_numpy()
    total = np.zeros(BUCKETS)
    total[at[at >= 0]] = n[at >= 0]
    return np.clip(total / max(COMMON * n[at < 0].sum(), COMMON_ROWS), 1.0, 1 / LEAST_WEIGHT)


def near_pairs(texts: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 1, rows_key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of records with an integer id and a text.

    members: (id, rep) for every record with at least min_words words; records of the same words are
    copies and have the least id among them as rep. pairs: (a, b, similarity), a < b, for
    representatives that share at least threshold of the distinct shingles that occur in either.
    Words are runs of a-z and 0-9 of the lower-cased text, each <...> a space. NULL and empty texts,
    and those of fewer words than a shingle has, belong to no result. Whole texts are read.
    """
    spark = texts.sparkSession
    least = max(min_words, shingle)
    source = texts.select(F.col(rows_key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    spread = spark.sparkContext.broadcast(_spread(source, shingle, least))
    signed = written(source.mapInArrow(_signer(shingle, least, spread), "id bigint, copy binary, sig binary"), "signatures")
    copies = signed.groupBy("copy").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    several = written(copies.where("n > 1").select("copy", "rep"), "copies")
    members = signed.select("id", "copy").join(several, "copy", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    extra = signed.select("id", "copy").join(several, "copy").where("id != rep").select("id")
    reps = signed.join(extra, "id", "left_anti").select("id", "sig")
    groups = groups_for(signed.count() * SEGMENTS * WIDTH, spark, GROUP_ENTRIES)
    met = written(reps.mapInArrow(_expand(groups), _INDEX).groupBy("grp").applyInArrow(_meet(groups), _MET), "met")
    block = met.where("ids is not null").select("key", "ids", F.xxhash64("ids").alias("h"))
    jobs = block.alias("x").join(block.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.h") <= F.col("y.h"))).select("x.ids", F.col("y.ids").alias("other"))
    crowded = jobs.repartition(groups_for(0, spark)).mapInArrow(_across, "a bigint, b bigint")
    candidates = written(met.where("ids is null").select("a", "b").unionAll(crowded).distinct(), "candidates")
    drop_written(met)
    wanted = written(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = source.join(wanted, "id", "left_semi").repartition("id")
    of = lambda k: found.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))
    pairs = candidates.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_verifier(shingle, threshold), "a bigint, b bigint, similarity double")
    return pairs, members


def near_groups(texts: DataFrame, **kw) -> DataFrame:
    """(id, rep, group_id, n_links) for every record of near_pairs(): its class, and the links of its representative.

    Copies are not linked one by one: they share a representative.
    """
    pairs, members = near_pairs(texts, **kw)
    pairs = written(pairs, "pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    roots = components(pairs.select("a", "b")).withColumnsRenamed({"node": "rep", "root": "group_id"})
    return members.join(roots, "rep", "left").join(links, "rep", "left").select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def row_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(row_a, row_b): the pairs of representatives and of copies as pairs of rows, the smaller id first."""
    # only representatives with copies need the members; others stand for themselves
    copied = members.where("id != rep").select("rep", "id")
    several = copied.unionByName(copied.select("rep", F.col("rep").alias("id")).distinct())
    side = lambda k: several.select(F.col("rep").alias(k), F.col("id").alias(f"row_{k}"))
    across = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("row_a", "a").alias("p"), F.coalesce("row_b", "b").alias("q"))
    within = several.withColumnRenamed("id", "p").join(several.withColumnRenamed("id", "q"), "rep").where("p < q").select("p", "q")
    return across.unionByName(within).select(F.least("p", "q").alias("row_a"), F.greatest("p", "q").alias("row_b"))


def joined_text(*columns: str) -> Column:
    """Columns with a space between, NULL as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
