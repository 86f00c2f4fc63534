"""Sparse cosine similarity joins of short texts, over weighted character n-grams.

Each text is a sparse unit vector. Texts are dealt into chunks, and each pair of chunks of one group
meets once, in numpy: the products of the rarer n-grams are summed over an inverted index; where this
sum and the lengths of what the common ones make up of both vectors can't reach the cosine, the pair
is put aside, and the products of the common n-grams are added for the others only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import groups_for

#: Buckets in which texts are counted by n-gram: a bound of the table of weights, whatever the alphabet.
BUCKETS = 1 << 18
#: Most texts of a chunk, about 20 MB of n-grams; a larger group is several chunks, each of which meets every other.
CHUNK_ROWS = 16_384
#: Pairs of texts whose sums are held at once.
CELLS = 1 << 19
#: Texts that are worth a task of their own. It only divides the work.
TASK_ROWS = 250
#: N-grams count as common as long as they make up this share of the least cosine, and as many at most. Both only divide the work.
COMMON_SHARE, COMMON_GRAMS = 0.4, 256

Grams = Callable[[str], dict[str, float]]


def character_grams(text: str) -> dict[str, float]:
    """Letters, which count 1.5, pairs of neighbours, and pairs with one letter between, which count 0.5. A typing error changes few of them."""
    out: dict[str, float] = {}
    for g in text:
        out[g] = out.get(g, 0.0) + 1.5
    p = f"^{text}$"
    for i in range(len(p) - 1):
        out[p[i : i + 2]] = out.get(p[i : i + 2], 0.0) + 1.0
        if i + 2 < len(p):
            g = f"{p[i]}_{p[i + 2]}"
            out[g] = out.get(g, 0.0) + 0.5
    return out


def _hash(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram)


class Weighting:
    """Vectors of texts: counts of n-grams times (log(1 + texts / (texts with the n-gram + smooth * texts))) ** power."""

    def __init__(self, grams: Grams, counts: np.ndarray, n_texts: int, power: float = 1.0, smooth: float = 0.0):
        self.grams, self.counts = grams, counts
        n = max(1, n_texts)
        self.weight = np.log1p(n / np.maximum(counts + smooth * n, 1.0)) ** power

    def vectors(self, hashes: list[bytes], counts: list[bytes]) -> Vectors:
        """The unit vectors of texts as counted() gives them."""
        n = np.array([len(h) // 8 for h in hashes], np.int64)
        gram = np.frombuffer(b"".join(hashes), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        w = np.frombuffer(b"".join(counts), np.float32) * self.weight[(gram >> np.uint64(46)).astype(np.int64)]
        length = np.sqrt(np.bincount(row, w * w, minlength=len(n)))
        return Vectors(len(n), row, gram, w / length[row])


class Vectors(NamedTuple):
    """Sparse vectors of n texts; row ascends."""

    n: int
    row: np.ndarray
    gram: np.ndarray
    weight: np.ndarray


def vector_pairs(x: Vectors, y: Vectors, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) for every text i of x and j of y with a cosine of at least least, which is above 0; some at a time."""
    grams, yg = np.unique(y.gram, return_inverse=True)
    if not x.n or not len(grams):
        return
    xg = np.minimum(np.searchsorted(grams, x.gram), len(grams) - 1)
    hit = grams[xg] == x.gram
    xr, xg, xw = x.row[hit], xg[hit], x.weight[hit]
    often = np.argsort(-np.bincount(yg), kind="stable")[:COMMON_GRAMS]
    column = np.full(len(grams), -1)
    often = often[np.cumsum(np.bincount(yg, y.weight * y.weight)[often]) <= COMMON_SHARE * least * y.n]
    column[often] = np.arange(len(often))

    def split(n: int, row: np.ndarray, gram: np.ndarray, weight: np.ndarray) -> tuple:
        """The common n-grams as a matrix, and the lengths of its rows; the others as they came."""
        common, rest = (column[gram] >= 0), (column[gram] < 0)
        m = np.zeros((n, len(often)))
        m[row[common], column[gram[common]]] = weight[common]
        return m, np.sqrt(np.einsum("ij,ij->i", m, m)), row[rest], gram[rest], weight[rest]

    xm, x_length, xr, xg, xw = split(x.n, xr, xg, xw)
    ym, y_length, yr, yg, yw = split(y.n, y.row, yg, y.weight)
    order = np.argsort(yg, kind="stable")
    yr, yw = yr[order], yw[order]
    begin = np.r_[0, np.cumsum(np.bincount(yg, minlength=len(grams)))]
    bar = least - 1e-9
    size = max(1, CELLS // y.n)
    for s in range(0, x.n, size):
        b = min(size, x.n - s)
        own = slice(*np.searchsorted(xr, [s, s + b]))
        at = begin[xg[own]]
        n = begin[xg[own] + 1] - at
        met = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sums = np.bincount(np.repeat((xr[own] - s) * y.n, n) + yr[met], np.repeat(xw[own], n) * yw[met], minlength=b * y.n)
        cells = np.flatnonzero(sums.reshape(b, y.n) >= (bar - x_length[s : s + b] * y_length.max())[:, None])
        i, j = np.divmod(cells, y.n)
        near = sums[cells] >= bar - x_length[s + i] * y_length[j]
        i, j, cosine = i[near], j[near], sums[cells[near]]
        if 20 * len(i) > b * y.n:
            cosine += (xm[s : s + b] @ ym.T)[i, j]
        else:
            for k in range(0, len(i), 4096):
                cosine[k : k + 4096] += np.einsum("ij,ij->i", xm[s + i[k : k + 4096]], ym[j[k : k + 4096]])
        keep = cosine >= least
        yield s + i[keep], j[keep], cosine[keep]


def counted(texts: DataFrame, grams: Grams, rows: int | None = None) -> DataFrame:
    """texts with the hashes of each text's n-grams (64 bits each) and their counts (32); as it is if it has them. rows: how many, if that is known."""
    if "hashes" in texts.columns:
        return texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [grams(t) for t in b.column("text").to_pylist()]
            hashes = [np.fromiter(map(_hash, bag), np.uint64, len(bag)).tobytes() for bag in bags]
            counts = [np.fromiter(bag.values(), np.float32, len(bag)).tobytes() for bag in bags]
            yield pa.record_batch([*b.columns, pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], [*b.schema.names, "hashes", "counts"])

    # few bytes but much work a row: a number of partitions of our own, which isn't made less; a task for a few rows costs more than they do
    n = groups_for(0, texts.sparkSession)
    n = n if rows is None else min(n, -(-rows // TASK_ROWS) or 1)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.repartition(n).mapInArrow(count, f"{own}, hashes binary, counts binary")


def weighting(texts: DataFrame, grams: Grams, power: float = 1.0, smooth: float = 0.0) -> Weighting:
    """The Weighting of all of texts (column text, or as counted() gives them), counted in BUCKETS buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            hashes = b.column(0).to_pylist()
            row = np.repeat(np.arange(len(hashes)), [len(h) // 8 for h in hashes])
            bucket = (np.frombuffer(b"".join(hashes), np.uint64) >> np.uint64(46)).astype(np.int64)
            total += np.bincount(np.unique(row * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS)
            n += len(hashes)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], ["bucket", "n"])

    sums = counted(texts, grams).select("hashes").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = sums.column(0).to_numpy(), sums.column(1).to_numpy()
    counts = np.zeros(BUCKETS, np.int64)
    counts[at[at >= 0]] = n[at >= 0]
    return Weighting(grams, counts, int(n[at < 0].sum()), power, smooth)


def cosine_pairs(left: DataFrame, right: DataFrame | None, weights: Weighting, least: float) -> DataFrame:
    """(a, b, sim) for every pair of a row of left and one of right (id bigint, text) with a cosine of at least least.

    right None: of two rows of left, a < b. A column grp, where both have it, must be equal too.
    What is counted() and written already isn't counted again.
    Empty texts have no n-grams and no pair.
    """
    spark = left.sparkSession
    shared, n = spark.sparkContext.broadcast(weights), groups_for(0, spark)
    single = right is None
    by = F.col("grp") if "grp" in left.columns else F.lit("")

    def chunks(df: DataFrame) -> DataFrame:
        return df.groupBy(by.alias("grp")).agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("n"))

    def dealt(df: DataFrame, sizes: DataFrame, i: Column, j: Column, side: int) -> DataFrame:
        """Each text in every pair of chunks (i, j) of its group that holds its own; sizes: the chunks of its own and of the other side."""
        vectors = counted(df, weights.grams).select("id", by.alias("grp"), "hashes", "counts")
        vectors = vectors.join(sizes, "grp") if "grp" in left.columns else vectors.crossJoin(F.broadcast(sizes.drop("grp")))
        each = vectors.withColumn("own", F.pmod(F.xxhash64("id"), "n")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
        return each.select("grp", i.alias("i"), j.alias("j"), ((F.col("own") != i).cast("int") if single else F.lit(side)).alias("side"), "id", "hashes", "counts")

    own, other = F.col("own"), F.col("other")
    if single:
        met = dealt(left, chunks(left).withColumn("m", F.col("n")), F.least(own, other), F.greatest(own, other), 0)
    else:
        of_left, of_right = chunks(left), chunks(right)
        met = dealt(left, of_left.join(of_right.withColumnRenamed("n", "m"), "grp"), own, other, 0).unionAll(dealt(right, of_right.join(of_left.withColumnRenamed("n", "m"), "grp"), other, own, 1))

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        sides = [t.filter(pc.equal(t.column("side"), k)) for k in (0, 1)]
        itself = single and key[1] == key[2]
        x, y = (shared.value.vectors(s.column("hashes").to_pylist(), s.column("counts").to_pylist()) for s in (sides[0], sides[0 if itself else 1]))
        a_ids, b_ids = sides[0].column("id").to_numpy(), sides[0 if itself else 1].column("id").to_numpy()
        for i, j, sim in vector_pairs(x, y, least):
            a, b = a_ids[i], b_ids[j]
            if single:
                keep = a < b if itself else np.full(len(a), True)
                a, b, sim = np.minimum(a, b)[keep], np.maximum(a, b)[keep], sim[keep]
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(sim)], ["a", "b", "sim"])

    return met.repartition(n, "grp", "i", "j").groupBy("grp", "i", "j").applyInArrow(pairs, "a bigint, b bigint, sim double")
