"""Filling containers of fixed capacity: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Where the public vocabulary files lie; a parameter of every function that counts tokens.
TOKENIZERS = os.environ.get("POSTMILL_TOKENIZERS", "/opt/tokenizers")
#: Items aimed at in one group: large enough that open containers waste next to nothing.
GROUP_ITEMS = 5_000
# Fixed value: the splitting pattern that belongs to the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoder(folder: str):
    import tiktoken

    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(doc, n_tokens) of every row; NULL and empty texts have 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(folder)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64())], ["doc", "n_tokens"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.col(text).cast("string")).mapInArrow(count, f"doc {kind}, n_tokens bigint").withColumnRenamed("doc", doc)


class _Tree:
    """Tournament tree over bins: an inner node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for size; its room is taken."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        bin_ = i - self.leaves
        room[i] -= size
        i //= 2
        while i:
            best = room[2 * i] if room[2 * i] >= room[2 * i + 1] else room[2 * i + 1]
            if room[i] == best:
                break
            room[i] = best
            i //= 2
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. Every size is at most capacity; ties keep their order."""
    out = np.empty(len(sizes), np.int64)
    tree = _Tree(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        out[i] = tree.place(int(sizes[i]))
    return out


def pack(sized: DataFrame, doc: str = "doc_id", size: str = "n_tokens", capacity: int = 2048, seed: int = 0, group_items: int = GROUP_ITEMS, rows: int | None = None) -> DataFrame:
    """(doc, piece, first_token, n_tokens, container) for every row of sized.

    A document larger than capacity is split into pieces that fill whole containers, and a rest that
    is packed like any other item; nothing else is split. Documents of size 0 or NULL take no room and
    get a container all the same. container is unique over all groups. Groups are random by doc (a
    hash with seed), so each holds the same mix of sizes; their number follows from the row count.
    doc is unique; repeated rows are items of their own but share a group. An empty table gives an
    empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = sized.count() if rows is None else rows
    n = max(1, round(rows / group_items))
    kind = sized.schema[doc].dataType.simpleString()
    items = sized.select(F.col(doc).alias("doc"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("total"))
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.withColumns({"first_token": F.col("piece").cast("bigint") * capacity, "n_tokens": F.least(F.lit(capacity).cast("bigint"), F.col("total") - F.col("piece").cast("bigint") * capacity)})
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc", "piece", F.lit(seed)), F.lit(n)).cast("bigint"))

    def fill(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, [("n_tokens", "descending"), ("doc", "ascending"), ("piece", "ascending")])
        table = table.take(order)
        bins = first_fit_decreasing(table["n_tokens"].to_numpy(), capacity)
        group = table["grp"].to_numpy()
        return pa.table({"doc": table["doc"], "piece": table["piece"], "first_token": table["first_token"], "n_tokens": table["n_tokens"], "container": pa.array(group * (1 << 32) + bins)})

    out = pieces.select("doc", "piece", "first_token", "n_tokens", "grp").groupBy("grp").applyInArrow(fill, f"doc {kind}, piece int, first_token bigint, n_tokens bigint, container bigint")
    return out.withColumnRenamed("doc", doc)


def pack_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = 2048, folder: str = TOKENIZERS, seed: int = 0) -> DataFrame:
    """pack() of the texts' tokens under a public byte-level BPE vocabulary."""
    return pack(token_counts(docs, doc, text, folder), doc, "n_tokens", capacity, seed, rows=docs.count())
