"""Evaluation texts leaking into training text: Wu-Manber search for many patterns at once.

The alphabet is words. Patterns are all runs of min_words consecutive words of the test items. A
shift table over blocks of two words tells how far the window may jump; where it may not, a table
by suffix hash names the patterns that can end there, and comparing the words confirms them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import WordHash, mixed, run_hashes, unicode_words

#: Most words of items in one block of patterns; larger item tables are searched block by block.
BLOCK_WORDS = 2_000_000


class Patterns:
    """Shift and suffix tables of one block of items; its size is bounded by BLOCK_WORDS."""

    def __init__(self, items: list[tuple[int, list[str]]], m: int):
        if m < 2:
            raise ValueError("patterns need at least two words")
        self.m = m
        vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.vocabulary, self.n = vocabulary, len(vocabulary) + 1
        runs, owners = [], []
        for item, words in items:
            codes = np.array([vocabulary[w] for w in words], np.int64)
            if len(codes) >= m:
                runs.append(np.lib.stride_tricks.sliding_window_view(codes, m))
                owners.append(np.full(len(codes) - m + 1, item, np.int64))
        self.runs = np.concatenate(runs) if runs else np.empty((0, m), np.int64)
        owners_ = np.concatenate(owners) if owners else np.empty(0, np.int64)
        # equal runs are one pattern with several owners
        self.runs, which = np.unique(self.runs, axis=0, return_inverse=True) if len(self.runs) else (self.runs, np.empty(0, int))
        order = np.argsort(which, kind="stable")
        self.owners, self.first = owners_[order], np.searchsorted(which[order], np.arange(len(self.runs) + 1))
        # shift: for a block of two words, its least distance from a pattern's end
        blocks = np.concatenate([self.runs[:, j] * self.n + self.runs[:, j + 1] for j in range(m - 1)]) if len(self.runs) else np.empty(0, np.int64)
        distance = np.repeat(np.arange(m - 2, -1, -1), len(self.runs))
        self.block, at = np.unique(blocks, return_inverse=True)
        self.shift = np.full(len(self.block), m - 1)
        np.minimum.at(self.shift, at, distance)
        # suffix buckets: patterns in order of the hash of their last words
        tail = self._hash(self.runs)
        self.order = np.argsort(tail, kind="stable")
        self.tail = tail[self.order]

    def _hash(self, runs: np.ndarray) -> np.ndarray:
        h = np.zeros(len(runs), np.uint64)
        for j in range(runs.shape[1] if runs.ndim == 2 else 0):
            h = mixed(h + runs[:, j].astype(np.uint64) + np.uint64(1))
        return h

    def search(self, words: np.ndarray, doc_of: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) hits. words: coded texts end to end; starts and ends of each document in it.

        All windows advance in step, each by its own shift.
        """
        m = self.m
        if not len(self.runs):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        doc = np.flatnonzero(ends - starts >= m)
        pos = starts[doc] + m - 1  # the window's last word
        hits_d, hits_p = [], []
        while len(pos):
            key = words[pos - 1] * self.n + words[pos]
            key[(words[pos - 1] == 0) | (words[pos] == 0)] = -1
            at = np.searchsorted(self.block, key)
            at[at == len(self.block)] = 0
            known = self.block[at] == key
            shift = np.where(known, self.shift[at], m - 1)
            stop = shift == 0
            if stop.any():
                p, d = pos[stop], doc[stop]
                window = words[p[:, None] + np.arange(1 - m, 1)]
                h = self._hash(window)
                lo, hi = np.searchsorted(self.tail, h, "left"), np.searchsorted(self.tail, h, "right")
                for row in np.flatnonzero(hi > lo):
                    for k in self.order[lo[row] : hi[row]]:
                        if np.array_equal(self.runs[k], window[row]):
                            hits_d.append(d[row])
                            hits_p.append(k)
            pos = pos + np.maximum(shift, 1)
            go = pos < ends[doc]
            pos, doc = pos[go], doc[go]
        if not hits_d:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        d, p = np.array(hits_d), np.array(hits_p)
        n = self.first[p + 1] - self.first[p]
        return np.repeat(d, n), np.concatenate([self.owners[self.first[k] : self.first[k + 1]] for k in p])


def _blocks(items: DataFrame, item: str, text: str, m: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for row in items.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(item, text).toLocalIterator():
        words = unicode_words(row[1])
        if len(words) < m:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    yield block


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", min_words: int = 12) -> DataFrame:
    """(doc, item) for every document that shares a run of at least min_words words with a test item.

    Words are runs of Unicode letters and digits after lower-casing, each <...> taken for a space.
    Both ids are integers. Texts that are NULL, empty or shorter than min_words match nothing, nor do
    shorter passages. Whole texts are searched, however long. Repeated documents or items give one
    row an id pair. Empty tables give an empty result; further columns are not read.

    The item table is streamed to the driver in blocks of at most BLOCK_WORDS words (the search needs
    all of a block at once); each block is one pass over the documents, without any shuffle but that
    of the hits.
    """
    spark = docs.sparkSession
    found = None
    for block in _blocks(items, item, passage, min_words):
        patterns = spark.sparkContext.broadcast(Patterns(block, min_words))

        def search(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            p = patterns.value
            get = p.vocabulary.get
            for batch in batches:
                ids, coded = batch.column(0).to_numpy(zero_copy_only=False), []
                for t in batch.column(1).to_pylist():
                    coded.append(np.fromiter((get(w, 0) for w in unicode_words(t)), np.int64))
                lengths = np.array([len(x) for x in coded], np.int64)
                ends = np.cumsum(lengths)
                d, i = p.search(np.concatenate(coded) if coded else np.empty(0, np.int64), ids, ends, ends - lengths)
                pairs = np.unique(np.stack([ids[d], i], 1), axis=0) if len(d) else np.empty((0, 2), np.int64)
                yield pa.record_batch([pa.array(pairs[:, 0].astype(np.int64)), pa.array(pairs[:, 1].astype(np.int64))], ["doc", "item"])

        hits = docs.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).cast("bigint"), F.col(text)).mapInArrow(search, "doc bigint, item bigint")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct().select(F.col("doc").alias(doc), F.col("item").alias(item))
