import numpy as np

from postmill.llm.history import History, Segment, covered, covered_rows, first_rows
from postmill.llm.words import ascii_words

KEYS = "key bigint, batch int, row bigint"


def brute_share(text, history, m):
    runs = {tuple(h[i : i + m]) for h in history for i in range(len(h) - m + 1)}
    hit = [False] * len(text)
    for i in range(len(text) - m + 1):
        if tuple(text[i : i + m]) in runs:
            hit[i : i + m] = [True] * m
    return sum(hit) / max(1, len(text))


def test_coverage_like_brute_force():
    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 5, 8):
        old = [rng.integers(1, 5, rng.integers(0, 30)).astype(np.uint64) for _ in range(12)]
        new = [rng.integers(1, 5, rng.integers(0, 30)).astype(np.uint64) for _ in range(8)]
        segments = [Segment.of(old[:5], np.arange(5), m), Segment.of(old[5:8], np.arange(5, 8), m).merged(Segment.of(old[8:], np.arange(8, 12), m))]
        got = covered(Segment.of(new, np.arange(100, 108), m), segments)
        for t, r in zip(new, got.itertuples()):
            assert abs(r.share - brute_share(t, old, m)) < 1e-9
            per = [brute_share(t, [h], m) for h in old]
            assert abs(r.best_share - max(per)) < 1e-9
            assert r.best_share == 0 or abs(per[r.best] - max(per)) < 1e-9


def test_suffixes_are_sorted():
    words = [np.array([3, 1, 2, 3, 1], np.uint64), np.array([1, 2], np.uint64)]
    s = Segment.of(words, np.array([7, 9]), 4)
    tails = []
    for p in s.order:
        end = p + int(np.argmax(s.words[p:] == 0))
        tails.append(tuple(s.words[p:end][:4]))
    assert tails == sorted(tails)


def pairs(df):
    return {(r.key, r.first_row) for r in df.collect()}


def test_first_rows(spark):
    rows = [(5, 0, 3), (5, 0, 2), (5, 1, 9), (6, 1, 8), (6, 1, 10), (6, 2, 11), (None, 0, 1), (-4, 2, 12)]
    got = first_rows(spark.createDataFrame(rows, KEYS))
    assert {tuple(r) for r in got.collect()} == {(5, 0, 2), (5, 1, 2), (6, 1, 8), (6, 2, 8), (-4, 2, 12)}
    assert first_rows(spark.createDataFrame([], KEYS)).count() == 0
    hot = spark.createDataFrame([(1 if i % 3 else i, i // 50, i) for i in range(300)], KEYS)
    want = {}
    for k, _, r in [(1 if i % 3 else i, 0, i) for i in range(300)]:
        if k:
            want.setdefault(k, r)
    assert pairs(first_rows(hot, rows_per_shard=40)) == set(want.items())


def test_segments_are_merged_by_size_and_never_else_written(spark, monkeypatch):
    from postmill.llm import history as M

    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(1, 400)), b, b * 100 + i) for b in range(6) for i in range(90 if b == 0 else 12)]
    first = {}
    for k, _, r in sorted(rows, key=lambda x: x[2]):
        first.setdefault(k, r)
    for limit in (0, M.BROADCAST_KEYS):
        monkeypatch.setattr(M, "BROADCAST_KEYS", limit)
        h = History(spark, rows_per_shard=20)
        for b in range(6):
            before = h.segments[:1]
            batch = spark.createDataFrame([(k, r) for k, x, r in rows if x == b], "key bigint, row bigint")
            assert pairs(h.accept(batch)) == {(k, first[k]) for k, x, _ in rows if x == b}
            assert b == 0 or h.segments[0] is before[0]  # the large segment stays as it is
        sizes = [n for _, _, n in h.segments]
        assert sum(sizes) == len(first) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_many_batches_take_few_rounds(spark, monkeypatch):
    """Batch after batch alone, each is a round of jobs over all partitions: 60 batches took 60 rounds."""
    rounds, accept = [], History.accept
    monkeypatch.setattr(History, "accept", lambda self, batch: rounds.append(1) or accept(self, batch))
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(-300, 300)), b, b * 100 + int(rng.integers(0, 100))) for b in range(60) for _ in range(20)] + [(None, 3, 300), (7, None, 1)]
    first = {}
    for k, b, r in sorted((x for x in rows if None not in x), key=lambda x: x[1:]):
        first.setdefault(k, r)
    first.pop(0, None)
    got = first_rows(spark.createDataFrame(rows, KEYS), rows_per_shard=100).collect()
    assert {tuple(r) for r in got} == {(k, b, first[k]) for k, b, _ in rows if k in first and b is not None} and len(got) == len({(r.key, r.batch) for r in got})
    assert len(rounds) <= 6


def test_covered_rows_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        words = [str(x) for x in rng.integers(0, 6, rng.integers(0, 40))]
        if i > 20 and i % 3 == 0:
            words[5:5] = rows[i - 20][2].split()[:18]
        rows.append((i, i // 20, " ".join(words)))
    rows += [(60, 2, None), (61, 2, ""), (62, 2, "<b>" + rows[3][2].replace(" ", "<i> "))]
    got = {r.row_id: r for r in covered_rows(spark.createDataFrame(rows, "row_id bigint, batch int, text string"), 4).collect()}
    assert set(got) == set(range(20, 63))
    for i, b, t in rows[20:]:
        old = [ascii_words(x) for _, c, x in rows if c < b]
        assert abs(got[i].share - brute_share(ascii_words(t), old, 4)) < 1e-9
        assert (got[i].best_row_id is None) == (got[i].share == 0) and (got[i].best_row_id is None or got[i].best_row_id < 20 * b)
    empty = spark.createDataFrame([], "row_id bigint, batch int, text string")
    assert covered_rows(empty).count() == 0
