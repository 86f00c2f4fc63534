import numpy as np

from postmill.llm import near
from postmill.llm.near import near_groups, near_pairs, recall, row_pairs, signatures, similarities, variants
from postmill.llm.words import ascii_runs, ascii_words

KW = {"threshold": 0.5, "shingle": 3, "min_words": 5}


def shingles(t, n=3):
    w = ascii_words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= 5 else set()


def brute(rows, least=0.5):
    out, s = set(), {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(s)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= least:
                out.add((a, b))
    return out


def test_pairs_like_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], None
    for i in range(120):
        if i % 6 == 0:
            base = list(rng.choice(vocabulary, 90))
        words = list(base)
        for _ in range(int(rng.choice([0, 1, 2, 3, 12]))):
            words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "too few words"), (203, None), (None, rows[0][1]), (204, "<b>" + rows[0][1].upper().replace(" ", "<br/>") + "</b>"), (205, "long words here again and again " * 5000), (206, "long words here again and again " * 5000)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {tuple(r) for r in row_pairs(*near_pairs(df, **KW)).collect()}
    known = [r for r in rows if r[0] is not None]
    assert brute(known, 0.6) <= got <= brute(known)  # what is found is exact; recall() tells how much is found
    groups = {r.id: r for r in near_groups(df, **KW).collect()}
    assert groups[205].group_id == groups[206].group_id == 205 and groups[204].rep == 0
    assert 202 not in groups and 200 not in groups


def test_hot_group_of_copies_and_empty_table(spark):
    text = " ".join(f"x{i}" for i in range(30))
    df = spark.createDataFrame([(i, text) for i in range(60)], "id bigint, text string")
    pairs, members = near_pairs(df, **KW)
    assert pairs.count() == 0 and {r.rep for r in members.collect()} == {0} and members.count() == 60
    empty = spark.createDataFrame([], "id bigint, text string")
    assert row_pairs(*near_pairs(empty, **KW)).count() == 0


def test_one_differing_symbol_leaves_a_variant_in_common():
    n = near.SEGMENTS * near.WIDTH
    first = np.random.default_rng(4).integers(0, 65536, n).astype(np.uint16)
    signs = [first]
    for at in range(n):
        other = first.copy()
        other[at] ^= 7
        signs.append(other)
    keys = [set(k) for k in variants(np.array(signs).reshape(n + 1, near.SEGMENTS, near.WIDTH)).tolist()]
    assert all(len(k) == n for k in keys)
    # all segments but the differing one agree in full, the differing one in the variant without that symbol
    assert all(len(keys[0] & k) == n - near.WIDTH + 1 for k in keys[1:])


def crowd(n):
    """Texts that all resemble each other, none like another: one hot group."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        words[int(rng.integers(120))] = f"own{i}"
        rows.append((i, " ".join(words)))
    return rows


def test_hot_keys_are_paired_in_blocks(spark, monkeypatch):
    rows = crowd(70)
    want = brute(rows)
    assert len(want) == 70 * 69 // 2
    for run in (7, 20, 1000):  # keys hot within a batch, hot in their group, and neither
        monkeypatch.setattr(near, "RUN", run)
        keys = variants(np.repeat(np.arange(1, near.SEGMENTS * near.WIDTH + 1, dtype=np.uint16).reshape(1, near.SEGMENTS, near.WIDTH), 3, 0))
        assert (keys == keys[0]).all()
        df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
        met = pairs_through_index(near, df, spark)
        assert met == want


def pairs_through_index(near, df, spark):
    """The index' stages run here, so that a patched RUN holds in them."""
    import pyarrow as pa

    rows = [(r.id, r.text) for r in df.collect()]
    runs, starts, known, _ = ascii_runs([t for _, t in rows], 3, 5)
    sig = signatures(runs, starts, None)
    ids = np.array([rows[k][0] for k in known])
    batches = [pa.record_batch([pa.array(ids[i : i + 25]), pa.array([x.tobytes() for x in sig[i : i + 25]], pa.binary())], ["id", "sig"]) for i in range(0, len(ids), 25)]
    index = [b for b in near._expand(5)(iter(batches))]
    out, blocks = set(), {}
    for g in range(5):
        mine = [b.filter(pa.array(b.column("grp").to_numpy() == g)) for b in index]
        for b in near._meet(5)((pa.scalar(g),), iter([b for b in mine if b.num_rows])):
            for a, c, k, x in zip(*b.to_pydict().values()):
                if x is None:
                    out.add((min(a, c), max(a, c)))
                else:
                    blocks.setdefault(k, []).append(x)
    for x in blocks.values():
        jobs = [(p, q) for i, p in enumerate(x) for q in x[i:]]
        for b in near._across(iter([pa.record_batch([pa.array([p for p, _ in jobs], pa.binary()), pa.array([q for _, q in jobs], pa.binary())], ["left", "right"])])):
            out.update(zip(*b.to_pydict().values()))
    return {p for p in out if near.similarities([dict(rows)[p[0]]], [dict(rows)[p[1]]], 3)[0] >= 0.5}


def test_recall_of_signatures_at_a_similarity():
    assert recall(0.5) > 0.9 and recall(0.6) > 0.98 and recall(0.8) > 0.99999
    # pairs of sets of similarity 0.5: 200 shingles in common, 100 more on either side
    rng = np.random.default_rng(7)
    for common, own, least in ((200, 100, 0.9), (24, 12, 0.85)):
        found = 0
        for _ in range(300):
            x = rng.integers(0, 2**63, common + 2 * own).astype(np.uint64)
            runs = np.r_[x[: common + own], x[:common], x[common + own :]]
            keys = variants(signatures(runs, np.array([0, common + own]), None))
            found += bool(set(keys[0].tolist()) & set(keys[1].tolist()))
        assert found / 300 > least - 0.04


def test_signature_is_that_of_the_set_and_weights_count():
    x = np.random.default_rng(8).integers(0, 2**64, 9000, dtype=np.uint64)
    zero = np.array([0])
    assert (signatures(x, zero, None) == signatures(np.r_[x[::-1], x], zero, None)).all()
    slow = np.ones(near.BUCKETS)
    slow[near.bucket(x[:8000])] = 1000.0
    light = signatures(x, zero, slow)
    assert (light == signatures(x[8000:], zero, None)).mean() > 0.9  # 3 % of the light ones share a bucket with a heavy one


def test_similarities_and_runs_like_brute_force():
    texts = ["a b c d e", "a b c d f", "", None, "x y", "<b>A</b> B c\u212a D e", "a b c a b c a b c"]
    for a in texts:
        for b in texts:
            p, q = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (ascii_words(a), ascii_words(b)))
            assert similarities([a, "z z z"], [b, "z z z"], 3).tolist() == [len(p & q) / max(1, len(p | q)), 1.0]
    runs, starts, known, copies = ascii_runs(texts, 3, 0)
    assert known == [0, 1, 5, 6] and np.diff(np.r_[starts, len(runs)]).tolist() == [3, 3, 3, 7]
    assert len(set(copies)) == 4
