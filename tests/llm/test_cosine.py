import numpy as np

from postmill.llm import cosine as M
from postmill.llm.names import SMOOTH, family_grams

SYLLABLES = ["bar", "cen", "dos", "fil", "gor", "hus", "jal", "kir", "lon", "mus", "nar", "pel"]


def texts_of(rng, n):
    """Families of two words, and a quarter of them with a letter changed."""
    out = [f"{''.join(rng.choice(SYLLABLES, 3))} {''.join(rng.choice(SYLLABLES, 2))}" for _ in range(n)]
    return [t[:k] + "x" + t[k + 1 :] for t in out for k in rng.integers(0, len(t), 1) if rng.random() < 0.25] + out


def brute(weights, texts, least):
    """{(i, j): cosine} of texts, i < j, over whole vectors."""
    def vector(t):
        w = {g: c * weights.weight[M._hash(g) >> 46] for g, c in weights.grams(t).items()}
        length = sum(x * x for x in w.values()) ** 0.5
        return {g: x / length for g, x in w.items()}

    vs = [vector(t) for t in texts]
    found = {(i, j): sum(x * vs[j].get(g, 0.0) for g, x in vs[i].items()) for i in range(len(vs)) for j in range(i + 1, len(vs))}
    return {k: c for k, c in found.items() if c >= least}


def same(got, want):
    assert len(got) == len({(r.a, r.b) for r in got}) == len(want)
    assert all(abs(r.sim - want[r.a, r.b]) < 1e-9 for r in got)


def test_pairs_like_brute_force_in_chunks_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [*dict.fromkeys(texts_of(rng, 90)), "", "b", "ba", "y" * 5000, "𝒜ñø"]
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "id bigint, text string, grp string")
    for grams, least in ((family_grams, 0.4), (M.character_grams, 0.6)):
        weights = M.weighting(df, grams, smooth=SMOOTH)
        all_ = brute(weights, texts, least)
        grouped = {k: c for k, c in all_.items() if (k[1] - k[0]) % 2 == 0}
        two = {k: c for k, c in all_.items() if k[0] < 40 <= k[1]}
        assert len(all_) > len(grouped) > len(two) / 2 > 10
        plain = df.drop("grp")
        # chunks of several sizes, no common n-grams, all of them common
        for rows, common, cells in ((16_384, 512, 1 << 19), (30, 512, 700), (7, 0, 64), (50, 100_000, 1)):
            monkeypatch.setattr(M, "CHUNK_ROWS", rows)
            monkeypatch.setattr(M, "COMMON_GRAMS", common)
            monkeypatch.setattr(M, "COMMON_SHARE", 2.5 if common == 100_000 else 0.4)
            monkeypatch.setattr(M, "CELLS", cells)
            same(M.cosine_pairs(df, None, weights, least).collect(), grouped)
            if rows != 7:
                same(M.cosine_pairs(plain, None, weights, least).collect(), all_)
                same(M.cosine_pairs(plain.where("id < 40"), plain.where("id >= 40"), weights, least).collect(), two)


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, "barcen"), (2, "barcen dos")], "id bigint, text string")
    none = some.where("id > 2")
    for left, right in ((none, None), (none, none), (some, none), (none, some)):
        assert M.cosine_pairs(left, right, M.weighting(some, family_grams), 0.4).count() == 0
    assert M.cosine_pairs(none, none, M.weighting(none, family_grams), 0.4).count() == 0


def test_meetings_are_not_shuffled(spark):
    """Families of the same few syllables share n-grams in nearly every pair: what is shuffled follows the texts all the same."""
    rng = np.random.default_rng(6)
    texts = [*dict.fromkeys(texts_of(rng, 900))]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    pairs = M.cosine_pairs(df, None, M.weighting(df, family_grams, smooth=SMOOTH), 0.4)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    assert pairs.count() > 0
    assert shuffled() - before < 10 * len(texts)
