import itertools

import numpy as np

from postmill.llm.names import Trades, average_linkage, link_names, name_words

FAMILIES = ["Dasfolbur Lemon", "Ponrurdar Danhu", "Kirselgis Cinkan", "Hubonfe Filka", "Zojinfi Tirdas", "Lolmuscen Vorhal"]
VARIANTS = ["Dasfolbur & Lemon Dental", "Dasfolbur Lemon Dental Inc.", "DASFOLBUR LEMON DENTAL", "Dental, Dasfolbur Lemon", "Dasfolbúr Lemon Dental", "Dasfolbur L. Dental", "Dasfolburlemon Dental", "Dasfolbru Lemon Dental", "Dasfolbur Lemon Dntl", "The Dasfolbur Lemon Dental (Careers)", "Dasfolbur Lemon Dental | Jobs"]
ALONE = ["Kirselgis", "careers.kirselgiscinkan.example"]


def test_variants_are_linked_and_trades_kept_apart(spark):
    names = [f"{f} {t}" for f in FAMILIES[1:] for t in ("Dental", "Networks", "Foods") if not f.startswith("Kirselgis")] + ["Kirselgis Cinkan Networks", "Dasfolbur Lemon Networks"]
    df = spark.createDataFrame([(n,) for n in [*names, *VARIANTS, *VARIANTS, *ALONE, None, "", "  ", "y" * 20_000]], "name string")
    rows = link_names(df).collect()
    org = {r.name: r.org for r in rows}
    assert len(rows) == len(org) == len({*names, *VARIANTS, *ALONE}) + 1
    assert len({org[v] for v in VARIANTS}) == 1
    assert len({org["Kirselgis Cinkan Networks"], *[org[a] for a in ALONE]}) == 1
    assert len({org[n] for n in [*names, VARIANTS[0]]}) == len(names) + 1


def test_empty(spark):
    assert link_names(spark.createDataFrame([], "name string")).count() == 0


def brute_linkage(n, sims, threshold):
    groups = [{i} for i in range(n)]
    while True:
        best = max(((sum(sims.get((min(a, b), max(a, b)), 0) for a in x for b in y) / len(x) / len(y), -min(min(x), min(y)), -max(min(x), min(y)), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2)), default=None)
        if best is None or best[0] < threshold:
            return {frozenset(g) for g in groups}
        groups[best[3]] |= groups.pop(best[4])


def test_average_linkage_like_brute_force(spark):
    rng = np.random.default_rng(3)
    sims = {(a, b): float(rng.random()) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.5}
    nodes = spark.createDataFrame([(i,) for i in range(14)], "form bigint")
    edges = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a bigint, b bigint, sim double")
    got = {}
    for r in average_linkage(nodes, edges, 0.4).collect():
        got.setdefault(r.grp, set()).add(r.form)
    assert {frozenset(g) for g in got.values()} == brute_linkage(14, sims, 0.4)


def test_words_and_trades():
    assert name_words("Acme & Sons Foods, L.L.C.")[0] == ["acme", "sons", "foods"]
    assert name_words("www.acme-sons.example") == (["acme sons".replace(" ", "")], True, False)
    t = Trades({"engineering": 20, "energy": 20, "networks": 15, "ntwks": 5, "services": 9})
    assert t.full == ["energy", "engineering", "networks", "services"]
    assert [t.of(w) for w in ("engrg", "nrg", "ntwks", "svcs", "enigneering", "acme")] == ["engineering", "energy", "networks", "services", "engineering", None]
