"""Queries that give every row or keep every candidate, over small tables of their own."""

import os
import re

from postmill.llm import places as M
from postmill.llm import registry
from postmill.llm.near import recall


def test_p2_groups_has_every_posting(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    long = " ".join(words)
    rows = [(1, "a", long), (2, "a", long), (3, "a", long + " more"), (4, "short", "text"), (5, None, None), (6, "", ""), (7, "b", " ".join(words[::-1])), (8, "short", "text")]
    spark.createDataFrame(rows, "row_id bigint, title string, description string").write.parquet(f"{tmp_path}/raw_jobs.parquet")
    got = {tuple(r) for r in registry.queries()["p2_groups"](spark, str(tmp_path)).select("id", "rep", "group_id", "n_links").collect()}
    assert got == {(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 1, 1), *[(i, i, i, 0) for i in (4, 5, 6, 7, 8)]}


def test_p5_name_within_the_edits_behind_many_of_higher_cosine(spark):
    fields = "place_id bigint, city string, region_code string, region_name string, country_iso string, country_name string, also_called string"
    rows = [(1, "Brokenhaven"), *[(i + 2, "Brokfnhvaen" + x) for i, x in enumerate(("dusk", "lint", "marc", "poly", "quiz", "rhum", "stow", "tulp", "vexi", "wyrd", "zebu", "glib"))]]
    rows += [(20, "Stoveminster", "TX"), (21, "Ondrangate"), (22, "Stoveminster", "MI")]
    places = spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], fields)
    want = {"Brokfnhvaen": [1], "Stoveminster / Ondrangate": [21, 0], "Stoveminster": [0], "Ondrangaet": [21]}
    values = spark.createDataFrame([(v,) for v in want], "location string")
    for parts in (1, 7):
        assert {r.value: r.place_ids for r in M.map_places(values, places.repartition(parts)).collect()} == want


def test_p2_recall_stated_in_the_readme():
    with open(os.path.join(os.path.dirname(__file__), "..", "..", "README.md"), encoding="utf-8") as f:
        stated = re.findall(r"(0\.\d+) at (0\.\d+)", re.search(r"`recall\(\)` gives (.*)", f.read())[1])
    assert [float(at) for _, at in stated] == [0.5, 0.55, 0.6, 0.7]
    assert all(abs(recall(float(at)) - float(p)) < 10 ** -len(p[2:]) for p, at in stated)
