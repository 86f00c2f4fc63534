import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm import leaks
from postmill.llm.leaks import Patterns, leaked_items


def brute(docs, items, m):
    runs = lambda w: {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    return {(d, i) for d, x in docs for i, y in items if runs(x) & runs(y)}


@settings(max_examples=60)
@given(st.lists(st.text("abc", max_size=30), max_size=5), st.lists(st.text("abc", max_size=20), max_size=5), st.integers(2, 5))
def test_search_like_brute_force(docs, items, m):
    docs, items = list(enumerate(map(list, docs))), list(enumerate(map(list, items)))
    p = Patterns([x for x in items if len(x[1]) >= m], m)
    coded = [np.array([p.vocabulary.get(w, 0) for w in d], np.int64) for _, d in docs]
    ends = np.cumsum([len(c) for c in coded]).astype(np.int64) if coded else np.empty(0, np.int64)
    starts = ends - np.array([len(c) for c in coded], np.int64)
    d, i = p.search(np.concatenate(coded) if coded else np.empty(0, np.int64), np.arange(len(docs)), ends, starts)
    assert set(zip(d.tolist(), i.tolist())) == brute(docs, items, m)


def test_leaks(spark, monkeypatch):
    passage = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn"
    docs = [(1, f"<p>Vorher</p> {passage.upper()}, danach"), (2, "eins zwei drei vier fünf sechs sieben acht neun zehn elf und zwölf dreizehn"), (3, None), (4, ""), (5, "x " * 50_000 + passage.replace(" ", "<br>") + " y"), (1, passage), (None, passage)]
    items = [(7, passage), (8, "too short"), (9, None), (7, passage), (10, "ganz " + passage)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    want = {(1, 7), (1, 10), (5, 7), (5, 10)}
    assert {tuple(r) for r in leaked_items(d, i).collect()} == want
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 14)
    assert {tuple(r) for r in leaked_items(d, i).collect()} == want
    assert leaked_items(d, i.where("false")).count() == 0 and leaked_items(d.where("false"), i).count() == 0
