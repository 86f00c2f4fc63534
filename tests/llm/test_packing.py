import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from postmill.llm.packing import first_fit_decreasing, pack, pack_texts, token_counts


@given(st.lists(st.integers(0, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    sizes = np.array(sizes, np.int64)
    bins, room, want = first_fit_decreasing(sizes, 50), [], np.empty(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable"):
        for b, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            b = len(room)
            room.append(50)
        room[b] -= sizes[i]
        want[i] = b
    assert (bins == want).all()


def test_pack(spark):
    sizes = [(i, (i * 37) % 900 + 1) for i in range(400)] + [(1000, 5000), (1001, 0), (1002, None), (1003, 2048)]
    got = pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), group_items=100).collect()
    room = {}
    for r in got:
        room[r.container] = room.get(r.container, 0) + r.n_tokens
    assert max(room.values()) <= 2048
    total = {}
    for r in got:
        total.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    for d, n in sizes:
        pieces = sorted(total[d])
        assert sum(x for _, x in pieces) == (n or 0) and (len(pieces) == 1 or n > 2048)
        assert all(a + x == b for (a, x), (b, _) in zip(pieces, pieces[1:]))
    assert sum(room.values()) / (2048 * len(room)) > 0.93


def test_texts_and_empty(spark):
    docs = spark.createDataFrame([(1, "a few words"), (2, ""), (3, None), (4, "word " * 3000)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}[2] == 0
    assert {r.doc_id for r in pack_texts(docs).collect()} == {1, 2, 3, 4}
    assert pack_texts(docs.where("doc_id < 0")).count() == 0
