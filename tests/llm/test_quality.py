import numpy as np

from postmill.llm.quality import STATISTICS, ProseModels, _characters, best_limit, not_prose, parts_of, prose_distances, robust_model, text_statistics

PROSE = [
    "We are looking for a nurse who can help the team with the night shift, and you will be trained by people who have been here for years.",
    "the interview went well and they told me that the work is hard but that it pays for what it asks of you in the end",
    "Wir suchen eine Person, die sich um die Anlage kümmert und mit den anderen im Werk zusammenarbeitet, wenn es nötig ist.",
    "Nous cherchons une personne pour tenir la paie et pour aider les équipes qui doivent rester dans la ville chaque semaine.",
]
OTHER = ["- flexible hours\n- dental cover\n- a bicycle scheme\n- stock options\n" * 4, "id;role;team\n21328,scored,Tax\n34817,n/a,Nurse\n" * 5, "Quiet routing growth modular pricing queue bench shift portal hour network rebuild tune measure. " * 4, '{"id":1,"team":"x"}\n' * 9, "", None]


def test_share_of_running_text():
    share = STATISTICS.index("prose_share")
    assert all(text_statistics(p)[1][share] > 0.8 for p in PROSE)
    assert all(text_statistics(p.upper())[1][share] > 0.8 for p in PROSE)
    assert all(text_statistics(o)[1][share] < 0.2 for o in OTHER)
    assert [text_statistics(p)[0] for p in PROSE] == ["en", "en", "de", "fr"]
    assert text_statistics(None) == ("", [0.0] * len(STATISTICS))
    assert text_statistics("and " * 200_000)[1][share] < 0.5


def test_characters():
    text = "Ab1 ²!ß\u4e2d\U0001f44d É٣ \ud800"
    assert _characters(text) == (sum(not c.isalnum() and not c.isspace() for c in text), sum(c.isdigit() for c in text), sum(c.isupper() for c in text))


def test_robust_model_ignores_a_few_wrong_rows():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(200, 3)), np.full((10, 3), 50.0)]
    mean, scale, correlation = robust_model(x)
    assert np.abs(mean).max() < 0.3 and np.abs(scale - 1).max() < 0.3
    one, near = parts_of(np.array([[50.0, 0, 0], [0.5, -0.5, 0.5]]), (mean, scale, correlation)).sum(1)
    assert one > 100 > 3 > near


def test_few_rows_of_a_language_lean_on_all_languages():
    rng = np.random.default_rng(1)
    pooled = robust_model(rng.normal(size=(500, 2)))
    few, many = robust_model(rng.normal(5, 1, (4, 2)), pooled), robust_model(rng.normal(5, 1, (4000, 2)), pooled)
    assert few[0].max() < 1.5 and many[0].min() > 4.5


def test_limit_parts_the_labels_in_the_widest_gap():
    d = np.r_[np.linspace(1, 20, 50), np.linspace(400, 900, 20)]
    prose = np.arange(70) < 50
    assert 20 < best_limit(d, prose) < 400
    prose[[3, 60]] = ~prose[[3, 60]]  # wrong labels
    assert 20 < best_limit(d, prose) < 400
    assert best_limit(d, np.ones(70, bool)) == best_limit(d, np.zeros(70, bool)) > 0


def test_every_statistic_counts_in_the_decision():
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=(300, len(STATISTICS))), rng.normal(size=(60, len(STATISTICS))) + 6]
    prose = np.arange(360) < 300
    m = ProseModels(x, np.full(360, "en", object), prose)
    assert ((m.parts(x, np.full(360, "en", object)).sum(1) > m.limit) == ~prose).all()
    for j in range(len(STATISTICS)):  # far off in one statistic alone, each of them
        y = np.zeros((1, len(STATISTICS)))
        y[0, j] = 100
        assert m.parts(y, np.array(["xx"], object)).sum() > 100


def test_documents(spark):
    docs = [(i, PROSE[i % 4] + f" It is the {i}th." if i < 160 else OTHER[i % 6]) for i in range(190)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "prose" if i < 160 else "list", 1) for i in range(0, 190, 3)] + [(None, "prose", 1)], "doc_id bigint, doc_kind string, rater int")
    assert {r.doc_id for r in not_prose(df, labels).collect()} == set(range(160, 190))
    r = prose_distances(df, labels).collect()
    assert len(r) == 190 and all(abs(sum(x[f"part_{s}"] for s in STATISTICS) - x.distance) < 1e-6 * max(1, abs(x.distance)) for x in r)
    assert not_prose(df.where("false"), labels).count() == 0
    assert prose_distances(df.limit(3), labels.where("false")).where("is_outlier").count() == 3
