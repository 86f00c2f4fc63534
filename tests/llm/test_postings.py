import random

from postmill.llm.postings import accepted_before

ROWS = "row_id bigint, batch_no int, global_id string, requisition_id string, company string, location string"
PLACES = "place_id bigint, city string, region_code string, region_name string, country_iso string, country_name string, also_called string"


def test_keys_chains_and_nulls(spark):
    places = spark.createDataFrame([(1, "Longbridgeton", "OH", "Ohio", "US", "United States", None), (2, "Westermarsh", "TX", "Texas", "US", "United States", "Old Foundry")], PLACES)
    rows = [
        (0, 0, "src:1", "R-10", "Barfen Lolkar Dental", "Longbridgeton, OH"),
        (1, 0, "SRC : 1.0", None, None, None),
        (2, 1, "src:2", "r10", "Barfen & Lolkar Dental Inc.", "longbridgeton oh"),
        (3, 1, "src/2", "R-99", "Other Thing Foods", "Westermarsh, TX"),
        (4, 2, "src:4", "R-99", "Other Thing Foods", "Old Foundry Area"),
        (5, 2, "src:5", "R-10", "Barfen Lolkar Dental", "Westermarsh, TX"),
        (6, 2, "src:6", "R-10", "Barfen Lolkar Foods", "Longbridgeton, OH"),
        (7, 2, None, None, "", ""),
        (8, 3, None, None, "", ""),
        (9, 3, "src:9", "R-10", "Barfen Lolkar Dental", "Longbridgeton, OH / Westermarsh, TX"),
    ]
    df = spark.createDataFrame(rows, ROWS)
    names = df.select(df.company.alias("name")).unionAll(spark.createDataFrame([(f"{a} {b} {t}",) for a in ("Zinlonti", "Hushulpo", "Gunturzel") for b in ("Kanlas", "Rilbur") for t in ("Dental", "Foods")], "name string"))
    got = {tuple(r) for r in accepted_before(df, names, places).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4)}


def test_empty(spark):
    empty = spark.createDataFrame([], ROWS)
    assert accepted_before(empty, empty.selectExpr("company as name"), spark.createDataFrame([], PLACES)).count() == 0


def test_work_follows_the_rows(spark):
    """Names and places of the same few syllables resemble each other in nearly every pair: what is shuffled follows the rows all the same."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice(["bar", "cen", "dos", "fil", "gor", "hus", "jal", "kir"]) for _ in range(n))
    cities = sorted({word(4) for _ in range(120)})
    places = spark.createDataFrame([(i + 1, c, None, None, "IN", "India", None) for i, c in enumerate(cities)], PLACES)
    rows = []
    for i in range(1500):
        city = cities[i % len(cities)]
        k = 1 + i // len(cities) % (len(city) - 2)
        rows.append((i, i % 2, f"src:{i}", f"R-{i}", f"{word(3)} {word(2)} {rng.choice(['Dental', 'Foods'])}", city[:k] + "x" + city[k + 1 :]))
    rows.append((1500, 2, "src:again", "r 7", rows[7][4].upper(), cities[7]))
    df = spark.createDataFrame(rows, ROWS)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = shuffled()
    got = {tuple(r) for r in accepted_before(df, df.selectExpr("company as name"), places).collect()}
    assert (7, 1500) in got
    assert max(n for k, n in shuffled().items() if k not in before) < 40 * len(rows)  # pairs above the cosine are rows, others aren't
