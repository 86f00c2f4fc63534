from postmill.llm.places import map_places, placed

PLACES = "place_id bigint, city string, region_code string, region_name string, country_iso string, country_name string, also_called string"
ROWS = [
    (1, "Saint Brisercaldedale", "TN", "Tennessee", "US", "United States", "Old Chandlery"), (2, "Stoveminster", "TX", "Texas", "US", "United States", None), (3, "Stoveminster", "MI", "Michigan", "US", "United States", None),
    (4, "Ondrangate", None, None, "IN", "India", None), (5, "Quelliniskerholt", "OR", "Oregon", "US", "United States", None), (6, "Sornaneskirück", "IN", "Indiana", "US", "United States", None), (7, None, None, None, None, None, None),
]
CASES = {
    "Saint Brisercaldedale, TN": [1], "St. Brisercaldedale": [1], "saint brisercadledale tn 37011": [1], "Old Chandlery Area": [1], "US > Tennessee > Saint Brisercaldedale": [1], "US-TN-Saint Brisercaldedale": [1],
    "Stoveminster": [0], "Stoveminster, Texas": [2], "Office - Stoveminster / MI": [3], "Ondrangate, IN": [4], "Ondrangate, India": [4], "Quelliniskerholt, OR (Hybrid)": [5], "Sornaneskirueck, Indiana": [6], "SORNANESKIRÜCK, IN": [6],
    "Stoveminster, TX / Ondrangate, India": [2, 4], "Stoveminster, TX or Ondrangate": [2, 4], "quelliniskerholt, or or Ondrangate": [4, 5], "Remote": [0], "Tennessee": [0], "India": [0], "--": [0], "Huxunharnanholt, IN": [0], "Ondrangate, TX": [0], "x" * 50_000: [0],
}


def test_cases(spark):
    places = spark.createDataFrame(ROWS, PLACES)
    values = spark.createDataFrame([(v, i) for i, v in enumerate([*CASES, None, "", "  ", "Remote"])], "location string, n int")
    assert {r.value: r.place_ids for r in map_places(values, places).collect()} == CASES
    rows = placed(values.withColumnRenamed("n", "value"), places).collect()
    assert len(rows) == len(CASES) + 4 and sum(r.place_ids is None for r in rows) == 3
    assert {r.value: r.place_ids for r in map_places(values, places.repartition(5)).collect()} == CASES


def test_empty(spark):
    assert map_places(spark.createDataFrame([], "location string"), spark.createDataFrame(ROWS, PLACES)).count() == 0
    assert map_places(spark.createDataFrame([("Ondrangate",)], "location string"), spark.createDataFrame([], PLACES)).collect()[0].place_ids == [0]
