import pytest

from ledgerloom.llm import venues as V
from ledgerloom.llm.venue_queries import p3_found, p3_unmatched

LIST = [(1, "Legria School", None, "Wiadar", "Soske"), (2, "Old Zapijund Village", "OZV", "Thekax", "Soske"), (3, "Dunonaux Mall", "DUM", "Lothi", "Soske"), (4, "Dunonaux Nursery", None, "Gosia", "Soske"), (5, "School of Tamoriax", None, "Gosia", "Trevart"), (6, "Brepla Point Sports City", None, "Gosia", "Trevart"), (7, "Royal Siakle Convention Centre", "RSCC", None, None)]
SCHEMA = "venue_id bigint, venue_name string, short_name string, area string, city string"
CASES = {
    "legria school": 1, "LEGRIA SKOOL": 1, "Legira School": 1, "School - Legria": 1, "School at Legria (tbc)": 1, "Legria": 1, "LegriaSchool": 1, "Légria School": 1, "near Legria School entrance": 1, "Gate 2 @ Legria School": 1, "Trevart / Legria School": 1, "Legria Mall": 0,
    "O.Z.V.": 2, "ozv hall 3": 2, "Old Zpjnd Village": 2, "Old_Zapijund_Vlg": 2, "Old Zapijund Village, Thekax": 2, "Dunonaux": 0, "Dunonaux Mal": 3, "Dunonaux Nursary": 4, "Tamoriax School": 5, "Sch. of Tarnoriax": 5, "SchoolofTamoriax": 5, "Brelpa Point SC": 6,
    "Royal Siakle Conv. Ctr": 7, "N/A": 0, "???": 0, "warehouse 12 road 9": 0, "x" * 5000: 0,
}


@pytest.fixture(scope="module")
def mapped(spark):
    values = spark.createDataFrame([(k,) for k in CASES], "value string")
    return {r["value"]: r["venue_id"] for r in V.map_values(spark, values, spark.createDataFrame(LIST, SCHEMA)).collect()}


@pytest.mark.parametrize("value", list(CASES))
def test_cases(mapped, value):
    assert mapped[value] == CASES[value]


def test_pigeonhole_finds_what_brute_force_finds(spark):
    import random

    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(40)]

    def edit(s):
        i = rng.randrange(len(s))
        return rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abc") + s[i:], s[:i] + rng.choice("abc") + s[i + 1 :]])

    typed = {edit(edit(n)) if rng.random() < 0.5 else edit(n) for n in names for _ in range(4)} - {""}
    listed = [(i, n, [], 2 if len(n) > 8 else 1 if len(n) > 5 else 0) for i, n in enumerate(names)]
    a = spark.createDataFrame(listed, "venue_id bigint, s string, places array<string>, k int")
    t = spark.createDataFrame([(x, x, []) for x in typed], "value string, s string, places array<string>")
    got = {(r["value"], r["venue_id"], r["distance"]) for r in V.pigeonhole_pairs(spark, t, a).collect()}

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    assert got == {(x, i, lev(x, n)) for x in typed for i, n, _, k in listed if lev(x, n) <= k}


def test_empty_list_and_no_values(spark):
    values = spark.createDataFrame([("Legria School",)], "value string")
    empty = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in V.map_values(spark, values, empty).collect()] == [("Legria School", 0)]
    assert V.map_values(spark, values.limit(0), empty).count() == 0


def test_found_has_one_row_per_record(spark, data):
    got = p3_found(spark, data)
    assert got.columns == ["table_name", "row_id", "venue_id"] and got.count() == got.select("table_name", "row_id").distinct().count() > 0
    assert p3_unmatched(spark, data).count() > 0
