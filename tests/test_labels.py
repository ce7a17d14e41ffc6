import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels


def test_labelled_dimensions(values):
    got = values([("Counter HEIGHT: 1100 mm, depth 60cm; THK 18; height 5 m",), ("WIDTH = 2,4 m",), ("nothing",), (None,)], "s string", labels.labelled_dimensions(F.col("s")))
    assert [tuple(r) for r in got] == [(0.6, 1.1, None), (None, None, 2.4), (None, None, None), (None, None, None)]


def test_fill_dimensions(spark):
    df = spark.sql("select named_struct('depth_m', 0.0D, 'height_m', 2.0D, 'length_m', cast(null as double)) as m, 'HEIGHT 9 m DEPTH 300 LENGTH 4m' as t")
    assert tuple(df.select(labels.fill_dimensions(F.col("m"), F.col("t"))).first()[0]) == (0.3, 2.0, 4.0)


CASES = [
    ("Quotation.xlsx", ["x"], [["Ref", "1"], ["VENUE", None, "Kite Beach"]], ("Kite Beach", "high")),
    ("Quotation.xlsx", ["Location: AL BARSHA   Date: 1"], [], ("Al Barsha", "high")),
    ("Stage at zabeel park.pdf", [], [], ("Zabeel Park", "medium")),
    ("School Fair @ Knowledge Village - 15-11-2024.xlsx", [], [], ("Knowledge Village", "medium")),
    ("q.pdf", ["Play area - sunset mall"], [], ("Sunset Mall", "low")),
    ("q.pdf", ["Venue: 12"], [["venue", "5"]], ("Venue Unspecified", "none")),
    ("q.pdf", None, None, ("Venue Unspecified", "none")),
]


@pytest.mark.parametrize("name, texts, rows, expected", CASES)
def test_document_venue(spark, name, texts, rows, expected):
    df = spark.createDataFrame([(name, texts, rows)], "f string, t array<string>, r array<array<string>>")
    got = df.select(labels.document_venue(F.col("f"), F.col("t"), F.col("r"), ["Zabeel Park"])).first()[0]
    assert tuple(got) == expected
