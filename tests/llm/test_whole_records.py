"""Overlaps that must not be missed."""

from peakloom.llm import overlaps
from test_records import SPEC


def test_a_peak_that_stands_twice_counts_twice(spark):
    # all three peaks must reappear, two of them have one m/z
    row = (300.0, [100.0, 100.0, 200.0], [1.0, 1.0, 1.0], "s", 1)
    train = spark.createDataFrame([(1, *row), (2, 300.0, [100.0, 150.0, 200.0], [1.0, 1.0, 1.0], "s", 1)], SPEC)
    test = spark.createDataFrame([(7, *row)], SPEC).withColumnRenamed("rid", "spectrum_id")
    assert [tuple(r)[:2] for r in overlaps.matches(train, test).collect()] == [(1, 7)]
