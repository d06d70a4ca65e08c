"""Filters of bounded size."""

import numpy as np

from postworks.llm import sketch


def test_no_id_is_lost(spark, monkeypatch):
    table = spark.range(-500, 5000, 7).toDF("id")
    for most in (sketch.MOST_BITS, sketch.LEAST_BITS):  # the second one is too small, and lets more ids pass
        monkeypatch.setattr(sketch, "MOST_BITS", most)
        words = sketch.id_filter(table.repartition(5), "id")
        assert sketch.may_have(words, np.arange(-500, 5000, 7)).all()
        other = np.arange(10_000, 60_000)
        assert sketch.may_have(words, other).mean() < 0.05
    none = sketch.id_filter(table.limit(0), "id")
    assert not sketch.may_have(none, np.arange(100)).any() and len(sketch.may_have(none, np.zeros(0, np.int64))) == 0


def test_rows_that_surely_are_not_in(spark):
    rows = spark.createDataFrame([(None, "n"), (0, "z"), *[(i, f"t{i}") for i in range(1, 300)]], "id long, text string").repartition(3)
    for inside in (range(0, 300, 10), range(1, 300, 10)):
        words = sketch.id_filter(spark.createDataFrame([(i,) for i in inside], "id long"), "id")
        may, none = ({r.id for r in sketch.maybe_in(rows, "id", words, wanted).collect()} for wanted in (True, False))
        assert set(inside) <= may and len(may) < 60
        assert not may & none and may | none == {None, *range(300)}
