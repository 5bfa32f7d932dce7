import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.augment import nearest_class


def brute(x, classes):
    return min(classes, key=lambda c: (abs(c - x), -c))


@pytest.mark.parametrize("many", [1, 3, 10_000])
def test_nearest_class_matches_brute_force(spark, many):
    rng = np.random.default_rng(many)
    classes = np.unique(np.round(rng.uniform(-500, 500, many), 1)).tolist()
    x = np.round(rng.uniform(-510, 510, 900), 2)
    x[::3] = x[0]  # a third of all rows are equal
    x[1::5] = rng.choice(classes, len(x[1::5]))
    x[2::50] = (classes[0] + classes[min(1, len(classes) - 1)]) / 2  # half way
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double").repartition(6)
    table = spark.createDataFrame([(c,) for c in [*classes, classes[0], None]], "c double")
    got = {r["id"]: r["cls"] for r in nearest_class(df, "v", table, "cls").collect()}
    ends = np.searchsorted(classes, x)
    assert got == {i: brute(v, classes[max(0, e - 2):e + 2]) for i, (v, e) in enumerate(zip(x.tolist(), ends.tolist(), strict=True))}


def test_odd_values(spark):
    df = spark.createDataFrame([(1, None), (2, -0.0), (3, 2.0)], "_k long, v double")
    got = {r["_k"]: r["c"] for r in nearest_class(df, "v", [0.0, 4.0], "c").collect()}
    assert got == {1: None, 2: 0.0, 3: 4.0}
    assert nearest_class(df, "v", [], "c").where(F.col("c").isNotNull()).count() == 0
    assert nearest_class(df.limit(0), "v", [1.0], "c").columns == ["_k", "v", "c"]
