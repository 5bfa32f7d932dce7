import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import noise


@pytest.mark.parametrize("epsilon,sensitivity", [(0.25, 1), (1.0, 1), (3.0, 2)])
def test_geometric_noise_has_its_law(spark, epsilon, sensitivity):
    """Over an even grid of u, level k comes up as often as its probability says, to one grid point on either side."""
    size = 40_000
    u = (F.col("id") + 0.5) / size
    rows = spark.range(size).select(noise.geometric(F.lit(7), u, epsilon, sensitivity).alias("k"), u.alias("u"))
    got = {r["k"] - 7: r["n"] for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    q = np.exp(-epsilon / sensitivity)
    law = {k: (1 - q) / (1 + q) * q ** abs(k) for k in range(-60, 61)}
    assert all(abs(got.get(k, 0) - size * p) <= 1.001 for k, p in law.items())
    assert sum(got.values()) == size
    falling = rows.select(F.corr("u", "k")).first()[0]
    assert falling > 0.5  # larger u, larger draw


def test_geometric_noise_takes_columns(spark):
    rows = spark.createDataFrame([(10, 0.5, 1.0), (10, 0.999, 1.0), (10, 0.999, 50.0)], "n long, u double, s double")
    got = [r[0] for r in rows.select(noise.geometric(F.col("n"), F.col("u"), 1.0, F.col("s"))).collect()]
    assert got[0] == 10 < got[1] < got[2]
    assert rows.select(noise.geometric(F.col("n"), F.col("u"), float("inf"))).first()[0] == 10
