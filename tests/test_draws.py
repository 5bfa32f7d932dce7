"""Weighted draws on grids that follow the number of levels."""

import numpy as np
from pyspark.sql import functions as F

from tabloom.functions.draws import draw, interval_table
from tabloom.functions.rng import u01


def test_a_law_of_many_levels_with_a_heavy_one_meets_few_rows_in_each_cell(spark):
    levels = 100_000
    weights = spark.range(levels).select(F.col("id").alias("v"), F.when(F.col("id") == 777, 2 * levels).otherwise(F.col("id") % 5 + 1).cast("long").alias("n"))
    law = interval_table(weights, [], "v", "n").cache()
    assert law.groupBy("_cell").count().agg(F.max("count")).first()[0] < 12
    rows = spark.range(200_000)
    cells = rows.select(F.floor(u01(3, "x", "id") * 2 ** law.first()["_bits"]).alias("c")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert cells < 20  # no cell has many requests, though a third of them draw level 777
    got = {r["id"]: r["w"] for r in draw(rows, law, [], "v", u01(3, "x", "id"), "w").collect()}
    n = np.where(np.arange(levels) == 777, 2 * levels, np.arange(levels) % 5 + 1)
    u = {r["id"]: r["u"] for r in rows.select("id", u01(3, "x", "id").alias("u")).collect()}
    upto = np.cumsum(n) / n.sum()
    assert len(got) == 200_000 and all(got[i] == np.searchsorted(upto, u[i], side="right") for i in u)


def test_groups_of_any_size_and_fractional_weights_leave_no_gap(spark):
    rows = [("a", v, 0.1) for v in range(10)] + [("b", 0, 1e-300), ("b", 1, 1e300)] + [("c", v, float(v % 7)) for v in range(3000)] + [("d", 5, 0.0), (None, 1, 1.0)]
    law = interval_table(spark.createDataFrame(rows, "g string, v int, w double"), ["g"], "v", "w").cache()
    assert sorted(r[0] for r in law.select("_bits").distinct().collect()) == [6, 14]
    edges = law.select("g", "v", "_lo", "_hi").distinct().orderBy("g", "v").collect()
    for g in ("a", "b", "c"):
        part = [r for r in edges if r.g == g]
        assert part[0]._lo == 0.0 and part[-1]._hi == 1.0 and all(x._hi == y._lo for x, y in zip(part, part[1:]))
    asked = spark.range(5000).withColumn("g", F.element_at(F.array(*map(F.lit, "abcdz")), (F.col("id") % 5 + 1).cast("int")))
    got = draw(asked, law, ["g"], "v", u01(1, "y", "id"), "out").groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("out").alias("k")).collect()
    assert {r.g: r.n for r in got} == {"a": 1000, "b": 1000, "c": 1000}
    assert {r.g: r.k for r in got}["a"] == 10
