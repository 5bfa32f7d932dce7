"""The draws of a copula start from written uniforms, so that their plan can be compiled."""

from tabloom.operators import generate
from tabloom.spec import TableSpec


def test_draws_do_not_hash_again(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], float(i % 17), float(i % 5), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, c string, d string, v double, w double, y int")
    made = generate.fit_copula(df, TableSpec("id", ("c", "d"), ("v", "w"), "y", "binary"), knots=50).sample(spark, 300, seed=2)
    assert "md5" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 300 and made.columns == ["row", "c", "d", "y", "v", "w"]
