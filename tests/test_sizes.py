"""Plans that do not grow with the number of folds, and hashes compared as text."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.functions.rng import above, digest_text, u01
from tabloom.operators import split


@pytest.mark.parametrize("sizes, k", [((5, 9, 3), 4), ((1, 1, 30), 7), ((2, 0, 2), 50), ((16, 16, 16), 8), ((7, 5, 6), 6)])
def test_stratified_folds_own_every_kth_position(spark, sizes, k):
    rows = [(100 * c + i, "abc"[c]) for c, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y string")
    got = {r["id"]: r["fold"] for r in split.stratified_k_folds(df, "id", "y", k).collect()}
    want = Counter((y, p % k) for p, (_, y) in enumerate(rows))
    assert Counter((y, got[i]) for i, y in rows) == want
    for y in "abc":
        folds = [got[i] for i, z in rows if z == y]
        assert folds == sorted(folds)


def test_many_chunks_need_no_longer_plan(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    few, many = (split.equal_chunks(df, "id", chunk, "y") for chunk in (1000, 10))
    length = [len(x._jdf.queryExecution().analyzed().toString()) for x in (few, many)]
    assert length[1] < 1.1 * length[0]
    assert [r["n"] for r in many.groupBy("fold").agg(F.count("*").alias("n")).select("n").distinct().collect()] == [10]


def test_text_comparison_is_that_of_the_uniform(spark):
    df = spark.range(2000).withColumn("u", u01(0, "boot", "id")).withColumn("d", F.md5(digest_text(0, "boot", "id")))
    steps = [*split._poisson_steps(), 0.0, *[r["u"] for r in df.limit(20).collect()]]
    assert df.where(F.array(*[above(F.col("d"), s) for s in steps]) != F.array(*[F.col("u") > s for s in steps])).count() == 0


def test_weights_are_those_of_the_uniform_with_keys_missing(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    u = u01(0, "boot", "id", "replicate")
    w = sum(((u > s).cast("int") for s in split._poisson_steps()), F.lit(0))
    out = split.poisson_weights(df, "id", 30)
    assert out.count() == 90 and out.where(F.col("w") != w).count() == 0
