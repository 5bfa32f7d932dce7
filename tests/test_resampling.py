"""Resampling weights worked out in batches."""

from pyspark.sql import functions as F

from tabloom.functions.rng import u01
from tabloom.operators import split


def test_weights_of_one_file_are_spread_over_tasks(spark):
    df = spark.range(0, 500, 1, 1)
    got = split.bootstrap_weights(df, "id", 3)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_weights_are_those_of_the_hash_for_any_key(spark):
    rows = [(k, i, {"a": i}) for i, k in enumerate(["x", "x", None, None, "", "k" * 70, "kä", *map(str, range(60))])]
    df = spark.createDataFrame(rows, "key string, n int, m map<string,int>").repartition(2)
    got = split.poisson_weights(df, "key", 11, seed=4)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("key", "string"), ("n", "int"), ("m", "map<string,int>"), ("replicate", "int"), ("w", "int")]
    u = u01(4, "boot", "key", "replicate")
    want = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(11)))).withColumn("w", sum((u > s).cast("int") for s in split._poisson_steps()))
    pairs = lambda t: sorted((r["n"], r["key"] or "", r["m"]["a"], r["replicate"], r["w"]) for r in t.collect())
    assert pairs(got) == pairs(want) and len(pairs(got)) == 67 * 11
    assert pairs(split.bootstrap_weights(df, "key", 11, seed=4)) == [p for p in pairs(want) if p[-1]]


def test_no_rows_and_no_replicates(spark):
    assert split.poisson_weights(spark.range(0), "id", 5).count() == 0 and split.poisson_weights(spark.range(5), "id", 1).count() == 5
