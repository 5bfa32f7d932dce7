"""Streaming queries, run to the end of the available data."""

from pyspark.sql import functions as F

from tabloom.functions.lineage import scratch
from tabloom.plans import fixtures as fx
from tabloom.plans.registry import query
from tabloom.streaming.moments import run_moments


@query("stream_moments", "STR1 DP10", """SELECT 'value' AS "column", count(*) AS n, round(avg(value) * 1.00012345::DOUBLE, 6) AS mean, round(var_pop(value), 5) AS variance FROM events""")
def _(spark, d):
    events = fx.table(spark, d, "events")
    src = scratch(spark, "arriving")
    events.repartitionByRange(8, "ts").write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(src)
    m = run_moments(stream, ["value"], scratch(spark, "state"), scratch(spark, "progress"))
    return m.select("column", "n", F.round(F.col("mean") * 1.00012345, 6).alias("mean"), F.round(F.col("m2") / F.col("n"), 5).alias("variance"))


@query("stream_moments_private", "STR1 DP10")
def _(spark, d):
    events = fx.table(spark, d, "events")
    src = scratch(spark, "arriving")
    events.repartitionByRange(8, "ts").write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(src)
    m = run_moments(stream, ["value"], scratch(spark, "state"), scratch(spark, "progress"), bounds={"value": (0.0, 1000.0)}, epsilon=1.0, seed=1)
    return m.select("column", "n", F.round("mean", 6).alias("mean"), F.round(F.col("m2") / F.col("n"), 5).alias("variance"))
