"""Writers: result tables, merged score files, rank files, libsvm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, *, by: Sequence[str] = (), fmt: str = "csv") -> str:
    """Result rows as csv or parquet, one directory per value of `by`."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).format(fmt).save(path)
    return path


def collect_scores(spark: SparkSession, path: str, schema, out: str, *, single_file: bool = True) -> str:
    """Read every score file below `path`, drop repeated rows and write them to one place. One output
    file is asked for only when a person is to read it."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).schema(schema).csv(path).dropDuplicates()
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").option("header", True).csv(out)
    return out


def write_ranks(df: DataFrame, path: str, by: Sequence[str] = ("metric", "dataset")) -> str:
    df.write.mode("overwrite").partitionBy(*by).json(path)
    return path


def read_ranks(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_libsvm(df: DataFrame, path: str, target: str, positives: Sequence, features: Sequence[str]) -> str:
    """+1 / -1 labels by membership in `positives`; features are already 0/1 or scaled numbers."""
    label = F.when(F.col(target).isin(*positives), 1.0).otherwise(-1.0).alias("label")
    vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(df.withColumn("label", label))
    vec.select("label", "features").write.mode("overwrite").format("libsvm").save(path)
    return path
