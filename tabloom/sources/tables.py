"""Readers: delimited tables, run directories, multi-table datasets."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from tabloom.functions.ordering import global_rank

# Declared field types of the dataset metadata.
FIELD_TYPES = {"id": LongType(), "integer": LongType(), "float": DoubleType(), "numerical": DoubleType(), "categorical": StringType(),
               "boolean": BooleanType(), "datetime": TimestampNTZType()}


def read_delimited(spark: SparkSession, path: str, schema, *, sep: str = ",", header: bool = True, missing: str | None = None) -> DataFrame:
    """Comma, semicolon, tab or space separated text with an explicit schema (no inference pass)."""
    opts = {"sep": sep, "header": header, "nullValue": missing} if missing is not None else {"sep": sep, "header": header}
    return spark.read.options(**opts).schema(schema).csv(path)


def read_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """All run files below a directory, with the file they came from in `path`."""
    return (spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema(schema).csv(path)
            .withColumn("path", F.col("_metadata.file_path")))


def attach_labels(parts: Sequence[DataFrame], labels: DataFrame, key: str) -> DataFrame:
    """Union of file parts joined to a separate label table by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(labels, key)


def cap_columns(columns: Sequence[str], n: int | None) -> list[str]:
    return list(columns) if n is None else list(columns)[:n]


def cap_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """First n rows in key order; n may be large, so rows are ranked by ranges and filtered."""
    return global_rank(df, [key], rank="_r").where(F.col("_r") <= n).drop("_r")


def read_dataset(spark: SparkSession, metadata: str, base: str, *, max_columns: int | None = None) -> dict[str, DataFrame]:
    """Tables of a dataset described by JSON metadata: {"tables": {name: {"path", "fields": {field: {"type"}}}}}.
    Only declared fields are read."""
    tables = {}
    for name, t in json.loads(metadata)["tables"].items():
        fields = {f: t["fields"][f] for f in cap_columns(list(t["fields"]), max_columns)}
        schema = StructType([StructField(f, FIELD_TYPES[spec["type"]]) for f, spec in t["fields"].items()])
        tables[name] = spark.read.option("header", True).schema(schema).csv(f"{base}/{t['path']}").select(*fields)
    return tables


def foreign_keys(metadata: str) -> list[tuple[str, str, str, str]]:
    """(child table, child field, parent table, parent field)."""
    out = []
    for name, t in json.loads(metadata)["tables"].items():
        out += [(name, f, s["ref"]["table"], s["ref"]["field"]) for f, s in t["fields"].items() if "ref" in s]
    return out


RUN_NAME = r"([A-Za-z0-9-]+)_(\d{8})_(\d{6})_([0-9-]+)(?:_([A-Za-z0-9]+))?"


def parse_run(path: Column) -> dict[str, Column]:
    """Parts of a run directory name base_YYYYMMDD_HHMMSS_seeds[_suffix]; seeds are joined by '-'."""
    part = lambda i: F.nullif(F.regexp_extract(path, RUN_NAME, i), F.lit(""))
    return {"base": part(1), "day": part(2), "time": part(3), "seeds": F.split(part(4), "-"), "suffix": part(5)}


def group_runs(df: DataFrame, path: str = "path", *, by_suffix: bool = False) -> DataFrame:
    """One row per run base (and suffix): number of runs and sorted distinct seeds."""
    p = parse_run(F.col(path))
    rows = df.select(F.regexp_extract(path, RUN_NAME, 0).alias("run"), *[c.alias(k) for k, c in p.items()]).where("run <> ''").distinct()
    keys = ["base", "suffix"] if by_suffix else ["base"]
    seeds = rows.select(*keys, "run", F.explode(F.col("seeds").cast("array<int>")).alias("seed")).groupBy(*keys, "seed").agg(F.count_distinct("run").alias("_k"))
    runs = rows.groupBy(*keys).agg(F.count_distinct("run").alias("runs"))
    listed = seeds.groupBy(*keys).agg(F.array_sort(F.collect_list("seed")).alias("seeds"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = on[0] if len(on) == 1 else on[0] & on[1]
    return runs.alias("a").join(listed.alias("b"), cond).select(*[F.col(f"a.{k}").alias(k) for k in keys], "runs", "seeds")
