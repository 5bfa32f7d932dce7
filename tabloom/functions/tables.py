"""Fitted state as small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.lineage import scratch


def materialise(df: DataFrame) -> DataFrame:
    """Write a fitted or shared table once to the cluster's shared folder and read it back.

    Later plans start from the files, so they stay small, survive lost executors, and the planner
    knows the true size: it picks a broadcast join only below the session's threshold and a
    shuffled join above it.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def look_up(df: DataFrame, table: DataFrame, col: str, values: Mapping[str, str], *, missing: Mapping[str, Column] | None = None,
            extra: Sequence[str] = ()) -> DataFrame:
    """Left join `col` (and `extra` keys) to rows of a long table (column, value, ...).

    values: table column -> output column. missing: output column -> value without a match.
    """
    part = table.where(F.col("column") == col).select(
        F.col("value").alias("_lk"), *[F.col(e).alias(f"_lk_{e}") for e in extra], *[F.col(v).alias(f"_o_{o}") for v, o in values.items()])
    on = df[col].cast("string") == part["_lk"]
    for e in extra:
        on = on & (df[e] == part[f"_lk_{e}"])
    out = df.join(part, on, "left")
    missing = missing or {}
    new = {o: (F.coalesce(F.col(f"_o_{o}"), missing[o]) if o in missing else F.col(f"_o_{o}")) for o in values.values()}
    return out.withColumns(new).drop("_lk", *[f"_lk_{e}" for e in extra], *[f"_o_{o}" for o in values.values()])
