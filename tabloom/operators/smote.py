"""Oversampling by interpolation between a row and one of its nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.ordering import global_rank
from tabloom.functions.rng import pick, u01
from tabloom.operators.augment import quotas, requests
from tabloom.operators.knn import nearest

PROPORTIONAL, BALANCED = "proportional", "balanced"


def interpolate(df: DataFrame, wanted: DataFrame, *, key: str, vec: str, by: str | None, k: int, seed, rounded: Sequence[int] = ()) -> DataFrame:
    """One synthetic vector per row of `wanted` (row, class): a random row of the class, one
    of its k nearest rows of the class, and a random point between them.

    rounded: 0-based positions of coded categories, rounded after interpolation.
    """
    base = df.select(key, *([by] if by else []), vec)
    near = nearest(base, base, k, key=key, vec=vec, by=by, exclude_self=True)
    keys = [by] if by else []
    ranked = global_rank(base, [key], by=keys, rank="_r", total="_n")
    sizes = base.groupBy(*keys).agg(F.count("*").alias("_size")) if by else None
    ask = wanted.join(F.broadcast(sizes), by) if by else wanted.withColumn("_size", base.agg(F.count("*")).scalar())
    ask = ask.withColumn("_r", pick(u01(seed, "base", "row"), F.col("_size"))).drop("_size")
    got = ask.join(ranked.drop("_n"), [*keys, "_r"]).join(near, key)
    got = got.withColumn("_nb", F.element_at("neighbours", pick(u01(seed, "near", "row"), F.size("neighbours")).cast("int"))["id"])
    other = base.select(F.col(key).alias("_nb"), F.col(vec).alias("_other"))
    got = got.join(other, "_nb").withColumn("_gap", u01(seed, "gap", "row"))
    mixed = F.zip_with(vec, "_other", lambda a, b: a + F.col("_gap") * (b - a))
    if rounded:
        mixed = F.transform(mixed, lambda x, i: F.when(i.isin(*rounded), F.rint(x)).otherwise(x))
    return got.select("row", *keys, mixed.alias(vec))


def smote(df: DataFrame, n: int, *, key: str = "id", vec: str = "vec", target: str = "label", kind: str = PROPORTIONAL, k: int = 5, seed=0,
          rounded: Sequence[int] = ()) -> DataFrame:
    """About n synthetic rows with class quotas in proportion or balanced."""
    counts = {r[target]: r["quota"] for r in quotas(df, target, n, kind).orderBy(target).collect()}  # one row per class
    ask = requests(df.sparkSession, counts, target, df.schema[target].dataType.simpleString())
    return interpolate(df, ask, key=key, vec=vec, by=target, k=k, seed=seed, rounded=rounded)


def smote_unlabelled(df: DataFrame, n: int, *, key: str = "id", vec: str = "vec", k: int = 5, seed=0) -> DataFrame:
    """The whole table as one class."""
    ask = df.sparkSession.range(n).withColumnRenamed("id", "row")
    return interpolate(df, ask, key=key, vec=vec, by=None, k=k, seed=seed)
