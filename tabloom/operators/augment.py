"""Joins, unions, quotas and relabelling around a generated table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.ordering import global_rank, running_totals
from tabloom.functions.rng import pick, u01
from tabloom.functions.tables import materialise
from tabloom.operators.encode import MAX_DENSE_LEVELS


def union_origin(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Real and generated rows in one table, told apart by `origin`."""
    return real.withColumn("origin", F.lit("real")).unionByName(synth.withColumn("origin", F.lit("synthetic")))


def combine_by_position(stored: DataFrame, other: DataFrame) -> DataFrame:
    """Union that pairs columns by position, under the stored names."""
    if len(stored.columns) != len(other.columns):
        raise ValueError("tables differ in width")
    return stored.union(other.toDF(*stored.columns))


def inject_target(features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return features.join(target, key)


def extract_target(df: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(key, target)


def relabel(df: DataFrame, predict: Callable[[DataFrame], DataFrame], target: str, key: str, *, only_synthetic: bool = True) -> DataFrame:
    """Replace the target of the generated rows (or of all rows) by `predict`, which adds a
    `prediction` column; the real rows are not sent through the model."""
    fresh = df.where("origin = 'synthetic'") if only_synthetic else df
    done = predict(fresh).select(*[c for c in df.columns if c != target], F.col("prediction").alias(target))
    return df.where("origin <> 'synthetic'").unionByName(done) if only_synthetic else done


def nearest_class(df: DataFrame, value: str, classes: DataFrame | Sequence[float], out: str) -> DataFrame:
    """Closest class to a continuous value, the larger one on ties; a null value, or any value where no class is given, gets null.

    classes: any number of values, or a table whose first column holds them; nulls and repetitions do not count.
    Distinct values and classes are ordered together by ranges, so that a value learns how many classes lie at or
    below it; the classes of this number and the next are joined, and the closer one goes back to all rows.
    """
    if not isinstance(classes, DataFrame):
        classes = df.sparkSession.createDataFrame([(float(c),) for c in classes], "c double")
    known = classes.select(F.col(classes.columns[0]).cast("double").alias("_x")).where("_x is not null").distinct()
    asked = df.select((F.col(value).cast("double") + 0.0).alias("_x")).where("_x is not null").distinct()
    both = known.select("_x", F.lit(0).alias("_kind")).unionByName(asked.select("_x", F.lit(1).alias("_kind")))
    placed = materialise(running_totals(both, ["_x", "_kind"], {"_k": (F.col("_kind") == 0).cast("long")}))
    ranked = placed.where("_kind = 0")
    low = ranked.select("_k", F.col("_x").alias("_low"))
    high = ranked.select((F.col("_k") - 1).alias("_k"), F.col("_x").alias("_high"))
    near = placed.where("_kind = 1").join(low, "_k", "left").join(high, "_k", "left")
    further = F.col("_high").isNull() | (F.col("_x") - F.col("_low") < F.col("_high") - F.col("_x"))
    near = near.select(F.col("_x").alias("_asked"), F.when(F.col("_low").isNotNull() & further, F.col("_low")).otherwise(F.col("_high")).alias("_nearest"))
    return df.join(near, (F.col(value).cast("double") + 0.0) == near["_asked"], "left").drop("_asked").withColumn(out, F.col("_nearest")).drop("_nearest")


def class_list(df: DataFrame, target: str) -> list:
    rows = df.select(target).distinct().limit(MAX_DENSE_LEVELS + 1).collect()
    if len(rows) > MAX_DENSE_LEVELS:
        raise ValueError(f"{target} has more than {MAX_DENSE_LEVELS} classes")
    return sorted(r[0] for r in rows)


def quotas(df: DataFrame, target: str, n: int, kind: str) -> DataFrame:
    """Rows to generate per class, rounding half to even.

    proportional / balanced keep the new-total form round(count + share) - count,
    share / equal round the share itself.
    """
    c = df.groupBy(target).agg(F.count("*").alias("n"))
    size = c.agg(F.struct(F.sum("n").alias("t"), F.count("*").alias("k"))).scalar()
    c = c.withColumn("z", size)
    part = F.lit(float(n)) * F.col("n") / F.col("z.t") if kind in ("proportional", "share") else F.lit(float(n)) / F.col("z.k")
    q = F.bround(F.col("n") + part) - F.col("n") if kind in ("proportional", "balanced") else F.bround(part)
    return c.select(target, "n", q.cast("long").alias("quota"))


def multiplied_quota(df: DataFrame, factor: float, keep_originals: bool) -> DataFrame:
    """Rows asked for by a multiplication factor and the size of the resulting table."""
    return df.agg(F.count("*").alias("n")).select(
        "n", F.bround(F.col("n") * factor).cast("long").alias("generated"),
        (F.bround(F.col("n") * factor) + (F.col("n") if keep_originals else 0)).cast("long").alias("total"))


def balance_gap(df: DataFrame, target: str) -> DataFrame:
    """Minority class and the rows it lacks to match the majority."""
    c = df.groupBy(target).agg(F.count("*").alias("n"))
    return c.agg(F.min_by(target, F.struct("n", target)).alias("minority"), (F.max("n") - F.min("n")).alias("missing"))


def requests(spark: SparkSession, counts: Mapping, column: str, kind: str) -> DataFrame:
    """(`row`, column): `counts[value]` rows per value, spread over the cluster."""
    values = list(counts)
    ends, total = [], 0
    for v in values:
        total += counts[v]
        ends.append(total)
    pos = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("row")))
    rows = spark.range(total).withColumnRenamed("id", "row")
    return rows.withColumn(column, F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), pos + 1))


def fill_foreign_keys(child: DataFrame, parent: DataFrame, parent_key: str, child_key: str, column: str, seed=0) -> DataFrame:
    """`column` of each child row drawn with replacement from the parent's keys."""
    p = global_rank(parent.select(F.col(parent_key).alias("_pk")), ["_pk"], rank="_r")
    n = parent.agg(F.count("*")).scalar()
    c = child.withColumn("_r", pick(u01(seed, "fk", child_key), n))
    return c.join(p, "_r").withColumn(column, F.col("_pk")).drop("_r", "_pk")


def experiment_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of the configuration axes, exploded from one row of arrays."""
    df = spark.range(1).select(*[F.lit(list(v)).alias(k) for k, v in axes.items()])
    for k in axes:
        df = df.withColumn(k, F.explode(k))
    return df


def noisy_majority(votes: DataFrame, yes: str, teachers: int, scale: float, u: Column) -> DataFrame:
    """1 where the votes plus Laplace noise exceed half of the teachers."""
    noise = -F.signum(u - 0.5) * F.log(1 - 2 * F.abs(u - 0.5)) * scale
    return votes.withColumn("label", (F.col(yes) + noise > teachers / 2).cast("int"))
