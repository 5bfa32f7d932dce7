"""Column profiles, contingency counts and pairwise dependence."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.spec import TableSpec


def long_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), dtype: str = "string") -> DataFrame:
    """Unpivot `cols` to (column, value), so that any number of columns costs one pass."""
    typed = df.select(*keep, *[F.col(c).cast(dtype).alias(c) for c in cols])
    return typed.unpivot(list(keep), list(cols), "column", "value")


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for every category level."""
    return long_values(df, cols).groupBy("column", "value").agg(F.count("*").alias("n"))


def category_profile(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Per categorical column: size and the levels in order of falling frequency."""
    counts = level_counts(df, spec.categorical).where("value is not null")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value")))
    return counts.groupBy("column").agg(
        F.count("*").alias("size"), F.concat_ws(",", F.transform(ordered, lambda x: x["value"])).alias("levels"))


def numeric_profile(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Per numeric column: min and max, by one aggregate."""
    row = df.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in spec.numeric for n, f in (("lo", F.min), ("hi", F.max))])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_lo").alias("min"), F.col(f"{c}_hi").alias("max"))
                      for c in spec.numeric])
    return row.select(F.inline(items))


def table_profile(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Metadata of all columns: kind, size, levels, min, max."""
    cat = category_profile(df, spec).withColumn("kind", F.lit("categorical"))
    num = numeric_profile(df, spec).withColumn("kind", F.lit("continuous"))
    return cat.unionByName(num, allowMissingColumns=True)


def cardinalities(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column. The exact form dedupes (column, value) first, so it is
    one partially aggregated shuffle for all columns instead of a set per column."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return row.unpivot([], list(cols), "column", "size")
    return level_counts(df, cols).groupBy("column").agg(F.count("value").alias("size"))


def feature_domains(df: DataFrame, cols: Sequence[str], threshold: int = 10) -> DataFrame:
    """Columns with at most `threshold` distinct values are categorical and list them;
    the others report min and max. The list is collected only up to the threshold."""
    levels = level_counts(df, cols).where("value is not null")
    num = F.expr("try_cast(value as double)")
    # threshold + 1 smallest levels per column are enough: a longer list is never shown
    per = levels.groupBy("column").agg(
        F.count("*").alias("size"), F.min(num).alias("lo"), F.max(num).alias("hi"))
    small = per.where(F.col("size") <= threshold).select("column")
    listed = (levels.join(F.broadcast(small), "column").groupBy("column")
              .agg(F.concat_ws(",", F.array_sort(F.collect_list("value"))).alias("domain")))
    cat = F.col("size") <= threshold
    return per.join(listed, "column", "left").select(
        "column", "size", F.when(cat, "categorical").otherwise("continuous").alias("kind"), "domain",
        F.when(~cat, F.col("lo")).alias("min"), F.when(~cat, F.col("hi")).alias("max"))


def generalise(code: Column, level: int) -> Column:
    """Ancestor of a code `level` steps up the binary taxonomy."""
    return F.floor(code / float(2**level))


def contingency(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts for several column sets in one pass over the data (grouping sets).
    Columns outside a set are null; `cell_set` is the 0-based number of the set."""
    cols = sorted({c for s in sets for c in s})
    arms = F.array(*[
        F.struct(F.lit(i).alias("cell_set"),
                 *[(F.col(c).cast("string") if c in s else F.lit(None).cast("string")).alias(c) for c in cols])
        for i, s in enumerate(sets)])
    return (df.select(F.explode(arms).alias("x")).select("x.*")
            .groupBy("cell_set", *cols).agg(F.count("*").alias("n")))


def pair_counts(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(a, b, va, vb, n) for every pair of columns, in one partially aggregated pass."""
    pairs = list(pairs if pairs is not None else combinations(cols, 2))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("va"),
                               F.col(b).cast("string").alias("vb")) for a, b in pairs])
    return df.select(F.explode(cells).alias("x")).select("x.*").groupBy("a", "b", "va", "vb").agg(F.count("*").alias("n"))


def with_margins(pairs: DataFrame) -> DataFrame:
    """Add the margins na, nb and the table size n_all to pair counts."""
    na = pairs.groupBy("a", "b", "va").agg(F.sum("n").alias("na"))
    nb = pairs.groupBy("a", "b", "vb").agg(F.sum("n").alias("nb"))
    size = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_all"), F.count_distinct("va").alias("ra"),
                                       F.count_distinct("vb").alias("rb"))
    return (pairs.join(na, ["a", "b", "va"]).join(nb, ["a", "b", "vb"]).join(F.broadcast(size), ["a", "b"]))


def dependence(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """For each column pair: mutual information in bits, the L1 distance between the joint
    and the product of the margins (empty cells included), and bias-corrected Cramer's V.

    Empty cells need no cell grid: over them the distance adds up to one minus the
    product mass that sits on filled cells.
    """
    m = with_margins(pair_counts(df, cols, pairs))
    n = F.col("n_all").cast("double")
    p, q = F.col("n") / n, (F.col("na") / n) * (F.col("nb") / n)
    g = m.groupBy("a", "b").agg(
        F.sum(p * F.log2(p / q)).alias("mi"),
        (F.sum(F.abs(p - q)) + 1.0 - F.sum(q)).alias("distance"),
        (F.sum(p * p / q) - 1.0).alias("phi2"),
        F.max(n).alias("n_all"), F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    k, r, n1 = F.col("ra"), F.col("rb"), F.col("n_all") - 1
    phi = F.greatest(F.lit(0.0), F.col("phi2") - (k - 1) * (r - 1) / n1)
    kc, rc = k - (k - 1) * (k - 1) / n1, r - (r - 1) * (r - 1) / n1
    return g.select("a", "b", "mi", "distance", F.coalesce(F.sqrt(F.try_divide(phi, F.least(kc, rc) - 1)), F.lit(0.0)).alias("v"))


def associations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Mixed association of all column pairs: Pearson, correlation ratio, Cramer's V."""
    parts = []
    if len(spec.numeric) > 1:
        pairs = list(combinations(spec.numeric, 2))
        row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        parts.append(row.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("value"))
            for i, (a, b) in enumerate(pairs)]))))
    if spec.categorical and spec.numeric:
        parts.append(correlation_ratios(df, spec))
    if len(spec.categorical) > 1:
        parts.append(dependence(df, spec.categorical).select("a", "b", F.col("v").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlation_ratios(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Share of a numeric column's spread explained by a categorical one, square-rooted."""
    long = long_values(df, spec.categorical, keep=spec.numeric)
    per = long.groupBy("column", "value").agg(
        *[f(c).alias(f"{c}_{k}") for c in spec.numeric for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    cells = F.array(*[F.struct(F.lit(c).alias("b"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_m").alias("m"),
                               F.col(f"{c}_v").alias("v")) for c in spec.numeric])
    per = per.select(F.col("column").alias("a"), F.explode(cells).alias("x")).select("a", "x.*").where("n > 0")
    # between-group spread from group sizes and means, by one more aggregate
    centre = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    mean = per.groupBy("a", "b").agg(centre.alias("g"))
    j = per.join(F.broadcast(mean), ["a", "b"])
    dev = F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))
    return j.groupBy("a", "b").agg(
        F.coalesce(F.sqrt(F.try_divide(F.sum(dev), F.sum(dev + F.col("n") * F.col("v")))), F.lit(0.0)).alias("value"))


def class_shares(df: DataFrame, target: str) -> DataFrame:
    """(target, n, share) per class."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / df.agg(F.count("*")).scalar())
