"""Projection, filtering and cleaning of feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.rng import u01
from tabloom.spec import TableSpec

# Stand-ins for a missing cell.
MISSING_CATEGORY = "empty"
MISSING_NUMBER = -9999999.0
OTHER = "OTHER"
TEXT_MARKERS = ("?", " ", "")


def split_target(df: DataFrame, spec: TableSpec, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, TableSpec]:
    """Features and target as two keyed tables; dropped columns leave their role list too."""
    spec2 = spec.with_roles(categorical=tuple(c for c in spec.categorical if c not in drop),
                            numeric=tuple(c for c in spec.numeric if c not in drop))
    return df.select(spec.key, *spec2.features), df.select(spec.key, spec.target), spec2


def markers_to_null(df: DataFrame, cols: Sequence[str], markers: Sequence[str] = TEXT_MARKERS) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*markers), F.col(c)) for c in cols})


def drop_incomplete(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Drop rows with a null (or NaN) feature or target."""
    return df.dropna(subset=[*spec.features, *([spec.target] if spec.target else [])])


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of each column, the smallest on ties.

    Counts come first, so no task holds the distinct values of a column.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), *[(F.col(c) if j == i else F.lit(None).cast(df.schema[c].dataType)).alias(c)
                                                     for j, c in enumerate(cols)]) for i, c in enumerate(cols)])
    counts = (df.select(F.explode(cells).alias("x")).select("x.*").groupBy("i", *cols).agg(F.count("*").alias("n")))
    return counts.agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull() & (F.col("i") == i), F.struct((-F.col("n")).alias("n"), F.col(c).alias("v")))).alias(c)
        for i, c in enumerate(cols)])


def impute_mode(df: DataFrame, cols: Sequence[str], fitted: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the column mode of `fitted` (by default of the table itself)."""
    row = modes(fitted if fitted is not None else df, cols).select(F.struct(*cols).alias("m")).scalar()
    return df.withColumn("_m", row).withColumns({c: F.coalesce(F.col(c), F.col(f"_m.{c}")) for c in cols}).drop("_m")


def null_to_sentinel(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumns({**{c: F.coalesce(F.col(c), F.lit(MISSING_CATEGORY)) for c in spec.categorical},
                           **{c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING_NUMBER)) for c in spec.numeric}})


def sentinel_to_null(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumns({**{c: F.nullif(F.col(c), F.lit(MISSING_CATEGORY)) for c in spec.categorical},
                           **{c: F.nullif(F.col(c), F.lit(MISSING_NUMBER)) for c in spec.numeric}})


def fill_uniform(df: DataFrame, bounds: Mapping[str, tuple[float, float]], key: str, seed) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), lo + u01(seed, f"fill-{c}", key) * (hi - lo)) for c, (lo, hi) in bounds.items()})


def clip(value: Column, lo: float, hi: float) -> Column:
    """Clip, keeping null as null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), value)))


def clip_columns(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    for c, (lo, hi) in bounds.items():
        if lo > hi:
            raise ValueError(f"{c}: lower bound above upper bound")
    return df.withColumns({c: clip(F.col(c), lo, hi) for c, (lo, hi) in bounds.items()})


def clip_to_norm(df: DataFrame, cols: Sequence[str], limit: float) -> DataFrame:
    """Shrink rows whose Euclidean length exceeds `limit` onto it."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0])))
    df = df.withColumn("_shrink", F.greatest(norm / limit, F.lit(1.0)))
    return df.withColumns({c: F.col(c) / F.col("_shrink") for c in cols}).drop("_shrink")


def column_minima(df: DataFrame, cols: Sequence[str]) -> Column:
    """Struct with the minimum of each column, sentinels left out, as one scalar subquery."""
    return df.agg(F.struct(*[F.min(F.when(F.col(c) != MISSING_NUMBER, F.col(c))).alias(c) for c in cols])).scalar()


def _shift(low: Column) -> Column:
    return F.when(low > 0, 0.0).when(low == 0, 1.0).otherwise(1.0 - low)


def log_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """ln x, ln(x + 1) or ln(x - min + 1) by the sign of the column minimum."""
    df = df.withColumn("_lo", column_minima(df, cols))
    return df.withColumns({
        c: F.when(F.col(c) == MISSING_NUMBER, F.col(c)).otherwise(F.log(F.col(c) + _shift(F.col(f"_lo.{c}")))) for c in cols
    }).drop("_lo")


def log_inverse(df: DataFrame, cols: Sequence[str], minima: Column) -> DataFrame:
    df = df.withColumn("_lo", minima)
    return df.withColumns({
        c: F.when(F.col(c) == MISSING_NUMBER, F.col(c)).otherwise(F.exp(F.col(c)) - _shift(F.col(f"_lo.{c}"))) for c in cols
    }).drop("_lo")


def restore_integers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.rint(F.col(c)).cast("long") for c in cols})


def group_rare_levels(df: DataFrame, col: str, min_count: int) -> DataFrame:
    """Levels with at most `min_count` rows become OTHER. The kept levels are few (each has
    more than `min_count` rows), but the join is left for Spark to size at run time."""
    kept = df.groupBy(col).agg(F.count("*").alias("_n")).where(F.col("_n") > min_count).select(F.col(col).alias("_level"))
    return (df.join(kept, df[col] == kept["_level"], "left")
            .withColumn(col, F.when(F.col("_level").isNotNull(), F.col(col)).when(F.col(col).isNotNull(), OTHER)).drop("_level"))


def percent_to_number(value: Column) -> Column:
    return F.regexp_replace(value, "%", "").try_cast("double")


def yes_no(value: Column) -> Column:
    return F.when(F.lower(value) == "yes", 1).when(F.lower(value) == "no", 0)


def positive_flag(value: Column) -> Column:
    return (value > 0).cast("int")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def drop_all_duplicates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep only rows that occur once; every copy of a repeated row goes."""
    return df.groupBy(*cols).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def exclude_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Drop rows whose `col` is listed; None in the list selects null."""
    plain = [v for v in values if v is not None]
    hit = F.coalesce(F.col(col).isin(*plain), F.lit(False)) if plain else F.lit(False)
    return df.where(~(hit | F.col(col).isNull())) if None in values else df.where(~hit)


def rename_levels(df: DataFrame, col: str, names: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(names), subset=[col])


def flip_sign(df: DataFrame, cols: Sequence[str], when: Column | None = None) -> DataFrame:
    """Turn smaller-is-better numbers into larger-is-better ones."""
    return df.withColumns({c: (-F.col(c) if when is None else F.when(when, -F.col(c)).otherwise(F.col(c))) for c in cols})


def positional_titles(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, TableSpec]:
    """Features renamed 0, 1, ... in order, roles renamed in step."""
    names = {c: str(i) for i, c in enumerate(spec.features)}
    out = df.select(spec.key, *[F.col(c).alias(n) for c, n in names.items()], *([spec.target] if spec.target else []))
    return out, spec.with_roles(categorical=tuple(names[c] for c in spec.categorical),
                                numeric=tuple(names[c] for c in spec.numeric))
