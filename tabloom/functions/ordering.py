"""Global ranks, running totals and exact quantiles without a one-task sort.

A window without `partitionBy` sends all rows to one task, and a window over a
hot key does the same for that key. Here rows are cut into key ranges of about
equal size: the range bounds come from a hash sample of the ordering key, every
range is ordered by its own task, and small per-range totals give the offsets.
Ranges are taken over (by..., order...), so a hot group is spread over many.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.tables import materialise

STRIDE = 32
SAMPLE_PER_RANGE = 16
MAX_RANGES = 4096


def range_count(spark: SparkSession) -> int:
    """Ranges per ordering: follows the session's shuffle width, within fixed limits."""
    return max(4, min(MAX_RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_range(df: DataFrame, order: Sequence[str], name: str = "_range") -> DataFrame:
    """Add the 0-based range number of each row under the ordering `order`."""
    n = range_count(df.sparkSession)
    key = F.struct(*[F.col(c) for c in order])
    sample = (
        df.select(key.alias("k"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(n * SAMPLE_PER_RANGE)
        .agg(F.array_sort(F.collect_list("k")).alias("s"))
    )
    cuts = sample.select(
        F.when(
            F.size("s") > 0,
            F.transform(
                F.sequence(F.lit(1), F.lit(n - 1)),
                lambda i: F.element_at("s", F.greatest(F.lit(1), F.floor(i * F.size("s") / n).cast("int"))),
            ),
        ).alias("cuts")
    ).select(
        F.struct(
            "cuts",
            F.transform(F.sequence(F.lit(STRIDE), F.lit(max(n, STRIDE)), F.lit(STRIDE)),
                        lambda i: F.try_element_at("cuts", i)).alias("coarse"),
        )
    )
    df = df.withColumn("_cuts", cuts.scalar()).withColumn("_key", key)
    df = df.withColumn(
        "_c", F.coalesce(F.size(F.filter(F.col("_cuts.coarse"), lambda x: x.isNotNull() & (x <= F.col("_key")))), F.lit(0)) * STRIDE
    )
    fine = F.size(F.filter(F.slice(F.col("_cuts.cuts"), F.col("_c") + 1, STRIDE), lambda x: x <= F.col("_key")))
    return df.withColumn(name, F.coalesce(F.col("_c") + fine, F.lit(0))).drop("_cuts", "_key", "_c")


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    *,
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    uniform: Column | None = None,
) -> DataFrame:
    """Inclusive running sums of `sums` inside each `by` group in the order of `order`.

    totals: sum name -> new column with the group total.
    lead: new column -> source column, value of the source in the following row.
    uniform: a (0, 1) column that leads `order`; its ranges need no sampling.
    """
    totals, lead, by = dict(totals or {}), dict(lead or {}), list(by)
    df = df.withColumns({f"_v_{k}": v for k, v in sums.items()})
    if uniform is None:
        df = with_range(df, [*by, *order])
    else:
        df = df.withColumn("_range", F.floor(uniform * range_count(df.sparkSession)))
    first = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                           *[F.col(s).alias(f"l{i}") for i, s in enumerate(lead.values())]))
    stats = df.groupBy(*by, "_range").agg(
        *[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums], first.alias("_first"))
    group = [F.col(c) for c in by] or [F.lit(0)]
    w = Window.partitionBy(*group).orderBy("_range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*group)
    offsets = stats.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.col("_range").alias("_rng"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums],
        *[F.sum(f"_s_{k}").over(everything).alias(t) for k, t in totals.items()],
        *([F.lead("_first").over(w).alias("_next")] if lead else []),
    )
    local = Window.partitionBy(*by, "_range").orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(
        "*",
        *[F.sum(f"_v_{k}").over(upto).alias(f"_run_{k}") for k in sums],
        *[F.lead(s).over(local).alias(f"_lead_{n}") for n, s in lead.items()],
    )
    on = rows["_range"] == offsets["_rng"]
    for i, c in enumerate(by):
        on = on & rows[c].eqNullSafe(offsets[f"_by{i}"])
    out = rows.join(offsets, on)
    out = out.withColumns({
        **{k: F.col(f"_run_{k}") + F.col(f"_off_{k}") for k in sums},
        **{n: F.coalesce(F.col(f"_lead_{n}"), F.col(f"_next.l{i}")) for i, n in enumerate(lead)},
    })
    keep = [c for c in df.columns if not c.startswith("_v_") and c != "_range" and c not in sums]
    return out.select(*keep, *sums, *totals.values(), *lead)


def global_rank(df: DataFrame, order: Sequence[str], *, by: Sequence[str] = (), rank: str = "rank",
                total: str | None = None, uniform: Column | None = None) -> DataFrame:
    """1-based row number in the order of `order` inside `by`; exact and without ties
    when `order` ends in the row key."""
    return running_totals(df, order, {rank: F.lit(1).cast("long")}, by=by,
                          totals={rank: total} if total else None, uniform=uniform)


def value_counts(df: DataFrame, value: str, *, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Distinct values with cumulative count `cum` and group size `total`. The counts are written once, so that the
    table behind them is read once for the bounds, the totals and the order together."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("n")))
    counts = materialise(counts)
    return running_totals(counts, [value], {"cum": F.col("n")}, by=by, totals={"cum": "total"})


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], *, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Linear-interpolation quantiles: one row per `by` group, columns q0, q1, ... `weight`: how often a row counts.

    Works from distinct values with their running counts, so the built-in exact
    `percentile`, which keeps a group's values in one task, is not needed.
    """
    pts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    c = value_counts(df, value, by=by, weight=weight)
    c = c.select(*by, value, "n", "cum", "total", F.explode(pts).alias("q"))
    h = F.col("q.p") * (F.col("total") - 1)
    lo, hi = F.floor(h), F.ceil(h)
    inside = lambda k: (k < F.col("cum")) & (k >= F.col("cum") - F.col("n"))
    c = c.select(*by, "q", (h - lo).alias("frac"),
                 F.when(inside(lo), F.col(value).cast("double")).alias("a"),
                 F.when(inside(hi), F.col(value).cast("double")).alias("b"),
                 ).where("a is not null or b is not null")
    a = lambda i: F.max(F.when(F.col("q.i") == i, F.col("a")))
    b = lambda i: F.max(F.when(F.col("q.i") == i, F.col("b")))
    f = lambda i: F.max(F.when(F.col("q.i") == i, F.col("frac")))
    return c.groupBy(*by).agg(*[(a(i) + (b(i) - a(i)) * f(i)).alias(f"q{i}") for i in range(len(probs))])
