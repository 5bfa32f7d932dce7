"""Differentially private aggregates: one Spark aggregate over clipped data, then noise on the
small result. Groups must be public; they hold disjoint rows, so a group-by is one spend.
`seed=None` draws noise from operating-system entropy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import noise
from tabloom.functions.draws import exponential_select
from tabloom.functions.ordering import running_totals
from tabloom.functions.rng import secret_seed, u01
from tabloom.operators.clean import clip
from tabloom.operators.ledger import Ledger, spend
from tabloom.operators.scale import Affine


def _bounds(bounds):
    if bounds is None:
        raise ValueError("bounds are required: reading them from the data would leak it")
    lo, hi = float(bounds[0]), float(bounds[1])
    if lo >= hi:
        raise ValueError("lower bound must lie below upper bound")
    return lo, hi


def _keys(by):
    return [F.col(c) for c in by] or [F.lit("all")]


def count_nonzero(df: DataFrame, col: str, epsilon: float, *, by: Sequence[str] = (), ledger: Ledger | None = None, seed=None) -> DataFrame:
    spend(ledger, epsilon)
    g = df.groupBy(*by).agg(F.count_if(F.col(col).cast("double") != 0).alias("_k"), F.count("*").alias("_n"))
    return g.select(*by, noise.geometric_truncated(F.col("_k"), u01(seed, f"count-{col}", *_keys(by)), epsilon, F.lit(0.0), F.col("_n").cast("double")).alias("value"))


def total(df: DataFrame, col: str, bounds, epsilon: float, *, by: Sequence[str] = (), ledger: Ledger | None = None, seed=None) -> DataFrame:
    """Sum of the clipped non-null values; whole-number columns get geometric noise."""
    lo, hi = _bounds(bounds)
    spend(ledger, epsilon)
    whole = df.schema[col].dataType.typeName() in ("integer", "long", "short", "byte")
    g = df.groupBy(*by).agg(F.sum(clip(F.col(col).cast("double"), lo, hi)).alias("_s"), F.count(col).alias("_n"))
    u, n = u01(seed, f"sum-{col}", *_keys(by)), F.col("_n").cast("double")
    if whole:
        out = noise.geometric_truncated(F.col("_s"), u, epsilon, n * lo, n * hi, hi - lo)
    else:
        out = noise.laplace_truncated(F.col("_s"), u, epsilon, hi - lo, n * lo, n * hi)
    return g.select(*by, out.alias("value"))


def mean(df: DataFrame, col: str, bounds, epsilon: float, *, by: Sequence[str] = (), ledger: Ledger | None = None, seed=None) -> DataFrame:
    lo, hi = _bounds(bounds)
    spend(ledger, epsilon)
    g = df.groupBy(*by).agg(F.avg(clip(F.col(col).cast("double"), lo, hi)).alias("_m"), F.count(col).alias("_n"))
    out = noise.laplace_truncated(F.col("_m"), u01(seed, f"mean-{col}", *_keys(by)), epsilon, (hi - lo) / F.col("_n"), lo, hi)
    return g.select(*by, out.alias("value"))


def variance(df: DataFrame, col: str, bounds, epsilon: float, *, by: Sequence[str] = (), ledger: Ledger | None = None, seed=None) -> DataFrame:
    lo, hi = _bounds(bounds)
    spend(ledger, epsilon)
    w = hi - lo
    g = df.groupBy(*by).agg(F.var_pop(clip(F.col(col).cast("double"), lo, hi)).alias("_v"), F.count(col).alias("_n"))
    n = F.col("_n").cast("double")
    out = noise.laplace_bounded_domain(F.col("_v"), u01(seed, f"var-{col}", *_keys(by)), epsilon, (w / n) * (w / n) * (n - 1), F.lit(0.0), F.lit(w * w / 4))
    return g.select(*by, out.alias("value"))


def deviation(df: DataFrame, col: str, bounds, epsilon: float, **kw) -> DataFrame:
    return variance(df, col, bounds, epsilon, **kw).withColumn("value", F.sqrt("value"))


def histogram(df: DataFrame, bins: dict[str, tuple[float, float, int]], epsilon: float, *, density: bool = False, ledger: Ledger | None = None, seed=None) -> DataFrame:
    """Noisy counts of an n-dimensional grid: bins maps column -> (low, high, number). Every cell
    of the grid gets noise, empty ones too; rows outside all bins are not counted."""
    spend(ledger, epsilon)
    inside, codes = F.lit(True), {}
    for c, (lo, hi, n) in bins.items():
        inside = inside & F.col(c).between(lo, hi)
        codes[f"{c}_bin"] = F.least(F.floor((F.col(c) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")
    counts = df.where(inside).select(*[v.alias(k) for k, v in codes.items()]).groupBy(*codes).agg(F.count("*").alias("_k"))
    size = math.prod(n for _, _, n in bins.values())
    grid, step = df.sparkSession.range(size), size
    for c, (_, _, n) in bins.items():
        step //= n
        grid = grid.withColumn(f"{c}_bin", (F.floor(F.col("id") / step) % n).cast("int"))
    cells = grid.drop("id").join(counts, list(codes), "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    value = noise.geometric_truncated(F.col("_k"), u01(seed, "hist", *codes), epsilon, 0, 2.0**53)
    cells = cells.select(*codes, value.cast("double").alias("value"))
    if density:
        volume = math.prod((hi - lo) / n for lo, hi, n in bins.values())
        cells = cells.withColumn("value", F.col("value") / (cells.agg(F.sum("value")).scalar() * volume))
    return cells


def quantile(df: DataFrame, col: str, q: float, bounds, epsilon: float, *, by: Sequence[str] = (), ledger: Ledger | None = None, seed=None) -> DataFrame:
    """Exponential choice of a gap between neighbouring values, weighted by its width, then a
    uniform point in it. Works on distinct values, where only the last copy of a value opens a gap."""
    lo, hi = _bounds(bounds)
    spend(ledger, epsilon)
    seed = seed if seed is not None else secret_seed()
    v = df.select(*by, clip(F.col(col).cast("double"), lo, hi).alias("_x")).where("_x is not null")
    ends = v.select(*by).distinct() if by else df.sparkSession.range(1).select()
    c = v.groupBy(*by, "_x").agg(F.count("*").alias("_m"))
    c = c.unionByName(ends.select(*by, F.lit(lo).alias("_x"), F.lit(0).cast("long").alias("_m"))).groupBy(*by, "_x").agg(F.sum("_m").alias("_m"))
    c = running_totals(c, ["_x"], {"_i": F.col("_m")}, by=by, totals={"_i": "_n"}, lead={"_next": "_x"})
    c = c.withColumn("_to", F.coalesce("_next", F.lit(hi)))
    # an infinite epsilon leaves the gap nearest to the wanted rank
    eps = min(epsilon, 1e12)
    util = -F.abs(F.col("_i") - q * F.col("_n"))
    picked = exponential_select(c.withColumn("_gap", F.struct("_x", "_to")), by, "_gap", util, eps, 1.0, u01(seed, f"gap-{col}", *_keys(by), "_x"),
                                measure=F.col("_to") - F.col("_x"))
    u = u01(seed, f"point-{col}", *_keys(by))
    return picked.select(*by, (F.col("_gap._x") + u * (F.col("_gap._to") - F.col("_gap._x"))).alias("value"))


def covariance(df: DataFrame, bounds: dict[str, tuple[float, float]], epsilon: float, *, ledger: Ledger | None = None, seed=None) -> DataFrame:
    """(a, b, value): sample covariance of clipped columns, epsilon shared evenly over the triangle."""
    spend(ledger, epsilon)
    seed = seed if seed is not None else secret_seed()
    cols = list(bounds)
    x = {c: clip(F.col(c).cast("double"), *_bounds(bounds[c])) for c in cols}
    pairs = list(combinations_with_replacement(cols, 2))
    row = df.agg(F.count("*").alias("n"), *[F.covar_samp(x[a], x[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    width = {c: bounds[c][1] - bounds[c][0] for c in cols}
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("v"), F.lit(float(2 * width[a] * width[b])).alias("w"))
                      for i, (a, b) in enumerate(pairs)])
    out = row.select("n", F.inline(cells))
    share = epsilon / len(pairs)
    return out.select("a", "b", noise.laplace(F.col("v"), u01(seed, "cov", "a", "b"), share, F.col("w") / F.col("n")).alias("value"))


def accuracy_of(epsilon: float, sensitivity: float, alpha: float = 0.05) -> float:
    """Error not exceeded with probability 1 - alpha."""
    return sensitivity / epsilon * math.log(1 / alpha)


def epsilon_of(accuracy: float, sensitivity: float, alpha: float = 0.05) -> float:
    return sensitivity / accuracy * math.log(1 / alpha)


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, mean, m2): mergeable state of a batch."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "column", "value")
    return long.groupBy(*by, "column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


def merge_moments(states: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Merge any number of batch states: counts add, means weigh by count, spreads add with the
    spread between the batch means."""
    n, m = F.col("n"), F.col("mean")
    g = states.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.sum(n * m).alias("s"), F.sum("m2").alias("w"), F.sum(n * m * m).alias("q"))
    return g.select(*by, "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("w") + F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("m2"))


def level_frequencies(df: DataFrame, cols: Sequence[str], epsilon: float, *, log: bool = False, ledger: Ledger | None = None, seed=None) -> DataFrame:
    """(column, value, freq): noisy level counts, at least 1, optionally logged; epsilon is shared over the columns."""
    from tabloom.operators.profile import level_counts

    spend(ledger, epsilon)
    c = level_counts(df, cols)
    k = F.greatest(noise.geometric(F.col("n"), u01(seed, "freq", "column", "value"), epsilon / len(cols)), F.lit(1)).cast("double")
    return c.select("column", "value", (F.log(k) if log else k).alias("freq"))


def fit_private_standard(df: DataFrame, bounds: dict[str, tuple[float, float]], epsilon: float, *, width: float = 1.0, ledger: Ledger | None = None, seed=None) -> Affine:
    """Standard scale from noisy mean and variance; epsilon is shared over columns and the two numbers."""
    seed = seed if seed is not None else secret_seed()
    share = epsilon / (2 * len(bounds))
    spend(ledger, epsilon)
    parts = {}
    row = None
    for c, b in bounds.items():
        m = mean(df, c, b, share, seed=seed).select(F.lit(c).alias("c"), F.lit("m").alias("k"), "value")
        v = variance(df, c, b, share, seed=seed).select(F.lit(c).alias("c"), F.lit("v").alias("k"), "value")
        both = m.unionByName(v)
        row = both if row is None else row.unionByName(both)
    got = {(r["c"], r["k"]): r["value"] for r in row.collect()}  # two numbers per column
    for c in bounds:
        parts[c] = (got[c, "m"], (math.sqrt(got[c, "v"]) or 1.0) * width)
    return Affine(parts)


def fit_private_min_max(df: DataFrame, bounds: dict[str, tuple[float, float]], epsilon: float, *, ledger: Ledger | None = None, seed=None) -> Affine:
    """Min-max scale from noisy 0 and 1 quantiles onto [-1, 1]."""
    seed = seed if seed is not None else secret_seed()
    share = epsilon / (2 * len(bounds))
    spend(ledger, epsilon)
    rows = None
    for c, b in bounds.items():
        for k, q in (("lo", 0.0), ("hi", 1.0)):
            r = quantile(df, c, q, b, share, seed=f"{seed}-{k}").select(F.lit(c).alias("c"), F.lit(k).alias("k"), "value")
            rows = r if rows is None else rows.unionByName(r)
    got = {(r["c"], r["k"]): r["value"] for r in rows.collect()}
    parts = {}
    for c in bounds:
        lo, hi = sorted((got[c, "lo"], got[c, "hi"]))
        half = ((hi - lo) or 1.0) / 2
        parts[c] = (lo + half, half)
    return Affine(parts)
