"""Scalers, discretisers and mode-specific normalisation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import exact_quantiles, global_rank, range_count
from tabloom.functions.rng import u01
from tabloom.operators.encode import levels_of, one_hot, one_hot_inverse
from tabloom.operators.profile import long_values
from tabloom.spec import TableSpec


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """min, max, mean, population deviation of each column: one aggregate, one row to the driver."""
    fs = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop}
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{k}") for c in cols for k, f in fs.items()]).first()
    return {c: {k: row[f"{c}|{k}"] for k in fs} for c in cols}


@dataclass
class Affine:
    """x -> (x - shift) / width per column, and back."""

    parts: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - s) / w for c, (s, w) in self.parts.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * w + s for c, (s, w) in self.parts.items()})


def fit_robust(df: DataFrame, cols: Sequence[str]) -> Affine:
    """Median and interquartile range."""
    q = exact_quantiles(long_values(df, cols, dtype="double"), "value", [0.25, 0.5, 0.75], by=["column"]).collect()
    return Affine({r["column"]: (r["q1"], (r["q2"] - r["q0"]) or 1.0) for r in q})


def fit_min_max(df: DataFrame, cols: Sequence[str], low: float = 0.0, high: float = 1.0) -> Affine:
    """Column range onto [low, high]; a constant column goes to `low`."""
    parts = {}
    for c, s in column_stats(df, cols).items():
        width = ((s["max"] - s["min"]) or 1.0) / (high - low)
        parts[c] = (s["min"] - low * width, width)
    return Affine(parts)


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Affine:
    return Affine({c: (s["mean"], s["std"] or 1.0) for c, s in column_stats(df, cols).items()})


@dataclass
class Bins:
    """Equal-width bins: code and bin-centre decode."""

    edges: dict[str, tuple[float, float]]
    n: int
    epsilon: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.least(F.greatest(F.floor((F.col(c) - lo) / ((hi - lo) / self.n + self.epsilon)), F.lit(0)), F.lit(self.n - 1)).cast("int")
            for c, (lo, hi) in self.edges.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) + 0.5) * ((hi - lo) / self.n) + lo for c, (lo, hi) in self.edges.items()})


def fit_bins(df: DataFrame, cols: Sequence[str], n: int) -> Bins:
    return Bins({c: (s["min"], s["max"] if s["max"] > s["min"] else s["min"] + 1.0) for c, s in column_stats(df, cols).items()}, n)


def fit_tree_bins(df: DataFrame, cols: Sequence[str], depth: int = 4, pad: float = 0.03) -> Bins:
    """2^depth bins over the range widened by `pad` on both sides."""
    edges = {}
    for c, s in column_stats(df, cols).items():
        d = (s["max"] - s["min"]) * pad
        edges[c] = (s["min"] - d, s["max"] + d)
    return Bins(edges, 2**depth, 1e-8)


def tree_parent(code: Column, steps: int) -> Column:
    return F.floor(code / float(2**steps)).cast("int")


def tree_children(code: Column, steps: int) -> tuple[Column, Column]:
    """Codes [from, to) that a code covers `steps` levels below."""
    return code * 2**steps, (code + 1) * 2**steps


def nested_group(code: Column, size: int, level: int, group: int = 4) -> Column:
    """Category code at a taxonomy level: codes come in groups of four nested inside each
    other, and each level up folds the innermost remaining group into one code."""
    depth = max(1, math.ceil(size / group))
    return F.least(code, F.lit(group * (depth - level))) if level else code


@dataclass
class Mixture:
    """Weights, means and deviations of a one-dimensional Gaussian mixture."""

    weights: list[float]
    means: list[float]
    stds: list[float]

    def posterior(self, x: Column) -> list[Column]:
        """Component probabilities of x, shifted by the largest exponent so none underflows."""
        logs = [F.lit(math.log(w) - math.log(s)) - (x - m) * (x - m) / (2 * s * s) for w, m, s in zip(self.weights, self.means, self.stds)]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        parts = [F.exp(v - top) for v in logs]
        total = sum(parts[1:], parts[0])
        return [p / total for p in parts]


def fit_mixture(df: DataFrame, col: str, k: int = 5, min_weight: float = 0.0, seed: int = 1) -> Mixture:
    """Distributed EM; components below `min_weight` are dropped."""
    rows = VectorAssembler(inputCols=[col], outputCol="features").transform(df.select(F.col(col).cast("double")).dropna())
    model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(rows)
    parts = [(w, float(g.mean[0]), math.sqrt(max(float(g.cov[0, 0]), 1e-12))) for w, g in zip(model.weights, _gaussians(model))]
    parts = sorted((p for p in parts if p[0] > min_weight), key=lambda p: p[1])
    return Mixture(*[list(x) for x in zip(*parts)])


def _gaussians(model):
    class G:
        def __init__(self, row):
            self.mean, self.cov = row["mean"], row["cov"].toArray()

    return [G(r) for r in model.gaussiansDF.collect()]


def mode_normalise(df: DataFrame, col: str, mix: Mixture, key: str, *, width: float = 2.0, seed=None) -> DataFrame:
    """Add `<col>_mode` and `<col>_norm`: the component (most probable, or drawn by the
    posterior when a seed is given) and the value within it, clipped to +-0.99."""
    x = F.col(col)
    df = df.withColumn("_post", F.array(*mix.posterior(x)))
    if seed is None:
        mode = F.array_position("_post", F.array_max("_post")).cast("int")
    else:
        k = len(mix.weights)
        upto = [F.aggregate(F.slice("_post", 1, i), F.lit(0.0), lambda a, b: a + b) for i in range(1, k)]
        u = u01(seed, f"mode-{col}", key)
        mode = sum(((u > c).cast("int") for c in upto), F.lit(1))
    df = df.withColumn(f"{col}_mode", mode)
    m = F.element_at(F.array(*[F.lit(v) for v in mix.means]), F.col(f"{col}_mode"))
    s = F.element_at(F.array(*[F.lit(v) for v in mix.stds]), F.col(f"{col}_mode"))
    norm = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), (x - m) / (width * s)))
    return df.withColumn(f"{col}_norm", norm).drop("_post")


def mode_denormalise(df: DataFrame, col: str, mix: Mixture, *, width: float = 2.0) -> DataFrame:
    m = F.element_at(F.array(*[F.lit(v) for v in mix.means]), F.col(f"{col}_mode"))
    s = F.element_at(F.array(*[F.lit(v) for v in mix.stds]), F.col(f"{col}_mode"))
    return df.withColumn(col, F.col(f"{col}_norm") * width * s + m).drop(f"{col}_mode", f"{col}_norm")


def mixed_normalise(df: DataFrame, col: str, modal: Sequence[float], mix: Mixture, key: str, *, width: float = 4.0, seed=None) -> DataFrame:
    """Modal values take slots of their own after the mixture slots; slots are then renumbered
    by falling frequency in `<col>_slot` (0-based)."""
    out = mode_normalise(df, col, mix, key, width=width, seed=seed)
    k = len(mix.weights)
    slot = F.col(f"{col}_mode")
    norm = F.col(f"{col}_norm")
    for i, v in enumerate(modal):
        slot = F.when(F.col(col) == v, k + 1 + i).otherwise(slot)
        norm = F.when(F.col(col) == v, 0.0).otherwise(norm)
    out = out.withColumns({"_slot": slot, f"{col}_norm": norm}).drop(f"{col}_mode")
    counts = out.groupBy("_slot").agg(F.count("*").alias("_n"))  # one row per slot
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_n"), "_slot")
    ranks = counts.select("_slot", (F.row_number().over(order) - 1).alias(f"{col}_slot"))
    return out.join(F.broadcast(ranks), "_slot").drop("_slot")


def fit_margin_scale(df: DataFrame, spec: TableSpec, sizes: dict[str, int], margin: float = 1e-3) -> Affine:
    """[-1, 1] with a small margin; coded categories use 0 .. size - 1."""
    ends = {c: (s["min"], s["max"]) for c, s in column_stats(df, spec.numeric).items()} if spec.numeric else {}
    ends |= {c: (0.0, sizes[c] - 1.0) for c in spec.categorical}
    parts = {}
    for c, (lo, hi) in ends.items():
        lo, hi = lo - margin, hi + margin
        parts[c] = ((lo + hi) / 2, (hi - lo) / 2)
    return Affine(parts)


def margin_inverse(df: DataFrame, spec: TableSpec, scale: Affine) -> DataFrame:
    out = scale.inverse(df)
    return out.withColumns({c: F.rint(F.col(c)) for c in spec.categorical})


@dataclass
class Processor:
    """Min-max numeric columns and one-hot categorical ones behind one fit, with role checks."""

    spec: TableSpec
    scale: Affine | None = None
    levels: dict[str, list] | None = None

    def fit(self, df: DataFrame) -> "Processor":
        self.spec.check(df.columns)
        left = set(df.columns) - set(self.spec.columns)
        if left:
            raise ValueError(f"columns without a role: {sorted(left)}")
        self.scale = fit_min_max(df, self.spec.numeric) if self.spec.numeric else Affine({})
        self.levels = {c: levels_of(df, c) for c in self.spec.categorical}
        return self

    def _check(self):
        if self.scale is None:
            raise RuntimeError("fit the processor first")

    def transform(self, df: DataFrame) -> DataFrame:
        self._check()
        return one_hot(self.scale.transform(df), self.spec.categorical, self.levels)

    def inverse(self, df: DataFrame) -> DataFrame:
        self._check()
        return self.scale.inverse(one_hot_inverse(df, self.levels))


def sliding_windows(df: DataFrame, order: Sequence[str], cols: Sequence[str], length: int, *, key: str, seed=0, scale: bool = True) -> DataFrame:
    """Windows of `length` consecutive rows as arrays, one row per start, n - length of them, numbered in
    shuffled order.

    Rows are cut into blocks of consecutive ranks; a block also receives the first
    length - 1 rows of the next block, so no task orders more than one block.
    """
    if scale:
        df = fit_min_max(df, cols).transform(df)
    r = global_rank(df.select(key, *order, *[c for c in cols if c not in order]), list(order), rank="_r", total="_n")
    size = F.greatest(F.ceil(F.col("_n") / range_count(df.sparkSession)), F.lit(length))
    r = r.withColumn("_own", F.floor((F.col("_r") - 1) / size)).withColumn("_off", (F.col("_r") - 1) % size)
    copies = F.when((F.col("_off") < length - 1) & (F.col("_own") > 0), F.array("_own", F.col("_own") - 1)).otherwise(F.array("_own"))
    r = r.withColumn("_block", F.explode(copies))
    w = Window.partitionBy("_block").orderBy("_r").rowsBetween(0, length - 1)
    r = r.withColumns({c: F.collect_list(c).over(w) for c in cols})
    r = r.where((F.col("_block") == F.col("_own")) & (F.col("_r") <= F.col("_n") - length)).withColumn("_u", u01(seed, "window", key))
    return global_rank(r.select(key, "_u", *cols), ["_u", key], rank="position", uniform=F.col("_u")).drop("_u")
