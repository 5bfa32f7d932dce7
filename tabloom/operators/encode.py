"""Encoders from categories to numbers.

Every supervised encoder is a formula over the same per-level sums, so fitting is one
partially aggregated pass over the data whatever the number of columns, classes or folds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.ordering import exact_quantiles, global_rank, running_totals
from tabloom.functions.rng import normal, u01
from tabloom.functions.tables import look_up, materialise
from tabloom.operators.profile import long_values
from tabloom.spec import MULTICLASS, TableSpec

UNKNOWN, MISSING = -1, -2
MAX_DENSE_LEVELS = 5000


# --- unsupervised codes -------------------------------------------------------------

@dataclass
class Codes:
    """Level codes (column, value, code) and how to put them on and take them off."""

    table: DataFrame
    cols: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.cols:
            df = df.withColumn("_null", F.col(c).isNull())
            df = look_up(df, self.table, c, {"code": "_code"}).withColumn(
                c, F.when(F.col("_null"), MISSING).otherwise(F.coalesce("_code", F.lit(UNKNOWN))).cast("long")).drop("_code", "_null")
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        back = self.table.select("column", F.col("code").cast("string").alias("value"), F.col("value").alias("level"))
        for c in self.cols:
            df = look_up(df, back, c, {"level": "_level"}).withColumn(c, F.col("_level")).drop("_level")
        return df


def fit_ordinal(df: DataFrame, cols: Sequence[str], key: str) -> Codes:
    """Codes 1..n by first appearance in key order."""
    first = long_values(df, cols, keep=[key]).where("value is not null").groupBy("column", "value").agg(F.min(key).alias("_first"))
    codes = global_rank(first, ["_first", "value"], by=["column"], rank="code")
    return Codes(materialise(codes.select("column", "value", "code")), tuple(cols))


def fit_labels(df: DataFrame, cols: Sequence[str]) -> Codes:
    """Codes 0..n-1 in sorted order."""
    levels = long_values(df, cols).where("value is not null").distinct()
    codes = global_rank(levels, ["value"], by=["column"], rank="code")
    return Codes(materialise(codes.select("column", "value", (F.col("code") - 1).alias("code"))), tuple(cols))


@dataclass
class DeepOrdinal:
    """Ordinal features, label-coded target, features renamed by position; invertible."""

    features: Codes
    target: Codes | None
    spec: TableSpec

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.features.transform(df)
        if self.target:
            out = self.target.transform(out)
        return out.select(self.spec.key, *[F.col(c).alias(str(i)) for i, c in enumerate(self.spec.features)], self.spec.target)

    def inverse(self, df: DataFrame) -> DataFrame:
        out = df.select(self.spec.key, *[F.col(str(i)).alias(c) for i, c in enumerate(self.spec.features)], self.spec.target)
        out = self.features.inverse(out)
        return self.target.inverse(out) if self.target else out


def fit_deep_ordinal(df: DataFrame, spec: TableSpec) -> DeepOrdinal:
    discrete = spec.task != "regression"
    return DeepOrdinal(fit_ordinal(df, spec.categorical, spec.key), fit_labels(df, [spec.target]) if discrete else None, spec)


def levels_of(df: DataFrame, col: str) -> list:
    """Sorted levels of a column that is to become one output column per level."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MAX_DENSE_LEVELS + 1).collect()
    if len(rows) > MAX_DENSE_LEVELS:
        raise ValueError(f"{col} has more than {MAX_DENSE_LEVELS} levels; use fit_labels and keep the code as a sparse index")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence] | None = None, drop_invariant: bool = False) -> DataFrame:
    """0/1 columns `<column>_<level>`; the source columns go."""
    levels = levels or {c: levels_of(df, c) for c in cols}
    new = [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
           for c in cols for v in levels[c] if not (drop_invariant and len(levels[c]) == 1)]
    return df.select(*[c for c in df.columns if c not in cols], *new)


def one_hot_inverse(df: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """Level of the largest indicator, first on ties."""
    gone = [f"{c}_{v}" for c, vs in levels.items() for v in vs]
    new = []
    for c, vs in levels.items():
        hot = F.array(*[F.col(f"{c}_{v}") for v in vs])
        new.append(F.element_at(F.array(*[F.lit(v) for v in vs]), F.array_position(hot, F.array_max(hot)).cast("int")).alias(c))
    return df.select(*[x for x in df.columns if x not in gone], *new)


def digits(df: DataFrame, cols: Sequence[str], codes: Codes, sizes: Mapping[str, int], base: int = 2) -> DataFrame:
    """Base-`base` digits of the ordinal code, most significant first, `<column>_0`, ..."""
    out = codes.transform(df)
    new = []
    for c in cols:
        width = 1
        while base**width <= sizes[c]:
            width += 1
        new += [(F.floor(F.greatest(F.col(c), F.lit(0)) / float(base ** (width - 1 - i))) % base).alias(f"{c}_{i}") for i in range(width)]
    return out.select(*[x for x in df.columns if x not in cols], *new)


def hashing(df: DataFrame, cols: Sequence[str], n: int = 8) -> DataFrame:
    """Counts of md5(value) mod n over the columns, in `col_0` ... `col_{n-1}`."""

    def bucket(c):
        text = F.md5(F.col(c).cast("string"))
        r = F.lit(0).cast("long")
        for i in range(4):
            r = (r * (1 << 32) + F.conv(F.substring(text, 8 * i + 1, 8), 16, 10).cast("long")) % n
        return r

    df = df.withColumns({f"_h{i}": bucket(c) for i, c in enumerate(cols)})
    sums = [sum((F.col(f"_h{i}") == b).cast("int") for i in range(1, len(cols))) + (F.col("_h0") == b).cast("int") if len(cols) > 1
            else (F.col("_h0") == b).cast("int") for b in range(n)]
    return df.select(*[x for x in df.columns if x not in cols and not x.startswith("_h")],
                     *[F.coalesce(s, F.lit(0)).alias(f"col_{b}") for b, s in enumerate(sums)])


def contrast_matrix(kind: str, k: int) -> np.ndarray:
    """k levels x (k - 1) contrasts."""
    i, j = np.arange(k)[:, None], np.arange(k - 1)[None, :]
    if kind == "sum":
        return np.where(i == k - 1, -1.0, (i == j).astype(float))
    if kind == "helmert":
        return np.where(i <= j, -1.0, np.where(i == j + 1, j + 1.0, 0.0))
    if kind == "backward_difference":
        return np.where(i <= j, (j + 1.0 - k) / k, (j + 1.0) / k)
    if kind == "polynomial":
        x = np.arange(k, dtype=float) - (k - 1) / 2
        q, r = np.linalg.qr(np.vander(x, k, increasing=True))
        return (q * np.sign(np.diag(r)))[:, 1:]
    raise ValueError(f"unknown contrast {kind!r}")


def contrasts(df: DataFrame, col: str, kind: str, codes: Codes, k: int) -> DataFrame:
    """Contrast columns `<column>_0` ... for a column with `k` levels; other rows get zeros."""
    m = contrast_matrix(kind, k)
    out = codes.transform(df)
    pos = F.when(F.col(col).between(1, k), F.col(col).cast("int"))
    new = [F.coalesce(F.element_at(F.array(*[F.lit(float(v)) for v in m[:, j]]), pos), F.lit(0.0)).alias(f"{col}_{j}") for j in range(k - 1)]
    return out.select(*[x for x in df.columns if x != col], *new)


def collapse(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All categorical columns give one constant column."""
    return df.drop(*cols).withColumn("cat", F.lit(1.0))


# --- supervised encoders ------------------------------------------------------------

def classes_by_appearance(df: DataFrame, spec: TableSpec) -> list:
    rows = df.groupBy(spec.target).agg(F.min(spec.key).alias("k")).orderBy("k").limit(MAX_DENSE_LEVELS + 1).collect()
    if len(rows) > MAX_DENSE_LEVELS:
        raise ValueError(f"{spec.target} has more than {MAX_DENSE_LEVELS} classes")
    return [r[0] for r in rows]


def targets(df: DataFrame, spec: TableSpec) -> dict[str, Column]:
    """Output suffix -> numeric target. Several classes: one indicator per class but the first."""
    if spec.task != MULTICLASS:
        return {"": F.col(spec.target).cast("double")}
    return {f"_{c}": (F.col(spec.target) == c).cast("double") for c in classes_by_appearance(df, spec)[1:]}


@dataclass
class Encoder:
    """A fitted table (column, value, one number per output suffix) and its defaults."""

    table: DataFrame
    cols: tuple[str, ...]
    suffixes: tuple[str, ...]
    default: dict[str, float | None]

    def transform(self, df: DataFrame, extra: Sequence[str] = (), table: DataFrame | None = None, keep_null: bool = False) -> DataFrame:
        for c in self.cols:
            outs = {f"e{s}": f"_enc{s}" for s in self.suffixes}
            missing = {} if keep_null else {f"_enc{s}": F.lit(self.default[s]).cast("double") for s in self.suffixes}
            df = look_up(df, table if table is not None else self.table, c, outs, missing=missing, extra=extra)
            df = df.drop(c).withColumnsRenamed({f"_enc{s}": f"{c}{s}" for s in self.suffixes})
        return df


def level_sums(df: DataFrame, cols: Sequence[str], ys: Mapping[str, Column], fold: str | None = None) -> DataFrame:
    """(column, value[, fold], n, s<suffix>, q<suffix>): rows, target sum and sum of squares per level."""
    rows = df.select(*cols, *([fold] if fold else []), *[y.alias(f"_y{s}") for s, y in ys.items()])
    keep = [*([fold] if fold else []), *[f"_y{s}" for s in ys]]
    long = long_values(rows, cols, keep=keep).where("value is not null")
    aggs = [F.count("*").alias("n")]
    for s in ys:
        aggs += [F.sum(f"_y{s}").alias(f"s{s}"), F.sum(F.col(f"_y{s}") * F.col(f"_y{s}")).alias(f"q{s}")]
    return long.groupBy("column", "value", *([fold] if fold else [])).agg(*aggs)


def totals_of(df: DataFrame, ys: Mapping[str, Column]) -> dict:
    aggs = [F.count("*").alias("n")]
    for s, y in ys.items():
        aggs += [F.sum(y).alias(f"s{s}"), F.sum(y * y).alias(f"q{s}")]
    return df.agg(*aggs).first().asDict()


Formula = Callable[[Column, Column, Column, Column, Column, Column], Column]


def target_mean(k: float = 1.0, f: float = 1.0) -> Formula:
    """Level mean pulled to the prior by a sigmoid of the level size; one-row levels are the prior."""

    def value(n, s, q, N, S, Q):
        w = 1.0 / (1.0 + F.exp(-(n - k) / f))
        return F.when(n == 1, S / N).otherwise(S / N * (1.0 - w) + s / n * w)

    return value


def count() -> Formula:
    return lambda n, s, q, N, S, Q: n.cast("double")


def m_estimate(m: float = 1.0) -> Formula:
    return lambda n, s, q, N, S, Q: (s + m * S / N) / (n + m)


def ordered_full(a: float = 1.0) -> Formula:
    return lambda n, s, q, N, S, Q: (s + a * S / N) / (n + a)


def level_mean() -> Formula:
    return lambda n, s, q, N, S, Q: F.when(n == 1, S / N).otherwise(s / n)


def _var(n, s, q) -> Column:
    return F.greatest(F.lit(0.0), F.try_divide(q - s * s / n, n - 1))


def james_stein() -> Formula:
    """Level mean shrunk to the grand mean by its share of variance; one-row levels are the prior."""

    def value(n, s, q, N, S, Q):
        vi, v = _var(n, s, q), _var(N, S, Q)
        b = F.coalesce(F.try_divide(vi, vi + v), F.lit(0.0))
        return F.when(n == 1, S / N).otherwise((1.0 - b) * s / n + b * S / N)

    return value


def weight_of_evidence(reg: float = 1.0) -> Formula:
    def value(n, s, q, N, S, Q):
        good = (s + reg) / (S + 2 * reg)
        bad = (n - s + reg) / (N - S + 2 * reg)
        return F.when(n == 1, 0.0).otherwise(F.log(good / bad))

    return value


def log_odds_intercept(steps: int = 8) -> Formula:
    """Random intercept of a level under a unit normal prior, by Newton steps on the level counts."""

    def value(n, s, q, N, S, Q):
        base = F.log(S / (N - S))

        def step(b, _):
            p = 1.0 / (1.0 + F.exp(-(base + b)))
            return b + (s - n * p - b) / (n * p * (1.0 - p) + 1.0)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)

    return value


def fit_formula(df: DataFrame, spec: TableSpec, formula: Formula, default: float | str | None = "prior",
                sums: DataFrame | None = None, ys: Mapping[str, Column] | None = None) -> Encoder:
    """Fit any per-level formula; unknown and missing levels get the prior or `default`."""
    ys = ys or targets(df, spec)
    tot = totals_of(df, ys)
    sums = sums if sums is not None else level_sums(df, spec.categorical, ys)
    lit = lambda x: F.lit(float(x))
    vals = [formula(F.col("n"), F.col(f"s{s}"), F.col(f"q{s}"), lit(tot["n"]), lit(tot[f"s{s}"]), lit(tot[f"q{s}"])).alias(f"e{s}") for s in ys]
    table = materialise(sums.select("column", "value", *vals))
    defaults = {s: (tot[f"s{s}"] / tot["n"] if default == "prior" else default) for s in ys}
    return Encoder(table, tuple(spec.categorical), tuple(ys), defaults)


def intercept_table(sums: DataFrame, by: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """Shrunken level deviations of a one-way random-effects model, variances by moments.

    Columns whose levels are all different rows (ids) get zero.
    """
    aggs = [F.count("*").alias("k"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("n2")]
    for s in suffixes:
        aggs += [F.sum(f"s{s}").alias(f"all_s{s}"), F.sum(f"q{s}").alias(f"all_q{s}"),
                 F.sum(F.col(f"s{s}") * F.col(f"s{s}") / F.col("n")).alias(f"all_b{s}")]
    glob = sums.groupBy(*by).agg(*aggs)
    j = sums.join(glob, list(by))
    k, N, n = F.col("k"), F.col("rows").cast("double"), F.col("n").cast("double")
    outs = []
    for s in suffixes:
        S, Q, B = F.col(f"all_s{s}"), F.col(f"all_q{s}"), F.col(f"all_b{s}")
        within = F.try_divide(Q - B, N - k)
        n0 = (N - F.col("n2") / N) / (k - 1)
        between = F.greatest(F.lit(0.0), (F.try_divide(B - S * S / N, k - 1) - within) / n0)
        weight = F.try_divide(between, between + within / n)
        outs.append(F.when(k == N, 0.0).otherwise(F.coalesce(weight * (F.col(f"s{s}") / n - S / N), F.lit(0.0))).alias(f"e{s}"))
    return j.select(*by, "value", *outs)


def fit_intercepts(df: DataFrame, spec: TableSpec) -> Encoder:
    """Mixed-model encoder: deviations for a continuous target, log odds for classes; unknown -> 0."""
    ys = targets(df, spec)
    if spec.task != "regression":
        sums = level_sums(df, spec.categorical, ys)
        ids = sums.groupBy("column").agg((F.max("n") == 1).alias("is_id"))
        enc = fit_formula(df, spec, log_odds_intercept(), default=0.0, sums=sums, ys=ys)
        enc.table = materialise(enc.table.join(ids, "column").select(
            "column", "value", *[F.when(F.col("is_id"), 0.0).otherwise(F.col(f"e{s}")).alias(f"e{s}") for s in ys]))
        return enc
    table = materialise(intercept_table(level_sums(df, spec.categorical, ys), ["column"], list(ys)))
    return Encoder(table, tuple(spec.categorical), tuple(ys), {s: 0.0 for s in ys})


def jitter(df: DataFrame, cols: Sequence[str], key: str, sigma: float, seed) -> DataFrame:
    """Multiplicative normal noise on encoded training columns."""
    return df.withColumns({c: F.col(c) * (1.0 + sigma * normal(u01(seed, f"{c}-a", key), u01(seed, f"{c}-b", key))) for c in cols})


def ordered_target(df: DataFrame, spec: TableSpec, a: float = 1.0) -> DataFrame:
    """Training form of the ordered statistic: each row sees only the rows before it in key order.

    All columns are ordered together in long form, by ranges of (column, value, key).
    """
    ys = targets(df, spec)
    tot = totals_of(df, ys)
    slim = df.select(spec.key, *spec.categorical, *[y.alias(f"_y{s}") for s, y in ys.items()])
    long = long_values(slim, spec.categorical, keep=[spec.key, *[f"_y{s}" for s in ys]])
    run = running_totals(long, [spec.key], {"_n": F.lit(1), **{f"_s{s}": F.col(f"_y{s}") for s in ys}}, by=["column", "value"])
    code = lambda s: (F.col(f"_s{s}") - F.col(f"_y{s}") + a * tot[f"s{s}"] / tot["n"]) / (F.col("_n") - 1 + a)
    wide = run.groupBy(spec.key).agg(*[
        F.max(F.when(F.col("column") == c, code(s))).alias(f"{c}{s}") for c in spec.categorical for s in ys])
    return df.drop(*spec.categorical).join(wide, spec.key)


def leave_one_out(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Training form: mean of the other rows of the level; one-row levels get the prior."""
    ys = targets(df, spec)
    tot = totals_of(df, ys)
    sums = materialise(level_sums(df, spec.categorical, ys))
    out = df
    for c in spec.categorical:
        out = look_up(out, sums, c, {"n": "_n", **{f"s{s}": f"_s{s}" for s in ys}})
        out = out.withColumns({f"_e{s}": F.coalesce(F.try_divide(F.col(f"_s{s}") - y, F.col("_n") - 1), F.lit(tot[f"s{s}"] / tot["n"])) for s, y in ys.items()})
        out = out.drop(c, "_n", *[f"_s{s}" for s in ys]).withColumnsRenamed({f"_e{s}": f"{c}{s}" for s in ys})
    return out


def fit_quantile(df: DataFrame, spec: TableSpec, q: float = 0.5, m: float = 1.0) -> Encoder:
    """Level quantile pulled to the table quantile by m pseudo-rows. Rows are counted once by all levels and target."""
    rows = df.withColumn("_y", F.col(spec.target).cast("double"))
    rows = materialise(rows.groupBy(*spec.categorical, "_y").agg(F.count("*").alias("_w")))
    long = long_values(rows, spec.categorical, keep=["_y", "_w"]).where("value is not null")
    per = exact_quantiles(long, "_y", [q], by=["column", "value"], weight=F.col("_w"))
    n = long.groupBy("column", "value").agg(F.sum("_w").alias("n"))
    top = exact_quantiles(rows, "_y", [q], weight=F.col("_w")).first()[0]
    table = materialise(per.join(n, ["column", "value"]).select("column", "value", ((F.col("q0") * F.col("n") + m * top) / (F.col("n") + m)).alias("e")))
    return Encoder(table, tuple(spec.categorical), ("",), {"": top})


def cross_fitted(df: DataFrame, spec: TableSpec, fold: str, n_splits: int = 5, kind: str = "target", default: float = -1.0, *,
                 k: float = 1.0, f: float = 1.0) -> DataFrame:
    """Each fold (numbered 0..n_splits-1) encoded from the other folds; gaps take the whole-table
    code, then `default`.

    Out-of-fold sums are total minus own fold, so no fold is fitted by a pass of its own.
    """
    df = materialise(df)  # the folds are read by several jobs
    ys = targets(df, spec)
    own = materialise(level_sums(df, spec.categorical, ys, fold=fold))
    names = ["n", *[f"{x}{s}" for s in ys for x in ("s", "q")]]
    whole = own.groupBy("column", "value").agg(*[F.sum(c).alias(c) for c in names])
    each_fold = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias(fold))
    out_of = (each_fold.join(own.withColumnsRenamed({c: f"_o{c}" for c in names}), ["column", "value", fold], "left")
              .select("column", "value", fold, *[(F.col(c) - F.coalesce(F.col(f"_o{c}"), F.lit(0))).alias(c) for c in names])
              .where("n > 0"))
    if kind == "target":
        tot = df.groupBy(fold).agg(F.count("*").alias("_N"), *[F.sum(y).alias(f"_S{s}") for s, y in ys.items()])
        all_ = totals_of(df, ys)
        j = out_of.join(F.broadcast(tot), fold)
        mean = target_mean(k, f)
        per = j.select("column", "value", fold, *[
            mean(F.col("n"), F.col(f"s{s}"), None, all_["n"] - F.col("_N"), all_[f"s{s}"] - F.col(f"_S{s}"), None).alias(f"e{s}") for s in ys])
        full = fit_formula(df, spec, mean, sums=whole, ys=ys)
    elif spec.task == "regression":
        per = intercept_table(out_of, ["column", fold], list(ys)).select("column", "value", fold, *[f"e{s}" for s in ys])
        full = fit_intercepts(df, spec)
    else:
        tot = df.groupBy(fold).agg(F.count("*").alias("_N"), *[F.sum(y).alias(f"_S{s}") for s, y in ys.items()])
        all_ = totals_of(df, ys)
        j = out_of.join(F.broadcast(tot), fold)
        odds = log_odds_intercept()
        per = j.select("column", "value", fold, *[
            odds(F.col("n"), F.col(f"s{s}"), None, all_["n"] - F.col("_N"), all_[f"s{s}"] - F.col(f"_S{s}"), None).alias(f"e{s}") for s in ys])
        full = fit_intercepts(df, spec)
    per = materialise(per)
    out = df
    for c in spec.categorical:
        out = look_up(out, per, c, {f"e{s}": f"_p{s}" for s in ys}, extra=[fold])
        out = look_up(out, full.table, c, {f"e{s}": f"_f{s}" for s in ys}, missing={f"_f{s}": F.lit(full.default[s]).cast("double") for s in ys})
        out = out.drop(c).withColumns({f"{c}{s}": F.coalesce(F.col(f"_p{s}"), F.col(f"_f{s}"), F.lit(default)) for s in ys}).drop(
            *[f"_{x}{s}" for s in ys for x in "pf"])
    return out


def map_levels(df: DataFrame, table: DataFrame, cols: Sequence[str], default: float = -1.0) -> DataFrame:
    """Plain mapping encoder: (column, value, e) with a default for levels not listed."""
    return Encoder(materialise(table), tuple(cols), ("",), {"": default}).transform(df)
