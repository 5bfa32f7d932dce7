"""Generators: fit a table, then sample one. A model is a handful of small tables; sampling
starts from a distributed range of row numbers and draws each column by expressions or equi-joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.draws import draw, interval_table
from tabloom.functions.gauss import normal_cdf, normal_quantile
from tabloom.functions.noise import laplace_draw
from tabloom.functions.ordering import global_rank
from tabloom.functions.rng import normal, pick, secret_seed, u01
from tabloom.functions.tables import look_up, materialise
from tabloom.operators.augment import quotas, requests
from tabloom.operators.encode import Codes, fit_labels
from tabloom.operators.ledger import Ledger, spend
from tabloom.operators.private_models import generator
from tabloom.operators.profile import cardinalities, dependence, level_counts, long_values
from tabloom.operators.scale import Bins, Mixture, column_stats, fit_bins, fit_mixture
from tabloom.spec import TableSpec


def blank(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row")


# --- one column at a time -----------------------------------------------------------

@dataclass
class Independent:
    """Categorical columns by their frequencies; numeric ones by a Gaussian mixture cut to the range."""

    spec: TableSpec
    laws: dict[str, DataFrame]
    mixtures: dict[str, tuple[Mixture, float, float]]

    def sample(self, n: int, seed=0, rows: DataFrame | None = None) -> DataFrame:
        spark = next(iter(self.laws.values())).sparkSession if self.laws else SparkSession.active()
        df = rows if rows is not None else blank(spark, n)
        for c, law in self.laws.items():
            df = draw(df, law, [], "value", u01(seed, f"level-{c}", "row"), c)
        return df.withColumns({c: self._number(c, m, lo, hi, seed) for c, (m, lo, hi) in self.mixtures.items()})

    def _number(self, c, m: Mixture, lo, hi, seed) -> Column:
        u, z = u01(seed, f"part-{c}", "row"), normal(u01(seed, f"a-{c}", "row"), u01(seed, f"b-{c}", "row"))
        out, run = None, 1.0
        for w, mu, sd in reversed(list(zip(m.weights, m.means, m.stds))):
            run -= w
            x = mu + sd * z
            out = x if out is None else F.when(u >= run + w, out).otherwise(x)
        return F.greatest(F.lit(lo), F.least(F.lit(hi), out))


def level_laws(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """Laws of all columns from one count and one pass of running totals."""
    laws = materialise(interval_table(level_counts(df, cols).where("value is not null"), ["column"], "value", "n"))
    return {c: laws.where(F.col("column") == c).drop("column") for c in cols}


def fit_independent(df: DataFrame, spec: TableSpec, parts: int = 5) -> Independent:
    st = column_stats(df, spec.numeric) if spec.numeric else {}
    mixes = {c: (fit_mixture(df, c, parts), s["min"], s["max"]) for c, s in st.items()}
    cats = [*spec.categorical, *([spec.target] if spec.target and spec.task != "regression" else [])]
    return Independent(spec, level_laws(df, cats), mixes)


@dataclass
class UniformModel:
    spec: TableSpec
    ranges: dict[str, tuple[float, float, bool]]
    levels: dict[str, tuple[DataFrame, int]]

    def sample(self, spark, n: int, seed=0) -> DataFrame:
        df = blank(spark, n)
        for c, (table, k) in self.levels.items():
            df = df.withColumn("_code", F.least(F.floor(u01(seed, c, "row") * k), F.lit(k - 1)))
            df = df.join(table.select(F.col("code").alias("_code"), F.col("value").alias(c)), "_code").drop("_code")
        new = {}
        for c, (lo, hi, whole) in self.ranges.items():
            u = u01(seed, c, "row")
            new[c] = (lo + F.floor(u * (hi - lo + 1))).cast("long") if whole else lo + u * (hi - lo)
        return df.withColumns(new)


def fit_uniform(df: DataFrame, spec: TableSpec) -> UniformModel:
    st = column_stats(df, spec.numeric)
    whole = {f.name: f.dataType.typeName() in ("integer", "long", "short", "byte") for f in df.schema}
    codes = fit_labels(df, spec.categorical)
    sizes = {r["column"]: r["size"] for r in cardinalities(df, spec.categorical).collect()}
    return UniformModel(spec, {c: (s["min"], s["max"], whole[c]) for c, s in st.items()},
                        {c: (codes.table.where(F.col("column") == c), sizes[c]) for c in spec.categorical})


def identity(df: DataFrame) -> DataFrame:
    return df


# --- Gaussian copula ----------------------------------------------------------------

@dataclass
class Copula:
    """Quantile knots of numeric columns, level intervals of categorical ones, and the Cholesky
    factor of the correlation of their normal scores."""

    spec: TableSpec
    cols: tuple[str, ...]
    knots: dict[str, list[float]]
    laws: dict[str, DataFrame]
    factor: np.ndarray
    decimals: dict[str, int]

    def sample(self, spark, n: int, seed=0) -> DataFrame:
        df = blank(spark, n).withColumns({f"_z{j}": normal(u01(seed, f"z{j}a", "row"), u01(seed, f"z{j}b", "row")) for j in range(len(self.cols))})
        us = {}
        for i, c in enumerate(self.cols):
            x = F.lit(0.0)
            for j in range(i + 1):
                x = x + float(self.factor[i, j]) * F.col(f"_z{j}")
            us[f"_p{i}"] = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), normal_cdf(x)))
        df = materialise(df.select("row", *[u.alias(p) for p, u in us.items()]))  # one plan with the draws is too large to be compiled
        for i, c in enumerate(self.cols):
            if c in self.laws:
                df = draw(df, self.laws[c], [], "value", F.col(f"_p{i}"), c)
            else:
                df = df.withColumn(c, F.round(_at_knots(F.col(f"_p{i}"), self.knots[c]), self.decimals[c]))
        return df.select("row", *self.cols)


def _at_knots(p: Column, knots: list[float]) -> Column:
    """Linear interpolation of the quantile function."""
    m = len(knots) - 1
    arr, pos = F.array(*[F.lit(v) for v in knots]), F.least(F.floor(p * m), F.lit(m - 1)).cast("int")
    a, b = F.element_at(arr, pos + 1), F.element_at(arr, pos + 2)
    return a + (b - a) * (p * m - pos)


def _share_below(x: Column, knots: list[float]) -> Column:
    """Inverse of `_at_knots`, at the middle of ties, kept inside (0, 1)."""
    m = len(knots) - 1
    arr = F.array(*[F.lit(v) for v in knots])
    below, upto = F.size(F.filter(arr, lambda k: k < x)), F.size(F.filter(arr, lambda k: k <= x))
    a, b = F.element_at(arr, F.greatest(below, F.lit(1))), F.element_at(arr, F.least(below + 1, F.lit(m + 1)))
    between = below - 1 + F.coalesce(F.try_divide(x - a, b - a), F.lit(0.0))
    p = F.when(upto > below, (below + upto - 1) / 2.0).otherwise(between) / m
    return F.greatest(F.lit(0.5 / m), F.least(F.lit(1 - 0.5 / m), p))


def fit_copula(df: DataFrame, spec: TableSpec, knots: int = 100, decimals: int = 2) -> Copula:
    cats = [*spec.categorical, *([spec.target] if spec.target and spec.task != "regression" else [])]
    nums = [*spec.numeric, *([spec.target] if spec.target and spec.task == "regression" else [])]
    df = materialise(df.select(*cats, *nums))  # read once per fitted step
    probs = [i / knots for i in range(knots + 1)]
    grid = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 100 * knots).alias(c) for c in nums]).first().asDict() if nums else {}
    laws = level_laws(df, cats)
    scored = df.select(*[F.col(c) for c in cats], *[normal_quantile(_share_below(F.col(c).cast("double"), grid[c])).alias(f"_s_{c}") for c in nums])
    for c in cats:
        mid = laws[c].groupBy("value").agg(((F.min("_lo") + F.max("_hi")) / 2).alias("_m")).select(F.lit(c).alias("column"), "value", normal_quantile(F.col("_m")).alias("s"))
        scored = look_up(scored, mid, c, {"s": f"_s_{c}"})
    cols = [*cats, *nums]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i)]
    r = scored.agg(*[F.corr(f"_s_{cols[i]}", f"_s_{cols[j]}").alias(f"c{i}_{j}") for i, j in pairs], F.count("*").alias("n")).first()
    m = np.eye(len(cols))
    for i, j in pairs:
        v = r[f"c{i}_{j}"]
        m[i, j] = m[j, i] = 0.0 if v is None or math.isnan(v) else v
    vals, vecs = np.linalg.eigh(m)
    m = (vecs * np.maximum(vals, 1e-8)) @ vecs.T
    scale = np.sqrt(np.diag(m))
    return Copula(spec, tuple(cols), grid, laws, np.linalg.cholesky(m / np.outer(scale, scale)), {c: decimals for c in nums})


# --- Bayesian networks --------------------------------------------------------------

@dataclass
class Coded:
    """A table of small whole codes and the way back to values."""

    df: DataFrame
    cols: tuple[str, ...]
    sizes: dict[str, int]
    bins: Bins | None
    codes: Codes | None

    def decode(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumns({c: F.col(c).cast("string") for c in (self.codes.cols if self.codes else ())})
        if self.codes:
            out = self.codes.inverse(out)
        return self.bins.inverse(out) if self.bins else out


def code_table(df: DataFrame, spec: TableSpec, bins: Bins | None) -> Coded:
    cats = [*spec.categorical, *([spec.target] if spec.target and spec.task != "regression" else [])]
    codes = fit_labels(df, cats) if cats else None
    out = bins.transform(df) if bins else df
    out = codes.transform(out) if codes else out
    cols = [*cats, *(bins.edges if bins else ())]
    sizes = {r["column"]: r["size"] for r in cardinalities(df, cats).collect()} if cats else {}
    sizes |= {c: bins.n for c in bins.edges} if bins else {}
    return Coded(out.select(*[F.col(c).cast("int").alias(c) for c in cols]), tuple(cols), sizes, bins, codes)


def spanning_tree(cols: Sequence[str], weights: Mapping[tuple[str, str], float]) -> list[tuple[str, str | None]]:
    """Maximum spanning tree as (column, parent) in sampling order."""
    w = lambda a, b: weights.get((a, b), weights.get((b, a), 0.0))
    order, left = [(cols[0], None)], set(cols[1:])
    while left:
        a, b = max(((p, c) for p, _ in order for c in left), key=lambda e: (w(*e), -cols.index(e[0]), -cols.index(e[1])))
        order.append((b, a))
        left.remove(b)
    return order


@dataclass
class Network:
    """Conditional tables in sampling order: (column, parents as (column, level, table of steps), law)."""

    coded: Coded
    nodes: list[tuple[str, list[tuple[str, int]], DataFrame]]
    parent_code: Callable[[str, int], Column]

    def sample(self, n: int, seed=0) -> DataFrame:
        df = blank(self.coded.df.sparkSession, n)
        for c, parents, law in self.nodes:
            names = [f"_p{i}" for i in range(len(parents))]
            df = df.withColumns({nm: self.parent_code(p, lvl).cast("int") for nm, (p, lvl) in zip(names, parents)})
            df = draw(df, law, names, "_x", u01(seed, f"node-{c}", "row"), c).drop(*names)
        return self.coded.decode(df.select("row", *self.coded.cols))


def fit_tree_network(df: DataFrame, spec: TableSpec, bins: int = 15) -> Network:
    """Chow-Liu tree over equal-width bins."""
    coded = code_table(df, spec, fit_bins(df, spec.numeric, bins) if spec.numeric else None)
    mi = {(r["a"], r["b"]): r["mi"] for r in dependence(coded.df, coded.cols).select("a", "b", "mi").collect()}
    nodes = []
    for c, p in spanning_tree(coded.cols, mi):
        by = [F.col(p).alias("_p0")] if p else []
        counts = coded.df.groupBy(*by, F.col(c).alias("_x")).agg(F.count("*").alias("n"))
        nodes.append((c, [(p, 0)] if p else [], materialise(interval_table(counts, ["_p0"] if p else [], "_x", "n"))))
    return Network(coded, nodes, lambda c, lvl: F.col(c))


def _grid(spark, sizes: Sequence[int], names: Sequence[str]) -> DataFrame:
    """All cells of a code grid, spread over the cluster."""
    df, step = spark.range(math.prod(sizes)), math.prod(sizes)
    for s, n in zip(sizes, names):
        step //= s
        df = df.withColumn(n, (F.floor(F.col("id") / step) % s).cast("int"))
    return df.drop("id")


def _smoothed(cells: DataFrame, parents: Sequence[str], weight: str) -> DataFrame:
    """Negative noisy counts become zero; a parent cell left with nothing becomes uniform."""
    cells = materialise(cells.withColumn(weight, F.greatest(F.col(weight), F.lit(0.0))))
    if not parents:
        return cells.withColumn(weight, F.when(cells.agg(F.sum(weight)).scalar() > 0, F.col(weight)).otherwise(1.0))
    totals = cells.groupBy(*parents).agg(F.sum(weight).alias("_t"))
    return cells.join(totals, list(parents)).withColumn(weight, F.when(F.col("_t") > 0, F.col(weight)).otherwise(1.0)).drop("_t")


@dataclass
class Taxonomy:
    """Levels of each coded column: binary for bins, nested groups of four for categories."""

    sizes: dict[str, int]
    binary: set

    def depth(self, c: str) -> int:
        return int(math.log2(self.sizes[c])) if c in self.binary else max(1, math.ceil(self.sizes[c] / 4))

    def width(self, c: str, level: int) -> int:
        return self.sizes[c] // 2**level if c in self.binary else min(self.sizes[c], 4 * (self.depth(c) - level) + (1 if level else 0))

    def parent(self, c: str, level: int) -> Column:
        if not level:
            return F.col(c)
        return F.floor(F.col(c) / 2**level) if c in self.binary else F.least(F.col(c), F.lit(4 * (self.depth(c) - level)))


def parent_sets(columns: Sequence[str], tax: Taxonomy, cells: float) -> list[tuple[tuple[str, int], ...]]:
    """Sets of (column, level) with at most `cells` cells that no other allowed set refines.

    A walk from column to column, each left out or taken at a level from coarse to fine. A branch ends where
    the cells exceed the bound, and where some column could still be refined even if all later columns were
    taken at their finest level, since no set below it is then a maximal one. The work follows the number of
    sets within the bound, not the product of all levels.
    """
    widths = [[1, *(tax.width(c, lv) for lv in range(tax.depth(c) - 1, -1, -1))] for c in columns]
    later = [1] * (len(columns) + 1)
    for i in range(len(columns) - 1, -1, -1):
        later[i] = later[i + 1] * widths[i][-1]
    out, open_sets = [], [((), 1)]
    while open_sets:
        taken, used = open_sets.pop()
        i = len(taken)
        if any(t + 1 < len(w) and used // w[t] * w[t + 1] * later[i] <= cells for t, w in zip(taken, widths)):
            continue
        if i == len(columns):
            out.append(tuple((c, tax.depth(c) - t) for c, t in zip(columns, taken) if t))
            continue
        open_sets += [((*taken, t), used * w) for t, w in enumerate(widths[i]) if used * w <= cells]
    return out


def dependence_scores(cells: DataFrame, cands: Sequence[tuple[str, tuple[tuple[str, int], ...]]], tax: Taxonomy, batch: int = 64) -> list[float]:
    """Half the L1 distance between the joint of (column, parents) and the product of its margins,
    for all candidates, from the table of distinct coded rows with counts."""
    out: dict[int, float] = {}
    for start in range(0, len(cands), batch):
        arms = [F.struct(F.lit(start + i).alias("k"), F.col(x).alias("x"), F.concat_ws("|", F.lit(""), *[tax.parent(c, lv).cast("string") for c, lv in ps]).alias("p"))
                for i, (x, ps) in enumerate(cands[start:start + batch])]
        j = cells.select("n", F.explode(F.array(*arms)).alias("z")).select("z.*", "n").groupBy("k", "x", "p").agg(F.sum("n").cast("double").alias("n"))
        nx = j.groupBy("k", "x").agg(F.sum("n").alias("nx"))
        np_ = j.groupBy("k", "p").agg(F.sum("n").alias("np"))
        t = j.groupBy("k").agg(F.sum("n").alias("t"))
        m = j.join(nx, ["k", "x"]).join(np_, ["k", "p"]).join(F.broadcast(t), "k")
        q = F.col("nx") * F.col("np") / (F.col("t") * F.col("t"))
        s = m.groupBy("k").agg(((F.sum(F.abs(F.col("n") / F.col("t") - q)) + 1 - F.sum(q)) / 2).alias("s"))
        out |= {r["k"]: r["s"] for r in s.collect()}  # one number per candidate
    return [out[i] for i in range(len(cands))]


def _known_bins(spec: TableSpec, bounds: Mapping[str, tuple[float, float]] | None, bins: int, epsilon: float = 0.0) -> Bins | None:
    missing = set(spec.numeric) - set(bounds or {})
    if missing:
        raise ValueError(f"bounds required for {sorted(missing)}")
    return Bins({c: bounds[c] for c in spec.numeric}, bins, epsilon) if spec.numeric else None


def fit_private_network(df: DataFrame, spec: TableSpec, epsilon: float, *, bounds: Mapping[str, tuple[float, float]] | None = None, theta: float = 20.0, depth: int = 4,
                        ledger: Ledger | None = None, seed=None) -> Network:
    """Bayesian network chosen greedily by the exponential mechanism with half of the budget and
    noisy marginals with the other half. Parent sets may use generalised columns and are bounded by
    epsilon * n / (4 * d * theta) cells. `bounds` of the numeric columns are given, since bins read from
    the data would leak them; the number of rows and the lists of levels count as known."""
    known = _known_bins(spec, bounds, 2**depth, 1e-8)
    spend(ledger, epsilon)
    rng = generator(seed)
    coded = code_table(df, spec, known)
    tax = Taxonomy(coded.sizes, set(spec.numeric))
    joint = materialise(coded.df.groupBy(*coded.cols).agg(F.count("*").alias("n")))
    n, d = joint.agg(F.sum("n")).first()[0], len(coded.cols)
    bound = epsilon * n / (4 * d * theta)
    sens = 3 / n + 2 / n**2
    chosen, left, picked = [], list(coded.cols), []
    for step in range(d):
        cands = []
        for x in left:
            sets = parent_sets(picked, tax, bound / tax.width(x, 0)) if picked and bound >= tax.width(x, 0) else [()]
            cands += [(x, ps) for ps in sets or [()]]
        if step == 0:
            best = int(rng.integers(len(cands)))  # no parents yet: all scores are zero
        else:
            s = np.array(dependence_scores(joint, cands, tax))
            best = int((s * (0.5 * epsilon / max(1, d - 1)) / (2 * sens) + rng.gumbel(size=len(s))).argmax())
        chosen.append(cands[best])
        picked.append(cands[best][0])
        left.remove(cands[best][0])
    u_seed, nodes = (seed if seed is not None else secret_seed()), []
    for x, ps in chosen:
        names = [f"_p{i}" for i in range(len(ps))]
        counts = joint.select(*[tax.parent(c, lv).cast("int").alias(nm) for nm, (c, lv) in zip(names, ps)], F.col(x).alias("_x"), "n")
        counts = counts.groupBy(*names, "_x").agg(F.sum("n").alias("n"))
        cells = _grid(df.sparkSession, [*[tax.width(c, lv) for c, lv in ps], tax.width(x, 0)], [*names, "_x"])
        noisy = cells.join(counts, [*names, "_x"], "left").withColumn(
            "n", F.coalesce("n", F.lit(0)) + laplace_draw(u01(u_seed, f"margin-{x}", *names, "_x"), 4.0 * d / epsilon))
        nodes.append((x, list(ps), materialise(interval_table(_smoothed(noisy, names, "n"), names, "_x", "n"))))
    return Network(coded, nodes, tax.parent)


def zcdp_rho(epsilon: float, delta: float) -> float:
    """Largest concentrated-privacy rho that implies (epsilon, delta).

    For rho the failure probability is the minimum over t > 0 of exp(t ((1 + t) rho - epsilon)) (t / (1 + t))^(1 + t) / t
    (the order of the divergence is 1 + t). The minimum is looked up on a grid of ln t that narrows around it.
    """

    def log_failure(rho: float) -> float:
        lo, hi = math.log(1e-6), math.log(10 * (epsilon + 1) / rho + 10)
        for _ in range(6):
            x = np.linspace(lo, hi, 201)
            t = np.exp(x)
            y = t * ((1 + t) * rho - epsilon) + (1 + t) * (x - np.log1p(t)) - x
            i = int(y.argmin())
            lo, hi = x[max(0, i - 1)], x[min(200, i + 1)]
        return float(min(0.0, y.min()))

    low, high = -60.0, math.log(epsilon + 1)  # of ln rho; the failure probability rises with rho
    while high - low > 1e-12:
        mid = (low + high) / 2
        low, high = (mid, high) if log_failure(math.exp(mid)) <= math.log(delta) else (low, mid)
    return math.exp(low)


@dataclass
class MergedNetwork(Network):
    """A network over merged codes; `members` (column, code, place, value) lists the codes behind each of them."""

    members: DataFrame

    def sample(self, n: int, seed=0) -> DataFrame:
        df = blank(self.coded.df.sparkSession, n)
        for c, parents, law in self.nodes:
            names = [f"_p{i}" for i in range(len(parents))]
            df = df.withColumns({nm: F.col(p) for nm, (p, _) in zip(names, parents)})
            df = draw(df, law, names, "_x", u01(seed, f"node-{c}", "row"), c).drop(*names)
        held = {(r["column"], r["code"]): r["n"] for r in self.members.groupBy("column").agg(F.max_by("code", "place").alias("code"), F.max("place").alias("n")).collect()}
        for (c, code), size in held.items():  # one merged code a column
            m = self.members.where(F.col("column") == c).select(F.col("code").alias(c), F.col("place").alias("_place"), F.col("value").alias("_value"))
            place = F.when(F.col(c) == code, pick(u01(seed, f"member-{c}", "row"), F.lit(size))).otherwise(F.lit(1))
            df = df.withColumn("_place", place.cast("long")).join(m, [c, "_place"]).drop(c, "_place").withColumnRenamed("_value", c)
        return self.coded.decode(df.select("row", *self.coded.cols))


def merged_codes(noisy: DataFrame, threshold: float) -> DataFrame:
    """(column, code, place, value): codes of `threshold` or more, numbered from 0 in each column; those below it
    share the next number and are placed from 1 on."""
    rows = noisy.withColumn("_kept", F.col("n") >= threshold)
    ranked = global_rank(rows, ["value"], by=["column", "_kept"], rank="_r")
    kept = rows.groupBy("column").agg(F.count_if("_kept").alias("_k"))
    code = F.when(F.col("_kept"), F.col("_r") - 1).otherwise(F.col("_k"))
    return ranked.join(kept, "column").select("column", code.cast("int").alias("code"), F.when(F.col("_kept"), 1).otherwise(F.col("_r")).cast("long").alias("place"), "value")


def fit_private_tree(df: DataFrame, spec: TableSpec, epsilon: float, delta: float = 1e-9, *, bounds: Mapping[str, tuple[float, float]] | None = None, bins: int = 16,
                     ledger: Ledger | None = None, seed=None) -> MergedNetwork:
    """Noisy one-way marginals, rare codes merged, a private spanning tree over the pairs the one-way
    model misses most, noisy two-way marginals on the tree.

    Merged codes are a written table and rows take theirs by joins, so a column may have any number of levels; the
    driver sees one number a column and one a pair of columns. `bounds` of the numeric columns are given; the number
    of rows and the lists of levels count as known.
    """
    known = _known_bins(spec, bounds, bins)
    spend(ledger, epsilon, delta)
    rng, u_seed = generator(seed), (seed if seed is not None else secret_seed())
    spark = df.sparkSession
    coded = code_table(df, spec, known)
    rho, d = zcdp_rho(epsilon, delta), len(coded.cols)
    s1 = math.sqrt(d / (2 * rho / 3))  # a third of rho for d counts of sensitivity one
    one = long_values(coded.df, coded.cols, dtype="int").groupBy("column", "value").agg(F.count("*").alias("n"))
    noisy = None
    for c in coded.cols:
        g = _grid(spark, [coded.sizes[c]], ["value"]).withColumn("column", F.lit(c))
        noisy = g if noisy is None else noisy.unionByName(g)
    noise = normal(u01(u_seed, "m1", "column", "value"), u01(u_seed, "m2", "column", "value")) * s1
    noisy = materialise(noisy.join(one, ["column", "value"], "left").select("column", "value", (F.coalesce("n", F.lit(0)) + noise).alias("n")))
    members = materialise(merged_codes(noisy, 3 * s1))
    width = {r["column"]: r["n"] for r in members.groupBy("column").agg((F.max("code") + 1).alias("n")).collect()}
    small = coded.df
    for c in coded.cols:
        m = members.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias("_code"))
        small = small.join(m, c).drop(c).withColumnRenamed("_code", c)
    small = materialise(small.select(*coded.cols))  # rows with a null feature are left out
    share = noisy.groupBy("column").agg(F.sum(F.greatest("n", F.lit(0.0))).alias("t"))
    marg = noisy.join(members, ["column", "value"]).join(share, "column").groupBy("column", "code").agg(F.sum(F.greatest("n", F.lit(0.0)) / F.col("t")).alias("p"))
    marg = materialise(marg)
    size = small.count()
    pc = _pair_table(small, coded.cols)
    j = pc.join(marg.select(F.col("column").alias("a"), F.col("code").alias("va"), F.col("p").alias("pa")), ["a", "va"]).join(
        marg.select(F.col("column").alias("b"), F.col("code").alias("vb"), F.col("p").alias("pb")), ["b", "vb"])
    q = F.col("pa") * F.col("pb") * float(size)
    score = j.groupBy("a", "b").agg((F.sum(F.abs(F.col("n") - q)) + float(size) - F.sum(q)).alias("s"))
    err = {(r["a"], r["b"]): r["s"] for r in score.collect()}  # d(d-1)/2 numbers
    eps_edge = math.sqrt(8 * (rho / 3) / max(1, d - 1))
    order, left = [(coded.cols[0], None)], set(coded.cols[1:])
    while left:
        edges = sorted((p, c) for p, _ in order for c in left)
        s = np.array([err.get((a, b), err.get((b, a), 0.0)) for a, b in edges])
        a, b = edges[int((s * eps_edge / 2 + rng.gumbel(size=len(s))).argmax())]
        order.append((b, a))
        left.remove(b)
    s2, nodes = math.sqrt(max(1, d - 1) / (2 * rho / 3)), []
    for c, p in order:
        xs, names = ([p, c], ["_p0", "_x"]) if p else ([c], ["_x"])
        cells = _grid(spark, [width[x] for x in xs], names)
        counts = small.groupBy(*[F.col(x).alias(nm) for x, nm in zip(xs, names)]).agg(F.count("*").alias("n"))
        z = normal(u01(u_seed, f"t1-{c}", *names), u01(u_seed, f"t2-{c}", *names)) * (s2 if p else s1)
        law = _smoothed(cells.join(counts, names, "left").withColumn("n", F.coalesce("n", F.lit(0)) + z), names[:-1], "n")
        nodes.append((c, [(p, 0)] if p else [], materialise(interval_table(law, names[:-1], "_x", "n"))))
    return MergedNetwork(coded, nodes, lambda c, lv: F.col(c), members)


def _pair_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb"))
                      for i, a in enumerate(cols) for b in cols[i + 1:]])
    return df.select(F.explode(cells).alias("x")).select("x.*").groupBy("a", "b", "va", "vb").agg(F.count("*").alias("n"))


# --- conditional draws --------------------------------------------------------------

def condition_rows(df: DataFrame, spec: TableSpec, n: int, *, log_frequency: bool = True, seed=0, frequencies: DataFrame | None = None) -> DataFrame:
    """(row, column, value, key): per request a random categorical column, a level of it by
    (log-)frequency, and a random real row that has it. Real rows are numbered inside each
    level by ranges, so a hot level is not ordered by one task."""
    cats = list(spec.categorical)
    df = materialise(df.select(spec.key, *cats))  # read by several steps
    freq = frequencies if frequencies is not None else level_counts(df, cats).where("value is not null").withColumnRenamed("n", "freq")
    freq = materialise(freq)
    weight = F.log(F.col("freq") + 1) if log_frequency else F.col("freq").cast("double")
    law = interval_table(freq.withColumn("w", weight).select("column", "value", "w"), ["column"], "value", "w")
    ask = blank(df.sparkSession, n).withColumn("column", F.element_at(F.array(*[F.lit(c) for c in cats]), pick(u01(seed, "col", "row"), F.lit(len(cats))).cast("int")))
    ask = draw(ask, law, ["column"], "value", u01(seed, "level", "row"), "value")
    long = materialise(long_values(df, cats, keep=[spec.key]).where("value is not null"))
    ranked = global_rank(long, [spec.key], by=["column", "value"], rank="_r")
    sizes = long.groupBy("column", "value").agg(F.count("*").alias("_size"))
    ask = ask.join(sizes, ["column", "value"]).withColumn("_r", pick(u01(seed, "real", "row"), F.col("_size"))).drop("_size")
    return ask.join(ranked, ["column", "value", "_r"]).drop("_r")


def condition_columns(df: DataFrame, spec: TableSpec, n: int, *, small: int = 100, **kw) -> DataFrame:
    """Condition rows, or uniform real rows when the table has fewer than `small` rows."""
    if df.limit(small).count() >= small:
        return condition_rows(df, spec, n, **kw)
    even = level_counts(df, spec.categorical).where("value is not null").withColumn("freq", F.lit(1.0)).drop("n")
    return condition_rows(df, spec, n, frequencies=even, **{**kw, "log_frequency": False})


def clean_sample(df: DataFrame, numeric: Sequence[str], soft: Mapping[str, Sequence[str]]) -> DataFrame:
    """Clip generated numbers to [0, 1] and turn soft one-hot groups into their largest entry.
    soft: new column -> its indicator columns, whose position gives the code."""
    out = df.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in numeric})
    for c, parts in soft.items():
        arr = F.array(*[F.col(p) for p in parts])
        out = out.withColumn(c, (F.array_position(arr, F.array_max(arr)) - 1).cast("int")).drop(*parts)
    return out


def per_class(df: DataFrame, spec: TableSpec, n: int, kind: str = "share", seed=0) -> DataFrame:
    """Class quotas, then independent draws from each class's own level frequencies and, for numeric
    columns, from its real values; the class is attached to the drawn rows. All classes in one job."""
    counts = {r[spec.target]: r["quota"] for r in quotas(df, spec.target, n, kind).orderBy(spec.target).collect()}  # one row per class
    ask = requests(df.sparkSession, counts, spec.target, df.schema[spec.target].dataType.simpleString())
    long = materialise(long_values(df, spec.categorical, keep=[spec.target]).where("value is not null").groupBy(spec.target, "column", "value").agg(F.count("*").alias("n")))
    laws = materialise(interval_table(long, ["column", spec.target], "value", "n"))
    for c in spec.categorical:
        law = laws.where(F.col("column") == c).drop("column")
        ask = draw(ask, law, [spec.target], "value", u01(seed, f"level-{c}", "row"), c)
    if spec.numeric:
        ranked = global_rank(df.select(spec.key, spec.target, *spec.numeric), [spec.key], by=[spec.target], rank="_r")
        size = df.groupBy(spec.target).agg(F.count("*").alias("_size"))
        ask = ask.join(F.broadcast(size), spec.target)
        for c in spec.numeric:
            ask = ask.withColumn("_r", pick(u01(seed, f"value-{c}", "row"), F.col("_size")))
            ask = ask.join(ranked.select(spec.target, "_r", c), [spec.target, "_r"]).drop("_r")
        ask = ask.drop("_size")
    return ask


def typed_adapter(df: DataFrame, spec: TableSpec, generate: Callable[[DataFrame], DataFrame], ids: Sequence[str] = ()) -> DataFrame:
    """Run a generator that only knows numbers: nulls and foreign types are refused, categories are
    coded and decoded, id columns are carried over by row number. `generate` gets and returns
    `_row` plus the feature columns."""
    known = {"integer", "long", "double", "float", "string", "boolean", "short", "byte", "decimal"}
    bad = [f.name for f in df.schema if f.name in spec.features and f.dataType.typeName() not in known]
    if bad:
        raise ValueError(f"unsupported column types: {bad}")
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in spec.features]).first()
    if any(nulls):
        raise ValueError("nulls are not supported")
    codes = fit_labels(df, spec.categorical)
    ranked = global_rank(df.select(spec.key, *[c for c in ids if c != spec.key], *spec.features), [spec.key], rank="_row")
    made = generate(codes.transform(ranked.select("_row", *spec.features)))
    made = made.withColumns({c: F.col(c).cast("string") for c in spec.categorical})
    carried = ranked.select("_row", *dict.fromkeys([spec.key, *ids]))
    return codes.inverse(made).join(carried, "_row").drop("_row")
