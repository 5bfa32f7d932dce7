"""Differentially private models. Spark computes the sufficient statistics of the clipped rows,
noise goes onto them, and the driver only solves the small system they define."""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import noise
from tabloom.functions.draws import permute_and_flip
from tabloom.functions.rng import secret_seed, u01
from tabloom.operators.clean import clip, clip_to_norm
from tabloom.operators.ledger import Ledger, spend
from tabloom.operators.private import covariance
from tabloom.operators.split import partitions

Bounds = dict[str, tuple[float, float]]


def generator(seed) -> np.random.Generator:
    """Driver-side draws for d x d matrices: seeded, or from operating-system entropy."""
    digest = secrets.token_bytes(32) if seed is None else hashlib.sha256(str(seed).encode()).digest()
    return np.random.default_rng(np.frombuffer(digest, dtype=np.uint32))


def _laplace(rng, scale, size=None):
    return rng.laplace(0.0, scale, size) if scale > 0 else (0.0 if size is None else np.zeros(size))


def _clipped(bounds: Bounds) -> dict[str, Column]:
    return {c: clip(F.col(c).cast("double"), *b) for c, b in bounds.items()}


def _dot(weights, cols: dict[str, Column] | Sequence[Column]) -> Column:
    cols = list(cols.values()) if isinstance(cols, dict) else list(cols)
    out = F.lit(0.0)
    for w, c in zip(weights, cols):
        out = out + float(w) * c
    return out


@dataclass
class Linear:
    cols: tuple[str, ...]
    weights: np.ndarray
    intercept: float
    errors: np.ndarray | None = None

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, _dot(self.weights, [F.col(c) for c in self.cols]) + self.intercept)

    def frame(self, spark) -> DataFrame:
        rows = [("intercept", float(self.intercept)), *zip(self.cols, map(float, self.weights))]
        return spark.createDataFrame(rows, "term string, weight double")


def linear_regression(df: DataFrame, bounds_x: Bounds, target: str, bounds_y, epsilon: float, *, ledger: Ledger | None = None, seed=None) -> Linear:
    """Functional mechanism: noisy coefficients of the squared-error polynomial, then one solve.

    With an intercept a third of the budget pays for the two column-mean releases.
    """
    spend(ledger, epsilon)
    rng, x = generator(seed), _clipped(bounds_x)
    cols, y = list(x), clip(F.col(target).cast("double"), *bounds_y)
    d, inf = len(cols), math.isinf(epsilon)
    names = [F.count("*").alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")]
    for i, a in enumerate(cols):
        names += [F.sum(x[a]).alias(f"s{i}"), F.sum(x[a] * y).alias(f"t{i}")]
        names += [F.sum(x[a] * x[b]).alias(f"g{i}_{j}") for j, b in enumerate(cols) if j >= i]
    r = df.agg(*names).first()
    n = r["n"]
    e_mean, e = (0.0, 0.0) if inf else (epsilon / 3 / (d + 1), epsilon * 2 / 3)
    wid = np.array([b[1] - b[0] for b in bounds_x.values()])
    wy = bounds_y[1] - bounds_y[0]
    m = np.array([r[f"s{i}"] / n for i in range(d)]) + (0 if inf else np.array([_laplace(rng, w / n / e_mean) for w in wid]))
    my = r["y"] / n + (0 if inf else _laplace(rng, wy / n / e_mean))
    g, t = np.zeros((d, d)), np.zeros(d)
    # statistics of the centred table follow from the raw ones
    s = np.array([r[f"s{i}"] for i in range(d)])
    for i in range(d):
        t[i] = r[f"t{i}"] - m[i] * r["y"] - my * s[i] + n * m[i] * my
        for j in range(i, d):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] - m[i] * s[j] - m[j] * s[i] + n * m[i] * m[j]
    if not inf:
        share = e / (d + d * (d + 1) / 2)
        for i in range(d):
            t[i] += _laplace(rng, 2 * wid[i] * wy / share)
            for j in range(i, d):
                z = _laplace(rng, (1 if i == j else 2) * wid[i] * wid[j] / share)
                g[i, j] += z
                g[j, i] = g[i, j]
        vals, vecs = np.linalg.eigh(g)  # a noisy Gram matrix need not be positive
        floor = 1e-6 * max(abs(vals).max(), 1e-12)
        g = (vecs * np.maximum(vals, floor)) @ vecs.T
    w = np.linalg.solve(g, t)
    return Linear(tuple(cols), w, float(my - m @ w))


def regression_from_covariance(cov: dict[tuple[str, str], float], x: Sequence[str], y: str, n: int, means: dict[str, float] | None = None) -> Linear:
    """Solve a regression from a released covariance matrix, with standard errors."""
    c = lambda a, b: cov[(a, b)] if (a, b) in cov else cov[(b, a)]
    g = np.array([[c(a, b) for b in x] for a in x])
    t = np.array([c(a, y) for a in x])
    inv = np.linalg.pinv(g)
    w = inv @ t
    rest = max(0.0, c(y, y) - t @ w) * (n - 1) / max(1, n - len(x) - 1)
    errors = np.sqrt(np.maximum(0.0, np.diag(inv)) * rest / max(1, n - 1))
    b0 = means[y] - sum(w[i] * means[a] for i, a in enumerate(x)) if means else 0.0
    return Linear(tuple(x), w, float(b0), errors)


def covariance_regression(df: DataFrame, bounds: Bounds, x: Sequence[str], y: str, epsilon: float, *, ledger=None, seed=None) -> Linear:
    n = df.count()
    rows = covariance(df, bounds, epsilon, ledger=ledger, seed=seed).collect()  # d(d+1)/2 numbers
    return regression_from_covariance({(r["a"], r["b"]): r["value"] for r in rows}, x, y, n)


@dataclass
class NaiveBayes:
    cols: tuple[str, ...]
    classes: list
    prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Class of the largest joint log likelihood; one expression per class."""
        scores = []
        for i, c in enumerate(self.classes):
            s = F.lit(float(math.log(self.prior[i])))
            for j, a in enumerate(self.cols):
                z = F.col(a) - float(self.mean[i, j])
                s = s - z * z / float(2 * self.var[i, j]) - float(0.5 * math.log(2 * math.pi * self.var[i, j]))
            scores.append(F.struct(s.alias("s"), F.lit(c).alias("c")))
        return df.withColumn(out, F.array_max(F.array(*scores))["c"])


def naive_bayes(df: DataFrame, bounds: Bounds, target: str, epsilon: float, *, smoothing: float = 1e-9, ledger=None, seed=None) -> NaiveBayes:
    """A third of the budget each for class counts, means and variances; counts are shifted to add up."""
    spend(ledger, epsilon)
    rng, x = generator(seed), _clipped(bounds)
    aggs = [F.count("*").alias("n")]
    for c, v in x.items():
        aggs += [F.avg(v).alias(f"m_{c}"), F.var_pop(v).alias(f"v_{c}")]
    rows = df.groupBy(target).agg(*aggs).orderBy(target).collect()  # one row per class
    inf = math.isinf(epsilon)
    third = 1.0 if inf else epsilon / 3
    n = np.array([r["n"] for r in rows], dtype=float)
    if not inf:
        total, q = n.sum(), math.exp(-third)
        noisy = n + rng.geometric(1 - q, len(n)) - rng.geometric(1 - q, len(n))
        noisy = np.maximum(noisy + np.round((total - noisy.sum()) / len(n)), 1)
        noisy[noisy.argmax()] += total - noisy.sum()
        n = noisy
    mean, var = np.zeros((len(rows), len(x))), np.zeros((len(rows), len(x)))
    for j, (c, (lo, hi)) in enumerate(bounds.items()):
        w = hi - lo
        for i, r in enumerate(rows):
            e = third / len(x)
            mu = r[f"m_{c}"] + (0 if inf else _laplace(rng, w / n[i] / e))
            va = r[f"v_{c}"] + (0 if inf else _laplace(rng, (w / n[i]) ** 2 * max(n[i] - 1, 1) / e))
            mean[i, j], var[i, j] = min(max(mu, lo), hi), max(va, smoothing * (w * w / 4))
    return NaiveBayes(tuple(x), [r[target] for r in rows], n / n.sum(), mean, var)


def spread_centres(bounds: Bounds, k: int, seed) -> np.ndarray:
    """Starting centres that depend on the bounds only: the most spread of a few random sets."""
    rng = generator(seed)
    lo, hi = (np.array([b[i] for b in bounds.values()]) for i in (0, 1))
    best, gap = None, -1.0
    for _ in range(100):
        c = rng.random((k, len(lo)))
        d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        reach = min(d.min(), 2 * np.minimum(c, 1 - c).min()) if k > 1 else np.minimum(c, 1 - c).min()
        if reach > gap:
            best, gap = c, reach
    return lo + best * (hi - lo)


def k_means_rounds(epsilon: float, k: int, d: int, n: int, rho: float = 0.225) -> int:
    """Between 2 and 7 rounds, by how much budget one useful round needs."""
    if math.isinf(epsilon):
        return 7
    need = math.sqrt(500 * k**3 / n**2 * (d + (4 * d * rho * rho) ** (1 / 3)) ** 3)
    return int(max(2, min(7, epsilon / need)))


@dataclass
class Centres:
    cols: tuple[str, ...]
    points: np.ndarray

    def assign(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        options = []
        for i, p in enumerate(self.points):
            d = F.lit(0.0)
            for c, v in zip(self.cols, p):
                d = d + (F.col(c) - float(v)) * (F.col(c) - float(v))
            options.append(F.struct(d.alias("d"), F.lit(i).alias("i")))
        return df.withColumn(out, F.array_min(F.array(*options))["i"])


def k_means(df: DataFrame, bounds: Bounds, k: int, epsilon: float, *, start: np.ndarray | None = None, ledger=None, seed=None) -> Centres:
    """Noisy rounds of assign, count and sum; each round is one aggregate with k result rows."""
    spend(ledger, epsilon)
    rng, cols, inf = generator(seed), list(bounds), math.isinf(epsilon)
    data = df.select(*[v.alias(c) for c, v in _clipped(bounds).items()]).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    n, d = data.count(), len(cols)
    rounds = k_means_rounds(epsilon, k, d, n)
    points = start if start is not None else spread_centres(bounds, k, seed)
    share = 1.0 if inf else epsilon / rounds
    e_count = share / (1 + (4 * d * 0.225**2) ** (1 / 3))
    e_sum = (share - e_count) / d
    mid = np.array([(b[0] + b[1]) / 2 for b in bounds.values()])
    half = np.array([(b[1] - b[0]) / 2 for b in bounds.values()])
    for _ in range(rounds):
        g = Centres(tuple(cols), points).assign(data).groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col(c) - float(m)).alias(c) for c, m in zip(cols, mid)])
        got = {r["cluster"]: r for r in g.collect()}
        new = points.copy()
        for i in range(k):
            count = got[i]["n"] if i in got else 0
            sums = np.array([got[i][c] for c in cols]) if i in got else np.zeros(d)
            if not inf:
                q = math.exp(-e_count)
                count = max(1, count + rng.geometric(1 - q) - rng.geometric(1 - q))
                sums = sums + np.array([_laplace(rng, h / e_sum) for h in half])
            if count:
                new[i] = np.clip(mid + sums / count, mid - half, mid + half)
        points = new
    data.unpersist()
    return Centres(tuple(cols), points)


def bingham_vector(a: np.ndarray, rng, batch: int = 64) -> np.ndarray:
    """Unit vector with density proportional to exp(x' a x), sampled along the eigenvectors of a.

    With drops t_i = (largest eigenvalue) - (eigenvalue i) the density is exp(-sum t_i y_i^2). Candidates are
    normal vectors with variances b / (b + 2 t_i), scaled to length 1, where sum 1 / (b + 2 t_i) = 1; a
    candidate is kept with the ratio of the two densities over its largest value. Works in logarithms.
    """
    values, axes = np.linalg.eigh(a)
    drop, d = values[-1] - values, len(values)
    b = 1.0  # one drop is 0, so the sum is at least 1 here; it is convex and falls, so Newton comes from the left
    for _ in range(200):
        part = 1 / (b + 2 * drop)
        step = (part.sum() - 1) / (part * part).sum()
        b += step
        if step <= 1e-13 * b:
            break
    stretch = 1 + 2 * drop / b
    largest = (b - d + d * math.log(d / b)) / 2
    while True:
        y = rng.standard_normal((batch, d)) / np.sqrt(stretch)
        y2 = y * y / (y * y).sum(axis=1, keepdims=True)
        chance = d / 2 * np.log(y2 @ stretch) - y2 @ drop - largest
        for row in np.flatnonzero(np.log(rng.random(batch)) < chance)[:1]:
            return axes @ (y[row] / np.linalg.norm(y[row]))


@dataclass
class Components:
    cols: tuple[str, ...]
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        """Projections `pc_1`, `pc_2`, ..."""
        centred = [F.col(c) - float(m) for c, m in zip(self.cols, self.mean)]
        return df.withColumns({f"pc_{i + 1}": _dot(v, centred) for i, v in enumerate(self.vectors)})


def components(df: DataFrame, bounds: Bounds, k: int, epsilon: float, *, ledger=None, seed=None) -> Components:
    """Principal components: noisy eigenvalues of the Gram matrix, then one sampled direction
    after another in the space left over. One aggregate over the data."""
    spend(ledger, epsilon)
    rng, cols, inf = generator(seed), list(bounds), math.isinf(epsilon)
    x, d = _clipped(bounds), len(bounds)
    aggs = [F.count("*").alias("n"), *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(cols)]]
    aggs += [F.covar_pop(x[a], x[b]).alias(f"g{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    r = df.agg(*aggs).first()
    n = r["n"]
    mean = np.array([r[f"m{i}"] for i in range(d)])
    gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) * n
    norm2 = sum((b[1] - b[0]) ** 2 for b in bounds.values())
    if inf:
        vals, vecs = np.linalg.eigh(gram)
        order = vals.argsort()[::-1][:k]
        return Components(tuple(cols), mean, _oriented(vecs[:, order].T), vals[order] / max(1, n - 1))
    e_mean, e = epsilon / 3, epsilon * 2 / 3
    mean = mean + np.array([_laplace(rng, (b[1] - b[0]) / n / (e_mean / d)) for b in bounds.values()])
    share = e / (k + 1)
    values = np.sort(np.maximum(0.0, np.linalg.eigvalsh(gram) + _laplace(rng, 2 * norm2 / share, d)))[::-1][:k]
    basis, out = np.eye(d), []
    for _ in range(k):
        inner = basis.T @ gram @ basis * (share / (4 * norm2))
        v = basis @ (bingham_vector(inner, rng) if inner.shape[0] > 1 else np.array([1.0]))
        out.append(v)
        rest = basis - np.outer(v, v @ basis)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        basis = u[:, s > 1e-8][:, : d - len(out)]
    return Components(tuple(cols), mean, _oriented(np.array(out)), values / max(1, n - 1))


def _oriented(vectors: np.ndarray) -> np.ndarray:
    """Fix the sign so that the largest entry of a vector is positive."""
    return np.array([v * np.sign(v[np.abs(v).argmax()]) for v in vectors])


@dataclass
class Logistic:
    cols: tuple[str, ...]
    classes: list
    weights: np.ndarray  # one row per binary problem, intercept last
    data_norm: float

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        z = [_dot(w[:-1], [F.col(c) for c in self.cols]) + float(w[-1]) for w in self.weights]
        if len(self.classes) == 2:
            return df.withColumn(out, F.when(z[0] > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))
        return df.withColumn(out, F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(c).alias("c")) for s, c in zip(z, self.classes)]))["c"])


def logistic_regression(df: DataFrame, cols: Sequence[str], target: str, data_norm: float, epsilon: float, *, c: float = 1.0, steps: int = 12,
                        ledger=None, seed=None) -> Logistic:
    """Objective perturbation: a random linear term is added once to the regularised loss, which
    Newton steps then minimise. A step is one aggregate for all classes together."""
    spend(ledger, epsilon)
    rng, inf = generator(seed), math.isinf(epsilon)
    data = clip_to_norm(df.select(target, *[F.col(x).cast("double").alias(x) for x in cols]).dropna(), cols, data_norm).persist(StorageLevel.MEMORY_AND_DISK)
    n = data.count()
    classes = sorted(r[0] for r in data.select(target).distinct().limit(1001).collect())
    if len(classes) > 1000:
        raise ValueError("too many classes")
    problems = [classes[1]] if len(classes) == 2 else classes
    d = len(cols) + 1
    top = math.sqrt(data_norm**2 + 1)
    lam, share = 1.0 / (n * c), (0.0 if inf else epsilon / len(problems))
    b, ridge = np.zeros((len(problems), d)), lam
    if not inf:
        smooth = top * top / 4
        left = share - 2 * math.log(1 + smooth / (n * lam))
        if left <= 0:  # strengthen the ridge until half of the share is left
            ridge, left = smooth / (n * (math.exp(share / 4) - 1)), share / 2
        for i in range(len(problems)):
            v = rng.standard_normal(d)
            b[i] = v / np.linalg.norm(v) * rng.gamma(d, 2 * top / left)
    w = np.zeros((len(problems), d))
    x = [*[F.col(a) for a in cols], F.lit(1.0)]
    for _ in range(steps):
        aggs = []
        for i, cls in enumerate(problems):
            p = 1 / (1 + F.exp(-_dot(w[i], x)))
            e = p - (F.col(target) == cls).cast("double")
            aggs += [F.sum(e * v).alias(f"g{i}_{j}") for j, v in enumerate(x)]
            aggs += [F.sum(p * (1 - p) * x[j] * x[k]).alias(f"h{i}_{j}_{k}") for j in range(d) for k in range(j, d)]
        r, move = data.agg(*aggs).first(), 0.0
        for i in range(len(problems)):
            grad = np.array([r[f"g{i}_{j}"] for j in range(d)]) / n + b[i] / n + ridge * w[i]
            hess = np.array([[r[f"h{i}_{min(j, k)}_{max(j, k)}"] for k in range(d)] for j in range(d)]) / n + ridge * np.eye(d)
            step = np.linalg.solve(hess, grad)
            move = max(move, float(np.abs(step).max()))
            w[i] -= step
        if move < 1e-10:
            break
    data.unpersist()
    return Logistic(tuple(cols), classes, w, data_norm)


def tree_depth(numeric: int, categorical: int, most: int = 15) -> int:
    """Depth from the numbers of features alone: draws until half of the numeric ones are expected to have been
    picked, one more, and half of the categorical ones."""
    if not numeric:
        return max(1, min(most, categorical // 2))
    draws = 1 if numeric == 1 else math.ceil(math.log(0.5) / math.log1p(-1 / numeric))
    return min(most, draws + 1 + categorical // 2)


@dataclass
class Forest:
    trees: list
    labels: DataFrame

    def leaves(self, df: DataFrame, trees: Sequence[int] | None = None) -> Column:
        wanted = self.trees if trees is None else [self.trees[i] for i in trees]
        return F.array(*[_leaf(t) for t in wanted])

    def predict(self, df: DataFrame, key: str, out: str = "prediction") -> DataFrame:
        """Majority of the tree labels."""
        rows = df.select(key, F.posexplode(self.leaves(df)).alias("tree", "leaf")).join(F.broadcast(self.labels), ["tree", "leaf"])
        votes = rows.groupBy(key, "label").agg(F.count("*").alias("n"))
        return df.join(votes.groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias(out)), key)


def _grow(rng, domains: dict, depth: int, leaf: list) -> dict:
    if depth == 0:
        leaf.append(None)
        return {"leaf": len(leaf) - 1}
    c = list(domains)[rng.integers(len(domains))]
    dom = domains[c]
    if isinstance(dom, list):
        pick = list(rng.permutation(len(dom)))[: max(1, len(dom) // 2)]
        left = [dom[i] for i in sorted(pick)]
        right = [v for v in dom if v not in left] or left
        test, sides = ("in", left), (left, right)
    else:
        at = float(rng.uniform(*dom))
        test, sides = ("le", at), ((dom[0], at), (at, dom[1]))
    return {"col": c, "test": test, "yes": _grow(rng, {**domains, c: sides[0]}, depth - 1, leaf), "no": _grow(rng, {**domains, c: sides[1]}, depth - 1, leaf)}


def _leaf(t: dict) -> Column:
    if "leaf" in t:
        return F.lit(t["leaf"])
    kind, v = t["test"]
    hit = F.col(t["col"]).isin(*v) if kind == "in" else F.col(t["col"]) <= v
    return F.when(hit, _leaf(t["yes"])).otherwise(_leaf(t["no"]))


def random_forest(df: DataFrame, key: str, domains: dict, target: str, classes: Sequence, epsilon: float, *, trees: int = 10, depth: int | None = None,
                  ledger=None, seed=None) -> Forest:
    """Trees with splits drawn from the feature domains alone; every tree sees its own block of
    rows, so all leaf labels together cost one epsilon. domains: column -> list of categories or (low, high)."""
    spend(ledger, epsilon)
    rng = generator(seed)
    listed = sum(isinstance(x, list) for x in domains.values())
    depth = depth or tree_depth(len(domains) - listed, listed)
    grown = [_grow(rng, domains, depth, []) for _ in range(trees)]
    own = partitions(df, key, trees).withColumnRenamed("part", "tree")
    leaf = F.element_at(F.array(*[_leaf(t) for t in grown]), F.col("tree") + 1)
    counts = own.withColumn("leaf", leaf).groupBy("tree", "leaf", F.col(target).alias("label")).agg(F.count("*").alias("n"))
    cells = df.sparkSession.range(trees * 2**depth).select((F.floor(F.col("id") / 2**depth)).cast("int").alias("tree"), (F.col("id") % 2**depth).cast("int").alias("leaf"),
                                                          F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    full = cells.join(counts, ["tree", "leaf", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    u = u01(seed if seed is not None else secret_seed(), "leaf", "tree", "leaf", "label")
    labels = permute_and_flip(full, ["tree", "leaf"], "label", F.col("n"), min(epsilon, 1e9), 1.0, u, monotonic=True)
    return Forest(grown, labels)


def standard_scaler(states: DataFrame, bounds: Bounds, epsilon: float, *, seed=None) -> DataFrame:
    """(column, mean, variance): noisy moments from merged batch states of clipped rows, so that
    batches can keep arriving."""
    rows = states.sparkSession.createDataFrame([(c, float(b[0]), float(b[1])) for c, b in bounds.items()], "column string, lo double, hi double")
    s = states.join(F.broadcast(rows), "column").withColumn("w", F.col("hi") - F.col("lo")).withColumn("k", F.col("n").cast("double"))
    share = epsilon / (2 * len(bounds))
    seed = seed if seed is not None else secret_seed()
    m = noise.laplace_truncated(F.col("mean"), u01(seed, "mean", "column"), share, F.col("w") / F.col("k"), F.col("lo"), F.col("hi"))
    v = noise.laplace_bounded_domain(F.col("m2") / F.col("k"), u01(seed, "var", "column"), share, F.col("w") * F.col("w") / F.col("k") / F.col("k") * (F.col("k") - 1),
                                     F.lit(0.0), F.col("w") * F.col("w") / 4)
    return s.select("column", m.alias("mean"), v.alias("variance"))
