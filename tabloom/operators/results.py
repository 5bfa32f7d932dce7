"""Analytics over experiment result tables.

A result table has one row per run: dataset, encoder, generator, teacher, random_state
and metrics. Groups here are configurations, so their number is bounded by the grid.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.ordering import exact_quantiles
from tabloom.functions.stats import chi2_p, t_two_sided_p

# Display names of result labels.
ENCODER_NAMES = {
    "NoneType": "nan", "BinaryEncoder": "Binary", "CatBoostEncoder": "CatBoost", "CollapseEncoder": "Collapse",
    "CountEncoder": "Count", "GLMMEncoder": "GLMM", "CV5GLMMEncoder": "CV5GLMM", "TargetEncoder": "Target",
    "CV5TargetEncoder": "CV5Target", "StratifiedCV5GLMMEncoder": "CV5GLMM", "StratifiedCV5TargetEncoder": "CV5Target",
    "MultiClassCatBoostEncoder": "CatBoost", "MultiClassGLMMEncoder": "GLMM", "MultiClassStratifiedCV5GLMMEncoder": "CV5GLMM",
    "MultiClassTargetEncoder": "Target", "MultiClassStratifiedCV5TargetEncoder": "CV5Target",
}
GENERATOR_NAMES = {
    "PrivBNGenerator": "PrivBayes", "GaussianCopulaGenerator": "GaussianCopula", "TableGANGenerator": "TableGAN",
    "CTGANGenerator": "CTGAN", "CopulaGANGenerator": "CopulaGAN", "MedGANGenerator": "MedGAN", "DPCTGANGenerator": "DP-CTGAN",
    "ProportionalSMOTEGenerator": "SMOTE", "ProportionalCWGANGPGenerator": "CWGAN-GP", "TVAEGenerator": "TVAE",
    "CTABGANGenerator": "CTAB-GAN", "WGANGPGenerator": "WGAN-GP",
}
LIBRARIES = {
    "SDV": ("ctgan", "copulagan", "gaussiancopula", "tvae", "hma1", "par"),
    "Gretel": ("gretel",),
    "YData": ("dragan", "vanilllagan", "wgan"),
}
ERROR_KINDS = (("Synthesizer Timeout", "timeout"), ("MemoryError", "memory_error"))

CONFIG = ("encoder", "generator", "teacher")


def rename_labels(df: DataFrame) -> DataFrame:
    return df.replace(ENCODER_NAMES, subset=["encoder"]).replace(GENERATOR_NAMES, subset=["generator"])


def first_baselines(df: DataFrame, by: Sequence[str] = ("dataset", "encoder", "random_state"), order: Sequence[str] = ("run_time",)) -> DataFrame:
    """Keep one baseline row (no generator, no teacher) per `by`; other rows stay."""
    base = F.col("generator").isNull() & F.col("teacher").isNull()
    w = Window.partitionBy(base, *by).orderBy(*order)
    return df.withColumn("_r", F.when(base, F.row_number().over(w)).otherwise(1)).where("_r = 1").drop("_r")


def average_folds(df: DataFrame, by: Sequence[str], metrics: Sequence[str], low: int, high: int) -> DataFrame:
    """Mean of the fold rows per configuration (null keys are a group), without the runs whose
    sample size lies in [low, high) and that have no fold."""
    folds = df.where(F.col("generated_fold").isNotNull()).groupBy(*by, "n_samples").agg(
        *[F.avg(m).alias(m) for m in metrics], F.avg("generated_fold").alias("generated_fold"))
    rest = df.where(F.col("generated_fold").isNull() & ~F.col("n_samples").between(low, high - 1)
                    ).select(*by, "n_samples", *metrics, F.col("generated_fold").cast("double").alias("generated_fold"))
    return folds.unionByName(rest)


def score_lists(df: DataFrame, metric: str, by: Sequence[str] = ("dataset", *CONFIG), seed: str = "random_state") -> DataFrame:
    """Scores of each configuration as an array in seed order (one entry per seed)."""
    pairs = F.array_sort(F.collect_list(F.struct(seed, F.col(metric).alias("v"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda x: x["v"]).alias("scores"))


def paired_tests(df: DataFrame, metric: str, group: str = "dataset", config: Sequence[str] = CONFIG, seed: str = "random_state",
                 resample: tuple[float, float, float] | None = None, alpha: float = 0.05) -> DataFrame:
    """(group, a, b, p_value, win): paired t-test of configuration a against b over the seeds.

    win is 1 for a significantly higher mean of a, 0 for a lower one, 0.5 otherwise.
    resample=(n, n1, n2) scales the variance by 1/n + n2/n1 and uses n - 1 degrees of freedom.
    Configurations of one group are few, so the join on (group, seed) is bounded by the grid.
    """
    name = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("nan")) for c in config])
    runs = df.select(F.col(group), name.alias("a"), F.col(seed).alias("seed"), F.col(metric).alias("x"))
    other = runs.select(group, F.col("a").alias("b"), "seed", F.col("x").alias("y"))
    d = F.col("x") - F.col("y")
    g = runs.join(other, [group, "seed"]).groupBy(group, "a", "b").agg(
        F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"), F.count(d).alias("n"))
    if resample:
        n, n1, n2 = resample
        se, dof = F.col("sd") * float(1 / n + n2 / n1) ** 0.5, F.lit(int(n - 1))
    else:
        se, dof = F.col("sd") / F.sqrt(F.col("n").cast("double")), F.col("n") - 1
    # without deviation the statistic is infinite (p = 0), or undefined if the means agree too
    g = g.withColumn("_t", F.try_divide(F.col("m"), F.when(se > 1e-12, se)))
    certain = (se <= 1e-12) & (F.abs("m") > 1e-12)
    g = g.withColumn("p_value", F.when(dof >= 1, F.when(certain, 0.0).otherwise(t_two_sided_p(F.col("_t"), dof))))
    return g.select(group, "a", "b", "p_value", F.when(F.coalesce(F.col("p_value"), F.lit(1.0)) >= alpha, 0.5)
                    .when(F.col("m") > 0, 1.0).otherwise(0.0).alias("win"))


def win_ranks(tests: DataFrame, group: str = "dataset") -> DataFrame:
    """0-based rank of each configuration by its win total, ties by name."""
    totals = tests.groupBy(group, "a").agg(F.sum("win").alias("wins"))
    return totals.withColumn("rank", (F.row_number().over(Window.partitionBy(group).orderBy("wins", "a")) - 1).cast("long"))


def friedman(ranks: DataFrame, block: str = "dataset", item: str = "a", score: str = "rank") -> DataFrame:
    """One row: blocks n, items k, tie-corrected statistic and its chi-square p-value."""
    r = tie_ranks(ranks, [block], score)
    n = r.groupBy(block).agg(F.count("*").alias("k"), (F.sum("_ties") / 1.0).alias("ties"))
    size = n.agg(F.count("*").alias("n"), F.max("k").alias("k"), F.sum("ties").alias("ties"))
    sums = r.groupBy(item).agg(F.sum("tie_rank").alias("s"), F.count("*").alias("c"))
    j = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss")).select("ss", size.select(F.struct("*")).scalar().alias("z")).select("ss", "z.*")
    n_, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12.0 / (n_ * k * (k + 1)) * F.col("ss") - 3 * n_ * (k + 1)
    return j.select("n", "k", F.try_divide(raw, 1 - F.col("ties") / (n_ * k * (k * k - 1))).alias("statistic")).withColumn(
        "p_value", chi2_p(F.col("statistic"), F.col("k") - 1))


def tie_ranks(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """1-based ranks where equal scores share the mean of the ranks they cover."""
    w = Window.partitionBy(*by)
    same = Window.partitionBy(*by, score)
    out = df.withColumn("_c", F.count("*").over(same)).withColumn("_r", F.rank().over(w.orderBy(score)))
    out = out.withColumn("_first", F.row_number().over(same.orderBy(*[c for c in df.columns if c not in by])))
    return out.select(*df.columns, (F.col("_r") + (F.col("_c") - 1) / 2).alias("tie_rank"),
                      F.when(F.col("_first") == 1, F.col("_c") * F.col("_c") * F.col("_c") - F.col("_c")).otherwise(0).alias("_ties"))


def studentised_range(k: int, alpha: float = 0.05) -> float:
    """Upper alpha point of the range of k standard normals: k * integral of phi(z) (Phi(z) - Phi(z - r))^(k - 1)."""
    z = np.linspace(-9, 9, 4001)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = lambda x: np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    top, lo, hi = cdf(z), 0.0, 20.0
    for _ in range(40):
        r = (lo + hi) / 2
        below = k * float((phi * (top - cdf(z - r)) ** (k - 1)).sum()) * (z[1] - z[0])
        lo, hi = (r, hi) if below < 1 - alpha else (lo, r)
    return hi


def nemenyi(ranks: DataFrame, block: str = "dataset", item: str = "a", score: str = "rank", alpha: float = 0.05) -> DataFrame:
    """(a, b, difference, win): mean-rank differences beyond the critical difference win, for any number of items,
    if the Friedman test over all items is significant; else nothing wins."""
    r = tie_ranks(ranks, [block], score)
    mean = r.groupBy(item).agg(F.avg("tie_rank").alias("m"))
    s = r.agg(F.count_distinct(block).alias("n"), F.count_distinct(item).alias("k")).first()
    n, k = s["n"], s["k"]
    critical = studentised_range(k, alpha) * math.sqrt(k * (k + 1) / (12.0 * n)) if k > 1 else 0.0
    gate = friedman(ranks, block, item, score).select(F.coalesce(F.col("p_value") < alpha, F.lit(False))).scalar()
    pairs = mean.select(F.lit(1).alias("j"), F.col(item).alias("a"), F.col("m").alias("ma")).join(
        mean.select(F.lit(1).alias("j"), F.col(item).alias("b"), F.col("m").alias("mb")), "j").drop("j").withColumn("gate", gate)
    diff = F.col("ma") - F.col("mb")
    return pairs.select("a", "b", diff.alias("difference"),
                        F.when(~F.col("gate") | (F.abs(diff) <= critical), 0.5).when(diff > 0, 1.0).otherwise(0.0).alias("win"))


def overall_ranks(tests: DataFrame) -> DataFrame:
    """0-based mean rank of each item by its win total over the post-hoc pairs."""
    totals = tests.groupBy("a").agg(F.sum("win").alias("wins")).withColumn("j", F.lit(1))
    return tie_ranks(totals, ["j"], "wins").select("a", "wins", (F.col("tie_rank") - 1).alias("rank"))


def without_teacher_only(ranks: DataFrame) -> DataFrame:
    return ranks.where(~(F.col("generator").isNull() & F.col("teacher").isNotNull()))


def top_n(ranks: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return ranks.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def metric_kind(metric: Column) -> Column:
    """efficacy, statistical or privacy by the metric's suffix."""
    return (F.when(metric.rlike("(_jsd|_wd|_diff_corr)$"), "statistical").when(metric.rlike("(_dcr|_nndr)$"), "privacy").otherwise("efficacy"))


def top_counts(top: DataFrame, component: str, column: str, values: Sequence[str]) -> DataFrame:
    """Occurrences by component and column value, with row and column totals."""
    cube = top.withColumn(component, F.coalesce(F.col(component), F.lit("nan"))).cube(component, column).agg(F.count("*").alias("n"))
    named = cube.select(F.coalesce(F.col(component), F.lit("total")).alias(component), F.coalesce(F.col(column), F.lit("total")).alias(column), "n")
    return named.groupBy(component).pivot(column, [*values, "total"]).agg(F.sum("n")).na.fill(0)


def membership_counts(top: DataFrame, lists: Mapping[str, Sequence[str]], column: str, exclude: bool = False) -> DataFrame:
    """Per column value: rows whose components are all in (or, with exclude, all outside) the lists."""
    hit = F.lit(True)
    for c, values in lists.items():
        inside = F.coalesce(F.col(c), F.lit("nan")).isin(*values)
        hit = hit & (~inside if exclude else inside)
    return top.groupBy(column).agg(F.count_if(hit).alias("n"))


def run_time_summary(df: DataFrame, by: str = "generator", value: str = "run_time") -> DataFrame:
    """Box-plot numbers per group."""
    t = df.withColumn(by, F.coalesce(F.col(by), F.lit("nan")))
    q = exact_quantiles(t, value, [0.0, 0.25, 0.5, 0.75, 1.0], by=[by])
    return q.select(by, *[F.col(f"q{i}").alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def mean_by(df: DataFrame, by: Sequence[str], values: Sequence[str], merged: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Group means; `merged` columns take the first non-null of their sources first."""
    df = df.withColumns({k: F.coalesce(*[F.col(c) for c in v]) for k, v in (merged or {}).items()})
    return df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def with_baselines(df: DataFrame, metric: str = "performance") -> DataFrame:
    """Runs with the mean student baseline (no generator, no teacher) and the mean teacher-only
    score of their (dataset, encoder) next to them."""
    no_gen = F.col("generator").isNull()
    base = df.groupBy("dataset", "encoder").agg(
        F.avg(F.when(no_gen & F.col("teacher").isNull(), F.col(metric))).alias("student_baseline"),
        F.avg(F.when(no_gen & F.col("teacher").isNotNull(), F.col(metric))).alias("teacher_baseline"))
    return df.where(~no_gen).join(base, ["dataset", "encoder"], "left")


def facet_series(df: DataFrame, facet: Sequence[str], x: str, y: str) -> DataFrame:
    """Mean and quartiles of y per facet and x."""
    t = df.withColumns({c: F.coalesce(F.col(c), F.lit("nan")) for c in facet})
    q = exact_quantiles(t, y, [0.25, 0.5, 0.75], by=[*facet, x])
    return t.groupBy(*facet, x).agg(F.avg(y).alias("mean")).join(
        q.select(*facet, x, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")), [*facet, x])


# --- generator leaderboard ----------------------------------------------------------

def preprocess_scores(df: DataFrame) -> DataFrame:
    """Means per (synthesizer, dataset, modality); the first error where no run was scored;
    known errors become flags."""
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("iteration")))
    g = df.groupBy("synthesizer", "dataset", "modality").agg(
        *[F.avg(c).alias(c) for c in ("normalized_score", "metric_time", "model_time")], first.alias("error"))
    text = F.when(F.col("metric_time").isNull(), F.coalesce(F.col("error"), F.lit("")))
    g = g.withColumn("error", text)
    for message, flag in ERROR_KINDS:
        hit = F.coalesce(F.col("error").contains(message), F.lit(False))
        g = g.withColumn(flag, hit.cast("int")).withColumn("error", F.when(~hit, F.col("error")))
    return g


def leaderboard(scores: DataFrame, baselines: Sequence[str] = ()) -> DataFrame:
    """One row per synthesizer that is not a baseline."""
    data = scores.where(~F.col("synthesizer").isin(*baselines)) if baselines else scores
    total = data.agg(F.count_distinct("dataset")).scalar()
    real = F.col("synthesizer") != "Identity"
    rank = lambda c, o: F.dense_rank().over(Window.partitionBy("dataset", real, F.col(c).isNotNull()).orderBy(o))
    r = data.withColumn("_s", rank("normalized_score", F.desc("normalized_score"))).withColumn("_t", rank("model_time", F.asc("model_time")))
    place = lambda c, v, n: F.count_if(real & (F.col(c) == n) & F.col(v).isNotNull())
    names = [f"beat_{b.lower()}" for b in baselines]
    if baselines:
        base = scores.where(F.col("synthesizer").isin(*baselines)).groupBy("dataset").agg(*[
            F.struct(F.max(F.when(F.col("synthesizer") == b, F.col("normalized_score"))).alias("s"),
                     F.max((F.col("synthesizer") == b).cast("int")).alias("here")).alias(f"_{n}") for b, n in zip(baselines, names)])
        r = r.join(base, "dataset", "left")
    low = F.lit(float("-inf"))
    g = r.groupBy("synthesizer").agg(
        F.count("normalized_score").alias("solved"), F.avg("normalized_score").alias("avg_score"),
        F.round(F.avg("model_time")).alias("time"), place("_s", "normalized_score", 1).alias("best"),
        place("_t", "model_time", 1).alias("best_time"), place("_t", "model_time", 2).alias("second_best_time"),
        place("_t", "model_time", 3).alias("third_best_time"),
        *[F.sum(f).alias(f) for _, f in ERROR_KINDS], F.count("error").alias("errors"),
        *[F.count_if((F.col(f"_{n}.here") == 1) & (F.coalesce(F.col("normalized_score"), low) >= F.coalesce(F.col(f"_{n}.s"), low))).alias(n) for n in names])
    g = g.withColumn("total", total)
    return g.withColumns({
        "coverage": F.concat(F.col("solved"), F.lit(" / "), F.col("total")),
        "coverage_perc": F.col("solved") / F.col("total"),
        "metric_errors": F.col("total") - F.col("solved") - F.col("errors") - F.col("timeout") - F.col("memory_error"),
    })


def error_matrix(scores: DataFrame, synthesizers: Sequence[str]) -> DataFrame:
    """Errors x synthesizers with an `all` column."""
    e = scores.where(F.col("error").isNotNull())
    cols = [F.count_if(F.col("synthesizer") == s).alias(s) for s in synthesizers]
    return e.groupBy("error").agg(F.count("*").alias("all"), *cols)


def library_of(name: Column) -> Column:
    low, out = F.lower(name), F.lit("Other")
    for library, parts in reversed(LIBRARIES.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.when(hit, library).otherwise(out)
    return out


def modality_report(scores: DataFrame, modality: str, baselines: Sequence[str]) -> dict[str, DataFrame]:
    """Summary, quality, performance and error tables of one modality."""
    part = scores.where(F.col("modality") == modality)
    t = leaderboard(part, baselines)
    names = [f"beat_{b.lower()}" for b in baselines]
    return {
        "summary": t.where("synthesizer <> 'Identity'").select(
            "synthesizer", F.col("coverage_perc").alias("coverage"), F.col("best_time").alias("wins"),
            F.col("second_best_time").alias("second"), F.col("third_best_time").alias("third"), library_of(F.col("synthesizer")).alias("library")),
        "quality": t.select("synthesizer", "total", "solved", "best", *names),
        "performance": t.select("synthesizer", "time"),
        "errors": t.select("synthesizer", "total", "solved", "coverage", "coverage_perc", "timeout", "memory_error", "errors", "metric_errors"),
    }
