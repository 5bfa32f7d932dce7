"""MLlib models around the table operators: teachers, students, pipelines and the augmentation experiment."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.tables import materialise
from tabloom.operators import encode as enc
from tabloom.operators import scale as sc
from tabloom.operators.augment import class_list, nearest_class, relabel, union_origin
from tabloom.operators.clean import modes
from tabloom.operators.fidelity import association_difference, fidelity_report
from tabloom.operators.privacy import closest_record
from tabloom.operators.scoring import label_scores, regression_scores, score_metrics
from tabloom.operators.split import equal_chunks, k_folds, prefixes, shuffle_split, stratified_k_folds, stratified_split, train_test
from tabloom.spec import REGRESSION, TableSpec

Generator = Callable[[DataFrame, TableSpec, int, int], DataFrame]


# --- preprocessing and pipelines ----------------------------------------------------

@dataclass
class Preprocessor:
    """Imputer -> encoder -> scaler, fitted on one table and applied to any other."""

    spec: TableSpec
    encoder: str = "target"
    impute: bool = True
    scaler: str | None = "robust"
    fill: dict = field(default_factory=dict)
    codes: object = None
    scale: sc.Affine | None = None

    def fit(self, df: DataFrame) -> "Preprocessor":
        if self.impute:
            self.fill = modes(df, self.spec.features).first().asDict()
        df = self._filled(df)
        if self.spec.categorical:
            self.codes = {
                "target": lambda: enc.fit_formula(df, self.spec, enc.target_mean(20, 10.0)),
                "ordinal": lambda: enc.fit_ordinal(df, self.spec.categorical, self.spec.key),
                "count": lambda: enc.fit_formula(df, self.spec, enc.count(), default=0.0),
                "collapse": lambda: None,
            }[self.encoder]()
        fits = {"robust": sc.fit_robust, "min_max": sc.fit_min_max, "standard": sc.fit_standard}
        self.scale = fits[self.scaler](df, self.spec.numeric) if self.scaler and self.spec.numeric else None
        return self

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.na.fill({c: v for c, v in self.fill.items() if v is not None}) if self.fill else df

    def transform(self, df: DataFrame) -> DataFrame:
        df = self._filled(df)
        if self.codes is not None:
            df = self.codes.transform(df)
        elif self.spec.categorical:
            df = enc.collapse(df, self.spec.categorical)
        return self.scale.transform(df) if self.scale else df

    def features(self, columns: Sequence[str]) -> list[str]:
        return [c for c in columns if c not in (self.spec.key, self.spec.target, "origin", "fold", "part", "row", "n_samples")]


@dataclass
class Steps:
    """Steps that may change rows and target. A step has fit(df) -> (df -> df) and may be
    skipped when the pipeline is applied to new rows."""

    steps: Sequence[tuple[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]], bool]]
    fitted: list = field(default_factory=list)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self.fitted = []
        for name, fit, train_only in self.steps:
            apply = fit(df)
            self.fitted.append((name, apply, train_only))
            df = apply(df)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        for _, apply, train_only in self.fitted:
            if not train_only:
                df = apply(df)
        return df


# --- models -------------------------------------------------------------------------

def estimator(kind: str, n_features: int = 0, n_classes: int = 2, **params):
    """An untrained MLlib model over `features` and `_y`."""
    io = {"featuresCol": "features", "labelCol": "_y"}
    if kind == "gbt" and n_classes > 2:
        return OneVsRest(classifier=GBTClassifier(**io, seed=1, **params), **io)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(**io, layers=[n_features, 8, n_classes], seed=1, maxIter=30, **params)
    if kind == "svc" and n_classes > 2:
        return OneVsRest(classifier=LinearSVC(**io, **params), **io)
    made = {"tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "gbt": GBTClassifier, "logit": LogisticRegression, "svc": LinearSVC,
            "tree_reg": DecisionTreeRegressor, "gbt_reg": GBTRegressor, "ridge": LinearRegression}[kind]
    if kind in ("tree", "forest", "gbt", "tree_reg", "gbt_reg"):
        params.setdefault("seed", 1)
    return made(**io, **params)


@dataclass
class Model:
    fitted: object
    cols: tuple[str, ...]
    classes: list | None
    metrics: list = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add `prediction` and, for two classes with probabilities, `p`."""
        out = self.fitted.transform(VectorAssembler(inputCols=list(self.cols), outputCol="features", handleInvalid="keep").transform(df))
        extra = []
        if self.classes is not None:
            if len(self.classes) == 2 and "probability" in out.columns:
                extra = [vector_to_array("probability")[1].alias("p")]
            names = F.array(*[F.lit(c) for c in self.classes])
            pred = F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction")
        else:
            pred = F.col("prediction")
        return out.select(*df.columns, pred, *extra)


def fit_model(df: DataFrame, cols: Sequence[str], target: str, kind: str, *, grid: dict | None = None, fold: str | None = None, classes: list | None = None, **params) -> Model:
    """Train one model, or tune it over `grid` by cross-validation on the folds in `fold`."""
    regression = kind.endswith("_reg") or kind == "ridge"
    classes = None if regression else (classes or class_list(df, target))
    if classes is not None:
        names = F.array(*[F.lit(c) for c in classes])
        label = (F.array_position(names, F.col(target)) - 1).cast("double")
    else:
        label = F.col(target).cast("double")
    data = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep").transform(df.withColumn("_y", label))
    data = data.select("features", "_y", *([fold] if fold else [])).persist()
    est = estimator(kind, len(cols), len(classes or [0, 1]), **params)
    try:
        if not grid:
            return Model(est.fit(data), tuple(cols), classes)
        b = ParamGridBuilder()
        for k, v in grid.items():
            b = b.addGrid(getattr(est, k), v)
        ev = (RegressionEvaluator(labelCol="_y", metricName="mae") if regression else MulticlassClassificationEvaluator(labelCol="_y", metricName="weightedFMeasure"))
        if fold:
            best, means = cross_validated_boosting(est, b.build(), data, fold) if kind == "gbt_reg" else cross_validated(est, b.build(), ev, data, fold)
            return Model(best, tuple(cols), classes, means)
        m = CrossValidator(estimator=est, estimatorParamMaps=b.build(), evaluator=ev, numFolds=3, parallelism=4, seed=1).fit(data)
        return Model(m.bestModel, tuple(cols), classes, list(m.avgMetrics))
    finally:
        data.unpersist()


def cross_validated(est, maps: Sequence[dict], ev, data: DataFrame, fold: str, threads: int = 4) -> tuple[object, list[float]]:
    """The best setting refitted on all rows, and the mean score of every setting over the folds 0, 1, ... in `fold`.

    What CrossValidator does with a fold column, which sends each row through a Python function and keeps copies of
    every fold; here the folds are plain filters of the kept table."""
    k = data.agg(F.max(fold)).first()[0] + 1

    def score(at: tuple[int, int]) -> float:
        i, j = at
        return ev.evaluate(est.fit(data.where(F.col(fold) != i), maps[j]).transform(data.where(F.col(fold) == i)))

    with ThreadPool(threads) as pool:
        got = pool.map(inheritable_thread_target(data.sparkSession)(score), [(i, j) for i in range(k) for j in range(len(maps))])
    means = np.array(got).reshape(k, len(maps)).mean(axis=0)
    best = int(means.argmax() if ev.isLargerBetter() else means.argmin())
    return est.fit(data, maps[best]), means.tolist()


def weighted_rows(data: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each different `by`, kept: the mean of its labels and the sum of their weights. A missing label stays one."""
    label = F.when(F.count("*") == F.count("_y"), F.sum(F.col("_y") * F.col("_w")) / F.sum("_w"))
    return data.groupBy(*by).agg(label.alias("_y"), F.sum("_w").alias("_w")).persist()


TASK_ROWS = 16_384  # a long run is some hundred short jobs: small tables go in few tasks


def in_few_tasks(rows: DataFrame) -> DataFrame:
    return rows.coalesce(max(1, math.ceil(rows.count() / TASK_ROWS)))


def cross_validated_boosting(est, maps: Sequence[dict], data: DataFrame, fold: str, threads: int = 4) -> tuple[object, list[float]]:
    """What `cross_validated` does by mean absolute error, for boosted regression trees.

    The first trees of a long run are those of a shorter one, so settings that differ in `maxIter` alone share one run,
    which is scored after each tree. Trees learn from one weighted row for each different vector of features, since splits
    and leaf values depend on the sum and the number of its labels only. Every held-out row is scored on its own."""
    held, est = data.withColumn("_w", F.lit(1.0)), est.copy({est.weightCol: "_w"})
    k = data.agg(F.max(fold)).first()[0] + 1
    rounds = [m.get(est.maxIter, est.getMaxIter()) for m in maps]
    runs: dict[frozenset, list[int]] = {}
    for j, m in enumerate(maps):
        runs.setdefault(frozenset((p.name, v) for p, v in m.items() if p.name != "maxIter"), []).append(j)
    rows = weighted_rows(held, ["features", fold])
    learnt = [weighted_rows(rows.where(F.col(fold) != i), ["features"]) for i in range(k)]
    every = weighted_rows(rows, ["features"])

    few = [in_few_tasks(t) for t in learnt]

    def score(at: tuple[int, list[int]]) -> list[float]:
        i, same = at
        model = est.fit(few[i], maps[max(same, key=rounds.__getitem__)])
        errors = model.evaluateEachIteration(held.where(F.col(fold) == i), "absolute")
        return [errors[rounds[j] - 1] for j in same]

    try:
        with ThreadPool(threads) as pool:
            got = pool.map(inheritable_thread_target(data.sparkSession)(score), [(i, same) for same in runs.values() for i in range(k)], chunksize=1)
        means = np.empty(len(maps))
        for n, same in enumerate(runs.values()):
            means[same] = np.mean(got[n * k:(n + 1) * k], axis=0)
        return est.fit(in_few_tasks(every), maps[int(means.argmin())]), means.tolist()
    finally:
        for t in (rows, every, *learnt):
            t.unpersist()


TREE_GRID = {"maxDepth": [3, 6]}
GBT_GRID = {"maxDepth": [2, 4]}
FOREST_GRID = {"numTrees": [10, 25]}
#: The reference's regression teacher. Its fourth depth is unlimited but for 31 leaves, which a depth of 5 holds as well.
BOOSTING_GRID = {"maxDepth": [2, 5, 8], "maxIter": [10, 25, 50]}


def with_folds(df: DataFrame, spec: TableSpec, k: int = 5, seed=0) -> DataFrame:
    if spec.task == REGRESSION:
        return k_folds(df, spec.key, k, shuffle=True, seed=seed)
    return stratified_k_folds(df, spec.key, spec.target, k, shuffle=True, seed=seed)


def tuned(train: DataFrame, spec: TableSpec, kind: str, grid: dict, *, folds: int = 3, encoder: str = "target", scaler: str | None = "robust", **params) -> tuple[Preprocessor, Model]:
    """Preprocess, tune by cross-validation, refit."""
    train = materialise(train)  # read once per fitted step
    prep = Preprocessor(spec, encoder=encoder, scaler=scaler).fit(train)
    t = materialise(with_folds(prep.transform(train), spec, folds))
    return prep, fit_model(t, prep.features(t.columns), spec.target, kind, grid=grid, fold="fold", **params)


def evaluate(df: DataFrame, spec: TableSpec, model: Model) -> DataFrame:
    """One row of scores on a preprocessed table."""
    out = model.predict(df)
    if spec.task == REGRESSION:
        return regression_scores(out, spec.target, "prediction")
    out = out.withColumnRenamed(spec.target, "label").withColumnRenamed("prediction", "pred")
    return label_scores(out, positive=(model.classes[-1] if spec.task == "binary" else None))


def student_kind(spec: TableSpec) -> str:
    return "tree_reg" if spec.task == REGRESSION else "tree"


def fit_student(train: DataFrame, spec: TableSpec, *, depth: int = 4, encoder: str = "target") -> tuple[Preprocessor, Model]:
    train = materialise(train)  # read once per fitted step
    prep = Preprocessor(spec, encoder=encoder).fit(train)
    t = materialise(prep.transform(train))
    return prep, fit_model(t, prep.features(t.columns), spec.target, student_kind(spec), maxDepth=depth)


def score_student(train: DataFrame, test: DataFrame, spec: TableSpec, **kw) -> DataFrame:
    prep, model = fit_student(train, spec, **kw)
    return evaluate(prep.transform(test), spec, model)


# --- augmentation -------------------------------------------------------------------

def keyed(synth: DataFrame, spec: TableSpec, df: DataFrame) -> DataFrame:
    """Generated rows under the table's columns, with keys below zero."""
    types = dict(df.dtypes)
    return synth.select((-F.col("row") - 1).alias(spec.key), *[F.col(c).cast(types[c]).alias(c) for c in [*spec.features, spec.target]])


def augmented(train: DataFrame, spec: TableSpec, make: Generator, n: int, *, labels: str = "generator", teacher: tuple[Preprocessor, Model] | None = None, seed: int = 0) -> DataFrame:
    """Training table with n generated rows.

    labels: `generator` keeps the generated target, `teacher` replaces it by the teacher's prediction,
    `indirect` treats the target as a number and maps it to the closest class, `none` adds nothing.
    """
    cols = [spec.key, *spec.features, spec.target]
    real = materialise(train.select(*cols))
    if labels == "none" or n == 0:
        return real
    synth = keyed(make(real, spec, n, seed), spec, real)
    if labels == "teacher":
        prep, model = teacher

        def predict(rows):
            out = model.predict(prep.transform(rows)).select(spec.key, "prediction")
            return rows.join(out, spec.key)

        both = relabel(union_origin(real, synth), predict, spec.target, spec.key)
        return both.select(*cols)
    if labels == "indirect":
        classes = real.select(spec.target).distinct()
        kind = dict(real.dtypes)[spec.target]
        synth = nearest_class(synth.withColumn(spec.target, F.col(spec.target).cast("double")), spec.target, classes, "_c").withColumn(
            spec.target, F.col("_c").cast(kind)).drop("_c")
    return real.unionByName(synth)


def variants(train: DataFrame, test: DataFrame, spec: TableSpec, make: Generator, n: int, teacher: tuple[Preprocessor, Model], kinds=("none", "generator", "teacher", "indirect")) -> DataFrame:
    """Scores of the student under each labelling."""
    parts = [score_student(augmented(train, spec, make, n, labels=k, teacher=teacher), test, spec).withColumn("labels", F.lit(k)) for k in kinds]
    return reduce(DataFrame.unionByName, parts)


def tune_generator(train: DataFrame, spec: TableSpec, grid: Sequence[tuple[str, Generator]], n: int) -> DataFrame:
    """(generator, score, best): each candidate scored by a student on one 80/20 split; a single
    candidate needs no scoring."""
    spark = train.sparkSession
    if len(grid) == 1:
        return spark.createDataFrame([(grid[0][0], None, True)], "generator string, score double, best boolean")
    s = materialise(shuffle_split(train, spec.key, 0.2))
    a, b = s.where("part = 'train'").drop("part"), s.where("part = 'test'").drop("part")
    metric = "mae" if spec.task == REGRESSION else "f1_weighted"
    parts = [score_student(augmented(a, spec, g, n), b, spec).select(F.lit(name).alias("generator"), F.col(metric).alias("score")) for name, g in grid]
    rows = sorted(((r["generator"], r["score"]) for p in parts for r in p.collect()), key=lambda r: r[1], reverse=metric != "mae")
    return spark.createDataFrame([(g, s, i == 0) for i, (g, s) in enumerate(rows)], "generator string, score double, best boolean")


def synthetic_only(train: DataFrame, test: DataFrame, spec: TableSpec, make: Generator, n: int, **kw) -> DataFrame:
    """Student trained on generated rows alone."""
    return score_student(keyed(make(materialise(train), spec, n, 0), spec, train), test, spec, **kw)


def joint_one_hot(train: DataFrame, test: DataFrame, spec: TableSpec, depth: int = 20) -> DataFrame:
    """Deep tree on columns one-hot coded over both tables."""
    both = materialise(train.select(*spec.columns).withColumn("part", F.lit("train")).unionByName(test.select(*spec.columns).withColumn("part", F.lit("test"))))
    hot = enc.one_hot(both, spec.categorical)
    cols = [c for c in hot.columns if c not in (spec.key, spec.target, "part")]
    model = fit_model(hot.where("part = 'train'"), cols, spec.target, "tree", maxDepth=depth)
    return evaluate(hot.where("part = 'test'"), spec, model)


def oversampling(df: DataFrame, synth: DataFrame, spec: TableSpec, minority, train_size: int) -> DataFrame:
    """Forest trained on real plus generated minority rows, and on generated rows only."""
    s = materialise(stratified_split(df.select(*spec.columns), spec.key, spec.target, train_size))
    train, test = s.where("part = 'train'").drop("part"), s.where("part = 'test'").drop("part")
    fake = materialise(synth.select(*spec.columns))
    parts = []
    for name, t in (("real_plus_minority", train.unionByName(fake.where(F.col(spec.target) == minority))), ("synthetic_only", fake)):
        prep = Preprocessor(spec).fit(t)
        rows = prep.transform(t)
        m = fit_model(rows, prep.features(rows.columns), spec.target, "forest", numTrees=10)
        parts.append(evaluate(prep.transform(test), spec, m).withColumn("training", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def score_models(train: DataFrame, test: DataFrame, spec: TableSpec, kinds: Sequence[str]) -> DataFrame:
    """(model, metric, value) for several binary classifiers on one split; a model that predicts one
    class only scores 0 everywhere."""
    prep = Preprocessor(spec).fit(train)
    a, b = materialise(prep.transform(train)), prep.transform(test)
    parts = []
    for k in kinds:
        m = fit_model(a, prep.features(a.columns), spec.target, k)
        out = m.predict(b)
        scored = out.select(F.col(spec.target).alias("y"), *([F.col("p")] if "p" in out.columns else [F.col("prediction").cast("double").alias("p")]), F.col("prediction").alias("pred"))
        one = scored.agg(F.count_distinct("pred").alias("k"))
        lab = label_scores(scored.withColumnRenamed("y", "label"), positive=1).select("f1", F.col("accuracy").alias("acc"), "gmean", "bacc")
        s = lab.withColumn("s", score_metrics(scored).select(F.struct("auc", "brier", "aps")).scalar()).withColumn("k", one.scalar())
        names = ["auc", "brier", "f1", "aps", "acc", "gmean", "bacc"]
        vals = {**{c: F.col(c) for c in ("f1", "acc", "gmean", "bacc")}, **{c: F.col(f"s.{c}") for c in ("auc", "brier", "aps")}}
        parts.append(s.select(F.lit(k).alias("model"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.when(F.col("k") > 1, vals[c]).otherwise(0.0).alias("value")) for c in names])).alias("x")).select("model", "x.*"))
    return reduce(DataFrame.unionByName, parts)


def experiment(df: DataFrame, spec: TableSpec, make: Generator, *, generator: str, sizes: Sequence[int], train_size: int, max_test: int | None, seed: int = 0) -> DataFrame:
    """Result rows of one (encoder, generator, seed): baseline, generator labels and teacher labels
    at every sample size, then fidelity and privacy of each synthetic fold of train_size rows.

    The largest sample is drawn once; smaller ones are prefixes of it.
    """
    parts = materialise(train_test(df.select(*spec.columns), spec.key, train_size, max_test, seed))
    train, test = parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")
    teacher = tuned(train, spec, "forest", {"numTrees": [10]}, folds=2)
    synth = materialise(keyed(make(train, spec, max(sizes), seed), spec, train))
    cut = prefixes(synth, spec.key, sizes, seed)
    metric = "mae" if spec.task == REGRESSION else "f1_weighted"
    rows = [score_student(train, test, spec).select(F.lit(None).cast("string").alias("generator"), F.lit(None).cast("string").alias("teacher"), F.lit(0).alias("n_samples"),
                                                    F.lit(None).cast("int").alias("generated_fold"), F.lit(metric).alias("metric"), F.col(metric).alias("value"))]
    for n in sizes:
        part = cut.where(F.col("n_samples") == n).drop("n_samples")
        for labels in ("generator", "teacher"):
            t = augmented(train, spec, lambda *_: part.withColumn("row", -F.col(spec.key) - 1), n, labels=labels, teacher=teacher)
            rows.append(score_student(t, test, spec).select(F.lit(generator).alias("generator"), F.lit("forest" if labels == "teacher" else None).cast("string").alias("teacher"), F.lit(n).alias("n_samples"),
                                                            F.lit(None).cast("int").alias("generated_fold"), F.lit(metric).alias("metric"), F.col(metric).alias("value")))
    folds = materialise(equal_chunks(synth, spec.key, train_size))
    train = materialise(train)
    for k in range(max(sizes) // train_size):
        f = folds.where(F.col("fold") == k).drop("fold")
        scores = fidelity_report(train, f, spec)
        diff = association_difference(train, f, spec).select(F.lit("diff_corr").alias("metric"), F.col("diff_corr").alias("value"))
        near = closest_record(train, f, spec).unpivot([], ["dcr", "nndr"], "metric", "value")
        rows.append(reduce(DataFrame.unionByName, [scores, diff, near]).select(
            F.lit(generator).alias("generator"), F.lit(None).cast("string").alias("teacher"), F.lit(max(sizes)).alias("n_samples"), F.lit(k).alias("generated_fold"), "metric", "value"))
    return reduce(DataFrame.unionByName, rows).withColumns({"train_size": F.lit(train_size), "random_state": F.lit(seed), "encoder": F.lit("target"), "student": F.lit("tree")})


# --- model-based fidelity -----------------------------------------------------------

def detection(real: DataFrame, synth: DataFrame, spec: TableSpec, kinds: Sequence[str] = ("logit", "forest"), seed=0) -> DataFrame:
    """(model, auc, accuracy): how well a classifier tells the two tables apart on a held-out fifth."""
    s = spec.with_roles(target="fake", task="binary")
    rows = real.select(spec.key, *spec.features, F.lit(0).alias("fake")).unionByName(
        synth.select((-F.col(spec.key) - 1).alias(spec.key), *spec.features, F.lit(1).alias("fake")))
    rows = materialise(rows)
    n = rows.count()
    parts = materialise(stratified_split(rows, spec.key, "fake", n - math.ceil(n * 0.2), seed))
    prep = Preprocessor(s).fit(parts.where("part = 'train'").drop("part"))
    a, b = (materialise(prep.transform(parts.where(F.col("part") == p).drop("part"))) for p in ("train", "test"))
    out = []
    for k in kinds:
        m = fit_model(a, prep.features(a.columns), "fake", k, classes=[0, 1], **({"maxDepth": 4, "numTrees": 20} if k == "forest" else {}))
        p = m.predict(b)
        acc = p.agg(F.avg((F.col("fake") == F.col("prediction")).cast("double")).alias("a"))
        out.append(score_metrics(p, "fake", "p").select(F.lit(k).alias("model"), "auc").withColumn("accuracy", acc.scalar()))
    return reduce(DataFrame.unionByName, out)


def parent_child_detection(real: tuple[DataFrame, DataFrame], synth: tuple[DataFrame, DataFrame], on: tuple[str, str], spec: TableSpec) -> DataFrame:
    """Join each child table to its parent, then tell real from synthetic."""
    flat = [c.join(p, c[on[1]] == p[on[0]]) for p, c in (real, synth)]
    return detection(flat[0], flat[1], spec, kinds=("logit",))


def mixture_likelihood(real: DataFrame, synth: DataFrame, cols: Sequence[str], k: int = 10, seed: int = 1, iterations: int = 20) -> DataFrame:
    """Mean log density of synthetic rows under a Gaussian mixture fitted to the real rows.

    MLlib adds nothing to its covariances, so nearly collinear columns with many parts end in its error."""
    scale = sc.fit_standard(real, cols)
    vec = VectorAssembler(inputCols=list(cols), outputCol="features")
    model = GaussianMixture(k=k, seed=seed, maxIter=iterations).fit(vec.transform(scale.transform(real.select(*cols))))
    logs = []
    for w, g in zip(model.weights, model.gaussiansDF.collect()):
        mean, cov = g["mean"].toArray(), g["cov"].toArray() + 1e-9 * np.eye(len(cols))
        root = np.linalg.inv(np.linalg.cholesky(cov))
        quad = F.lit(0.0)
        for i in range(len(cols)):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + float(root[i, j]) * (F.col(cols[j]) - float(mean[j]))
            quad = quad + z * z
        const = math.log(max(w, 1e-300)) + float(np.log(np.abs(np.diag(root))).sum()) - 0.5 * len(cols) * math.log(2 * math.pi)
        logs.append(F.lit(const) - quad / 2)
    rows = scale.transform(synth.select(*cols)).select(F.array(*logs).alias("l")).withColumn("m", F.array_max("l"))
    dens = F.col("m") + F.log(F.aggregate(F.transform("l", lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda a, x: a + x))
    return rows.agg(F.avg(dens).alias("log_likelihood"))


def dimension_prediction(real: DataFrame, synth: DataFrame, spec: TableSpec, *, test_share: float = 0.3, seed=0) -> DataFrame:
    """(rmse, pearson) over columns of how well each column is predicted from the others, in both
    tables: explained variance of a ridge model for numbers, weighted F1 of a forest for categories.

    Models learn from all rows but `test_share` of a table and are scored on these; one split serves all columns.
    """
    codes = enc.fit_labels(real.select(spec.key, *spec.categorical).unionByName(synth.select(spec.key, *spec.categorical)), spec.categorical)
    got = []
    for name, df in (("p", real), ("q", synth)):
        t = shuffle_split(codes.transform(df.select(spec.key, *spec.features)), spec.key, test_share, seed)
        t = materialise(sc.fit_standard(t, spec.numeric).transform(t))
        train, test = t.where("part = 'train'").drop("part"), t.where("part = 'test'").drop("part")
        penalty = 1.0 / max(1, train.count())  # MLlib averages squared errors, so this is a ridge weight of one
        parts = []
        for c in spec.features:
            rest = [x for x in spec.features if x != c]
            if c in spec.numeric:
                m = fit_model(train, rest, c, "ridge", regParam=penalty)
                parts.append(regression_scores(m.predict(test), c, "prediction").select(F.lit(c).alias("dim"), F.col("r2").alias(name)))
            else:
                m = fit_model(train, rest, c, "forest", numTrees=20, maxDepth=6, minWeightFractionPerNode=0.05)
                s = label_scores(m.predict(test).select(F.col(c).alias("label"), F.col("prediction").alias("pred")))
                parts.append(s.select(F.lit(c).alias("dim"), F.col("f1_weighted").alias(name)))
        got.append(reduce(DataFrame.unionByName, parts))
    d = F.col("p") - F.col("q")
    return got[0].join(got[1], "dim").agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.corr("p", "q").alias("pearson"))


# Models (or sizes of a mixture) that stand for a problem type.
PROBLEM_PRESETS = {
    "binary_classification": ("tree", "gbt", "logit", "mlp"),
    "multiclass_classification": ("tree", "mlp"),
    "regression": ("ridge",),
    "gaussian_likelihood": (10, 30),
}


def run_problem_preset(real: DataFrame, synth: DataFrame, spec: TableSpec, problem: str) -> DataFrame:
    """(metric, value) of a problem type: models learnt from the synthetic table and scored on the real one (F1 of the
    larger class label, weighted F1 or explained variance), or mean log densities under Gaussian mixtures of ten rounds."""
    if problem not in PROBLEM_PRESETS:
        raise ValueError(f"unknown problem type {problem!r}")
    if problem == "gaussian_likelihood":
        parts = [mixture_likelihood(real, synth, list(spec.numeric), k, iterations=10).select(F.lit(f"mixture_{k}").alias("metric"), F.col("log_likelihood").alias("value")) for k in PROBLEM_PRESETS[problem]]
        return reduce(DataFrame.unionByName, parts)
    prep = Preprocessor(spec, encoder="ordinal", scaler="standard").fit(synth.select(*spec.columns))
    train, test, parts = materialise(prep.transform(synth.select(*spec.columns))), materialise(prep.transform(real.select(*spec.columns))), []
    classes = None if problem == "regression" else sorted({*class_list(real, spec.target), *class_list(synth, spec.target)})
    for kind in PROBLEM_PRESETS[problem]:
        out = fit_model(train, prep.features(train.columns), spec.target, kind, classes=classes, **({"regParam": 0.0} if kind == "ridge" else {})).predict(test)
        if problem == "regression":
            value = regression_scores(out, spec.target, "prediction").select(F.col("r2").alias("value"))
        else:
            labelled = out.select(F.col(spec.target).alias("label"), F.col("prediction").alias("pred"))
            scored = label_scores(labelled, positive=classes[-1]) if problem == "binary_classification" else label_scores(labelled)
            value = scored.select(F.col("f1" if problem == "binary_classification" else "f1_weighted").alias("value"))
        parts.append(value.select(F.lit(kind).alias("metric"), "value"))
    return reduce(DataFrame.unionByName, parts)


def utility_difference(real: DataFrame, synth: DataFrame, spec: TableSpec, kinds: Sequence[str] = ("logit", "tree", "forest", "mlp", "svc"), test_share: float = 0.2) -> DataFrame:
    """(model, accuracy, f1_weighted): score of a model trained on real rows minus that of the same model
    trained on synthetic rows, both tested on the same held-out real rows."""
    real = materialise(real.select(*spec.columns))  # read by the split and the class list
    s = materialise(shuffle_split(real, spec.key, test_share))
    train, test = s.where("part = 'train'").drop("part"), s.where("part = 'test'").drop("part")
    classes = class_list(real, spec.target)
    prep = Preprocessor(spec, encoder="ordinal", scaler="standard").fit(train)
    tables = {k: materialise(prep.transform(t.select(*spec.columns))) for k, t in (("real", train), ("synthetic", synth))}
    check, out = materialise(prep.transform(test)), []
    for kind in kinds:
        scores = []
        for name, t in tables.items():
            m = fit_model(t, prep.features(t.columns), spec.target, kind, classes=classes)
            p = m.predict(check).select(F.col(spec.target).alias("label"), F.col("prediction").alias("pred"))
            scores.append(label_scores(p).select(F.struct("accuracy", "f1_weighted").alias(name)))
        pair = scores[0].withColumn("synthetic", scores[1].scalar())
        out.append(pair.select(F.lit(kind).alias("model"), *[(F.col(f"real.{c}") - F.col(f"synthetic.{c}")).alias(c) for c in ("accuracy", "f1_weighted")]))
    return reduce(DataFrame.unionByName, out)
