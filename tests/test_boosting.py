"""The boosted regression teacher is tuned over its whole grid."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder

from tabloom.operators import models


def test_regression_teacher_tries_all_settings_on_five_folds(spark, sf, monkeypatch):
    from tabloom.plans import load_all, training

    seen = {}

    def tuned(train, spec, kind, grid, *, folds=3, **params):
        seen.update(kind=kind, grid=grid, folds=folds, params=params)
        raise InterruptedError

    monkeypatch.setattr(training.mo, "tuned", tuned)
    with pytest.raises(InterruptedError):
        load_all()["train_teacher_boosted_regression"].run(spark, sf)
    assert seen == {"kind": "gbt_reg", "grid": {"maxDepth": [2, 5, 8], "maxIter": [10, 25, 50]}, "folds": 5, "params": {}}


def test_shared_runs_score_like_runs_of_their_own(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 6, 600), rng.integers(0, 4, 600)
    rows = [(float(x), float(y), float(10 * x - 7 * y * y + rng.normal()), int(i % 3)) for i, (x, y) in enumerate(zip(a, b))]
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, _y double, fold int")).cache()
    est = models.estimator("gbt_reg")
    maps = ParamGridBuilder().addGrid(est.maxDepth, [1, 3]).addGrid(est.maxIter, [1, 4]).build()
    plain, means = models.cross_validated(est, maps, RegressionEvaluator(labelCol="_y", metricName="mae"), data, "fold")
    shared, got = models.cross_validated_boosting(est, maps, data, "fold")
    assert got == pytest.approx(means) and len(set(np.round(got, 6))) == 4
    a, b = ([r[0] for r in m.transform(data).orderBy("a", "b", "_y").select("prediction").collect()] for m in (plain, shared))
    assert a == pytest.approx(b) and shared.getNumTrees == plain.getNumTrees == 4


def test_a_missing_label_is_not_averaged_away(spark):
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame([(1.0, 2.0, 0), (1.0, None, 0), (2.0, 3.0, 1)], "a double, _y double, fold int"))
    rows = models.weighted_rows(data.selectExpr("*", "1.0D as _w"), ["features"])
    assert sorted((r["features"][0], r["_y"], r["_w"]) for r in rows.collect()) == [(1.0, None, 2.0), (2.0, 3.0, 1.0)]
    rows.unpersist()
