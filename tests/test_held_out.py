import numpy as np
import pytest

from tabloom.operators.models import dimension_prediction, run_problem_preset
from tabloom.spec import TableSpec


def table(spark, seed, noise):
    """x follows z, k follows x, y follows x; `noise` hides how."""
    rng = np.random.default_rng(seed)
    z = rng.normal(size=1200)
    x = z + noise * rng.normal(size=1200)
    k = np.where(x + noise * rng.normal(size=1200) > 0, "up", "down")
    rows = [(i, str(a), float(b), float(c), int(b + noise * e > 0)) for i, (a, b, c, e) in enumerate(zip(k, x, z, rng.normal(size=1200), strict=True))]
    return spark.createDataFrame(rows, "id long, k string, x double, z double, y int").repartition(4)


SPEC = TableSpec("id", ("k",), ("x", "z"), "y", "binary")


def test_dimension_prediction_is_held_out(spark):
    clear, noise_only = table(spark, 1, 0.1), table(spark, 2, 30.0)
    same = dimension_prediction(clear, table(spark, 3, 0.1), SPEC).first()
    far = dimension_prediction(clear, noise_only, SPEC).first()
    assert same["rmse"] < 0.1 < 0.3 < far["rmse"]


def test_problem_presets(spark):
    real, good, bad = table(spark, 1, 0.1), table(spark, 3, 0.1), table(spark, 2, 30.0)
    got = {r["metric"]: r["value"] for r in run_problem_preset(real, good, SPEC, "binary_classification").collect()}
    assert list(got) == ["tree", "gbt", "logit", "mlp"] and min(got.values()) > 0.9
    line = SPEC.with_roles(numeric=("z",), target="x", task="regression")
    assert run_problem_preset(real, good, line, "regression").first()["value"] > 0.9
    loose = [table(spark, seed, 0.6) for seed in (1, 3)]  # MLlib's mixtures fail on nearly collinear columns
    near = {r["metric"]: r["value"] for r in run_problem_preset(*loose, SPEC, "gaussian_likelihood").collect()}
    far = {r["metric"]: r["value"] for r in run_problem_preset(loose[0], bad, SPEC, "gaussian_likelihood").collect()}
    assert list(near) == ["mixture_10", "mixture_30"] and all(near[k] > far[k] for k in near)
    with pytest.raises(ValueError, match="timeseries"):
        run_problem_preset(real, good, SPEC, "timeseries")
