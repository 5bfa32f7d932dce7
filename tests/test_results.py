"""Result analytics where a table of published numbers or a constant score decides."""

import math

import numpy as np
import pytest

from tabloom.functions import noise
from tabloom.operators import private_models, results


def test_studentised_range_matches_printed_tables():
    # Upper 5 % points for 3, 10, 20 and 100 groups, infinite degrees of freedom.
    assert [results.studentised_range(k) for k in (3, 10, 20, 100)] == pytest.approx([3.314, 4.474, 5.012, 6.085], abs=0.01)


def test_post_hoc_test_takes_any_number_of_items(spark):
    rows = [(f"d{b}", f"c{i:02}", float(i + (b * 7 + i * 3) % 5)) for b in range(12) for i in range(25)]
    df = spark.createDataFrame(rows, "dataset string, a string, rank double")
    got = {(r["a"], r["b"]): r["win"] for r in results.nemenyi(df).collect()}
    limit = results.studentised_range(25) * math.sqrt(25 * 26 / (12 * 12))
    score = np.array([r[2] for r in rows]).reshape(12, 25)
    mean = np.mean([[(row < x).sum() + ((row == x).sum() + 1) / 2 for x in row] for row in score], axis=0)
    assert len(got) == 625
    for i in range(25):
        for j in range(25):
            d = mean[i] - mean[j]
            assert got[f"c{i:02}", f"c{j:02}"] == (0.5 if abs(d) <= limit else 1.0 if d > 0 else 0.0)


def test_nothing_wins_without_a_significant_friedman_test(spark):
    rows = [(f"d{b}", f"c{(i + b) % 4}", float(i)) for b in range(4) for i in range(4)]
    assert {r["win"] for r in results.nemenyi(spark.createDataFrame(rows, "dataset string, a string, rank double")).collect()} == {0.5}


def test_constant_difference_wins(spark):
    rows = [("d", g, "t", s, v) for g, v in (("x", 0.75), ("y", 0.5), ("z", 0.5)) for s in range(5)]
    df = spark.createDataFrame([(d, "e", g, t, s, v) for d, g, t, s, v in rows], "dataset string, encoder string, generator string, teacher string, random_state int, v double")
    for resample in (None, (5, 400, 100)):
        got = {(r["a"].split()[1], r["b"].split()[1]): (r["win"], r["p_value"]) for r in results.paired_tests(df, "v", resample=resample).collect()}
        assert got["x", "y"] == (1.0, 0.0) and got["y", "x"] == (0.0, 0.0) and got["y", "z"][0] == 0.5


def test_bounded_domain_scale_solves_its_equation():
    for s, w, e, d in ((1.0, 1.0, 1.0, 0.01), (1.0, 3.0, 0.1, 0.0), (2.0, 500.0, 5.0, 0.0)):
        b = e - math.log1p(-d)
        rate = b / (2 * s)
        for _ in range(60):
            rate = noise._newton_rate(rate, s, w, b, math.exp, math.log, max)
        c = (2 - math.exp(-s * rate) - math.exp(-(w - s) * rate)) / (1 - math.exp(-w * rate))
        assert s * rate + math.log(c) == pytest.approx(b)


def test_bingham_moments():
    rng = np.random.default_rng(0)
    x = np.array([private_models.bingham_vector(np.diag([0.0, 2.0, 5.0]), rng) for _ in range(4000)])
    y = rng.standard_normal((200_000, 3))
    y = (y / np.linalg.norm(y, axis=1, keepdims=True)) ** 2
    w = np.exp(y @ np.array([0.0, 2.0, 5.0]))
    assert np.allclose((x * x).mean(axis=0), (w[:, None] * y).sum(axis=0) / w.sum(), atol=0.02)


def test_forest_depth_follows_the_features_alone():
    assert [private_models.tree_depth(*f) for f in ((0, 3), (1, 0), (2, 1), (5, 4), (10, 2), (40, 0))] == [1, 2, 2, 7, 9, 15]


def test_experiment_covers_all_rows(spark, sf, monkeypatch):
    from tabloom.operators import models
    from tabloom.plans import fixtures, load_all

    seen = {}
    monkeypatch.setattr(models, "experiment", lambda df, spec, make, **kw: seen.update(kw) or spark.range(1))
    load_all()["experiment_result_rows"].run(spark, sf)
    total = fixtures.mixed(spark, sf).count()
    assert seen["train_size"] == total - math.ceil(total * 0.2) and seen["sizes"][-1] == 2 * seen["train_size"] and seen["max_test"] is None
