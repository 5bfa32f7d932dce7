import itertools

import numpy as np
import pytest

from tabloom.operators.ledger import BudgetError, Ledger
from tabloom.operators.multiplicative import REGIONS, Factors, fit_multiplicative_weights, random_ranges, range_counts
from tabloom.spec import TableSpec

SPEC = TableSpec("id", ("k", "c"), ("v",), None)


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; a third of them are equal, and v follows k."""
    rng = np.random.default_rng(5)
    rows = [(i, "hot", "a", 10.0) if i % 3 == 0 else (i, f"k{i % 7}", "ab"[i % 2], float(12 * (i % 7) + rng.uniform(0, 10))) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k string, c string, v double").repartition(5)


def test_range_counts_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, [4, 30], (2000, 2))
    x[::3] = x[0]
    codes = spark.createDataFrame([(int(a), int(b)) for a, b in x] + [(None, 3)], "a int, b int").repartition(6)
    low, high = random_ranges([4, 30], 50, rng)
    want = [((x >= lo) & (x < hi)).all(axis=1).sum() for lo, hi in zip(low, high, strict=True)]
    assert range_counts(codes, ["a", "b"], low, high).tolist() == want
    assert range_counts(codes.limit(0), ["a", "b"], low, high).tolist() == [0] * 50


def test_factors_are_the_dense_weights(spark):
    """The same updates on a dense array of cells give the same weights, answers and regions."""
    rng, sizes = np.random.default_rng(2), [5, 40, 12]
    low, high = random_ranges(sizes, 60, rng)
    box = lambda j: tuple(slice(a, b) for a, b in zip(low[j], high[j], strict=True))
    dense, model, answers = np.full(sizes, 900 / np.prod(sizes)), Factors(sizes, 900), []
    for j in range(9):
        answers.append(float(rng.uniform(-20, 900)))
        model.add_box(low[j], high[j])
        model.fit(answers, 4)
        for _, i in itertools.product(range(4), range(j + 1)):
            dense[box(i)] *= np.exp((answers[i] - dense[box(i)].sum()) / (2 * 900))
            dense *= 900 / dense.sum()
        assert np.allclose(model.answers(low, high, block=7), [dense[box(i)].sum() for i in range(60)])
    rows = model.regions(spark, ["a", "b", "c"]).collect()
    assert sum(r["_size_a"] * r["_size_b"] * r["_size_c"] for r in rows) == np.prod(sizes)
    total = sum(r["w"] for r in rows)
    for r in rows:
        part = dense[tuple(slice(r[f"_first_{c}"], r[f"_first_{c}"] + r[f"_size_{c}"]) for c in "abc")]
        assert np.allclose(part, part.flat[0]) and np.isclose(part.sum(), 900 * r["w"] / total)


def test_full_rounds_learn_a_skewed_table(skewed):
    model = fit_multiplicative_weights(skewed, SPEC, {"v": (0.0, 100.0)}, 50.0, groups=[["k", "v"], ["c"]], seed=3)
    assert len(model.factors[0].rates) == 30 and model.factors[0].mass.size <= 8 * 61
    got = model.sample(6000, seed=4).toPandas()
    assert len(got) == 6000 and list(got.columns) == ["row", "k", "c", "v"] and not got.isna().any().any()
    assert 0.25 < (got.k == "hot").mean() < 0.42 and 0.6 < (got.c == "a").mean() < 0.73
    again = model.sample(6000, seed=4).toPandas()
    assert got.sort_values("row").reset_index(drop=True).equals(again.sort_values("row").reset_index(drop=True))


def test_budget_and_arguments(skewed):
    ledger = Ledger(1.0)
    few = {"queries": 4, "rounds": 2, "inner": 2, "seed": 1}
    fit_multiplicative_weights(skewed, SPEC, {"v": (0.0, 100.0)}, 0.7, ledger=ledger, **few)
    assert np.isclose(ledger.total()[0], 0.7)
    with pytest.raises(BudgetError):
        fit_multiplicative_weights(skewed, SPEC, {"v": (0.0, 100.0)}, 0.7, ledger=ledger, **few)
    for wrong in ({"bounds": {}}, {"groups": [["k"]]}, {"queries": 1}):
        with pytest.raises(ValueError):
            fit_multiplicative_weights(skewed, SPEC, epsilon=1.0, **({"bounds": {"v": (0.0, 1.0)}} | few | wrong))
    wide = TableSpec("id", (), tuple("defgh"), None)
    df = skewed.selectExpr("id", *[f"v AS {c}" for c in "defgh"])
    with pytest.raises(ValueError, match=str(REGIONS)):
        fit_multiplicative_weights(df, wide, {c: (0.0, 1.0) for c in "defgh"}, 1.0)


def test_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], "id long, v double")
    spec = TableSpec("id", (), ("v",), None)
    even = fit_multiplicative_weights(empty, spec, {"v": (0.0, 10.0)}, 1.0, bins=10, seed=1).sample(200, seed=1).toPandas()
    assert len(even) == 200 and even.v.nunique() == 10
    nulls = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0)], "id long, v double")
    assert fit_multiplicative_weights(nulls, spec, {"v": (0.0, 10.0)}, 1.0, bins=10, seed=1).sample(50).count() == 50
