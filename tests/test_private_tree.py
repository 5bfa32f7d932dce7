import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators.generate import fit_private_network, fit_private_tree, merged_codes
from tabloom.operators.ledger import BudgetError, Ledger
from tabloom.operators.self_label import fit_self_labelled
from tabloom.spec import TableSpec

BOUNDS = {"v": (0.0, 100.0)}
SPEC = TableSpec("id", ("k",), ("v",), "y", "multiclass")


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows: a third hot, over 200 levels that are seen once or twice, y follows v."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(4000):
        v = float(rng.uniform(0, 100))
        k = "hot" if i % 3 == 0 else f"rare{i // 10 % 250}" if i % 10 == 1 else f"k{i % 4}"
        rows.append((i, k, v, "high" if v > 50 else "low"))
    return spark.createDataFrame(rows, "id long, k string, v double, y string").repartition(5)


def test_merged_codes_number_every_level_once(spark):
    counts = {("a", i): [90.0, -3.0, 55.0, 2.0, 0.0][i] for i in range(5)} | {("b", i): 70.0 for i in range(3)} | {("c", i): 1.0 for i in range(2)}
    noisy = spark.createDataFrame([(c, i, n) for (c, i), n in counts.items()], "column string, value int, n double")
    got = {(r["column"], r["value"]): (r["code"], r["place"]) for r in merged_codes(noisy, 10.0).collect()}
    assert got == {("a", 0): (0, 1), ("a", 2): (1, 1), ("a", 1): (2, 1), ("a", 3): (2, 2), ("a", 4): (2, 3),
                   ("b", 0): (0, 1), ("b", 1): (1, 1), ("b", 2): (2, 1), ("c", 0): (0, 1), ("c", 1): (0, 2)}


def test_tree_keeps_hot_levels_and_draws_merged_ones_back(skewed):
    net = fit_private_tree(skewed, SPEC, 5.0, bounds=BOUNDS, seed=3)
    got = net.sample(5000, seed=2).toPandas()
    assert len(got) == 5000 and not got.isna().any().any() and set(got.columns) == {"row", "k", "v", "y"}
    assert abs((got.k == "hot").mean() - 1 / 3) < 0.05
    rare = got[got.k.str.startswith("rare")]
    assert 100 < len(rare) < 900 and rare.k.nunique() > 50
    assert ((got.v > 50) == (got.y == "high")).mean() > 0.8


def test_a_column_of_many_levels(spark):
    wide = spark.range(60000).select("id", (F.col("id") % 50000).cast("string").alias("k"), (F.col("id") % 3).cast("string").alias("y"))
    net = fit_private_tree(wide, TableSpec("id", ("k",), (), "y", "multiclass"), 3.0, seed=1)
    got = net.sample(2000).agg(F.count("k").alias("n"), F.countDistinct("k").alias("k")).first()
    assert got["n"] == 2000 and got["k"] > 1500


def test_bounds_are_needed_and_budgets_compose(skewed):
    for fit in (fit_private_tree, fit_private_network):
        with pytest.raises(ValueError, match="bounds"):
            fit(skewed, SPEC, 1.0, seed=1)
        with pytest.raises(BudgetError):
            fit(skewed, SPEC, 1.0, bounds=BOUNDS, ledger=Ledger(0.5), seed=1)
    outer = Ledger(4.0, 1e-6)
    model = fit_self_labelled(skewed, SPEC, BOUNDS, 3.0, ledger=outer, seed=1)
    assert [e for e, _ in model.spent.spent] == pytest.approx([2.7, 0.3])
    assert model.spent.total() == pytest.approx((3.0, 1e-9)) and outer.total() == pytest.approx((3.0, 1e-9))
    with pytest.raises(BudgetError):
        fit_self_labelled(skewed, SPEC, BOUNDS, 3.0, ledger=outer, seed=1)
    assert outer.total()[0] == pytest.approx(3.0)
    rows = model.held_out.first()
    assert 700 < rows["n"] < 900 and rows["accuracy"] > 0.8
    got = model.sample(1000).toPandas()
    assert len(got) == 1000 and ((got.v > 50) == (got.y == "high")).mean() > 0.8
