import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import noise
from tabloom.functions.ordering import exact_quantiles, global_rank, running_totals
from tabloom.operators import clean, encode, fidelity, generate, private, private_models, split
from tabloom.operators import scale as sc
from tabloom.operators.knn import nearest
from tabloom.operators.ledger import BudgetError, Ledger
from tabloom.plans import fixtures as fx
from tabloom.spec import TableSpec


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows, a third of them with one key and one value."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}", 7.0 if i % 3 == 0 else float((i * 37) % 101)) for i in range(900)]
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(7)


def test_running_totals_with_a_hot_key(skewed):
    got = running_totals(skewed, ["id"], {"c": F.lit(1), "s": F.col("v")}, by=["k"], totals={"c": "n"}, lead={"nx": "id"}).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("id")
        assert list(g.c) == list(range(1, len(g) + 1)) and (g.n == len(g)).all()
        assert np.allclose(g.s, g.v.cumsum())
        assert list(g.nx[:-1]) == list(g.id[1:]) and math.isnan(g.nx.iloc[-1])


def test_global_rank_does_not_depend_on_partitions(skewed):
    a = {r["id"]: r["rank"] for r in global_rank(skewed, ["v", "id"]).collect()}
    b = {r["id"]: r["rank"] for r in global_rank(skewed.repartition(3), ["v", "id"]).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 901))


def test_exact_quantiles(skewed):
    got = exact_quantiles(skewed, "v", [0.0, 0.05, 0.5, 0.93, 1.0]).first()
    v = skewed.toPandas().v
    assert np.allclose(list(got), np.quantile(v, [0.0, 0.05, 0.5, 0.93, 1.0]))


@pytest.mark.parametrize("dims", [1, 3])
def test_nearest_matches_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.round(rng.normal(size=(700, dims)), 2)
    x[::3] = x[0]  # a third of all rows are equal
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {r["id"]: [(n["dist"], n["id"]) for n in r["neighbours"]] for r in nearest(df, df, 4, exclude_self=True).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert np.allclose([a for a, _ in got[i]], [a for a, _ in want])
        assert [b for _, b in got[i]] == [b for _, b in want]


def test_equal_tables_are_identical(spark, sf):
    m = fx.mixed(spark, sf)
    got = {r["metric"]: r["value"] for r in fidelity.fidelity_report(m, m, fx.MIXED).collect()}
    assert got == pytest.approx({"jsd": 0.0, "wd": 0.0, "ks": 1.0}, abs=1e-9)


def test_report_without_columns(spark, sf):
    m = fx.mixed(spark, sf)
    got = {r["metric"]: r["value"] for r in fidelity.fidelity_report(m, m, fx.MIXED.with_roles(numeric=())).collect()}
    assert got["wd"] == 0.0 and got["ks"] == 1.0


def test_round_trips(spark, sf):
    m = fx.mixed(spark, sf).select("id", "segment", "price")
    spec = TableSpec("id", ("segment",), ("price",))
    p = sc.Processor(spec).fit(m)
    a = {r["id"]: (r["segment"], round(r["price"], 4)) for r in p.inverse(p.transform(m)).collect()}
    b = {r["id"]: (r["segment"], round(r["price"], 4)) for r in m.collect()}
    assert a == b


def test_processor_rejects_bad_roles(spark, sf):
    with pytest.raises(ValueError):
        TableSpec("id", ("a",), ("a",))
    with pytest.raises(ValueError):
        sc.Processor(TableSpec("id", (), ("price",))).fit(fx.mixed(spark, sf))
    with pytest.raises(RuntimeError):
        sc.Processor(TableSpec("id", (), ("price",))).transform(fx.mixed(spark, sf))


def test_imputers_keep_row_counts(spark, sf):
    m = clean.markers_to_null(fx.mixed_nulls(spark, sf), ["priority"])
    full = clean.impute_mode(m, ["priority", "segment"])
    assert full.count() == m.count() and full.where("priority is null or segment is null").count() == 0
    assert clean.drop_incomplete(m, fx.MIXED).count() < m.count()


def test_fold_sizes_and_quotas(skewed):
    f = split.stratified_k_folds(skewed, "id", "k", 5).groupBy("fold").count().toPandas()
    assert f["count"].sum() == 900 and f["count"].max() - f["count"].min() <= 1
    q = split.class_quotas(skewed, "k", 100).agg(F.sum("quota")).first()[0]
    assert q == 100


def test_unknown_and_missing_codes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, c string")
    b = spark.createDataFrame([(1, "y"), (2, "new"), (3, None)], "id long, c string")
    codes = encode.fit_ordinal(a, ["c"], "id")
    assert [r["c"] for r in codes.transform(b).orderBy("id").collect()] == [2, -1, -2]


def test_noise_off_is_exact(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    want = li.agg(F.avg("l_quantity").alias("m"), F.var_pop("l_quantity").alias("v")).first()
    assert private.mean(li, "l_quantity", (0, 100), math.inf).first()[0] == pytest.approx(want["m"])
    assert private.variance(li, "l_quantity", (0, 100), math.inf).first()[0] == pytest.approx(want["v"])
    with pytest.raises(ValueError):
        private.mean(li, "l_quantity", None, 1.0)


def test_ledger():
    led = Ledger(1.0)
    led.spend(0.4).spend(0.5)
    assert led.remaining()[0] == pytest.approx(0.1)
    with pytest.raises(BudgetError):
        led.spend(0.2)
    many = Ledger(slack=1e-6)
    for _ in range(500):
        many.spend(0.01)
    assert many.total()[0] < 5.0


def test_gaussian_calibration():
    s = noise.gaussian_analytic_scale(1.0, 1e-5, 1.0)
    assert s < noise.gaussian_scale(1.0, 1e-5, 1.0) and s == pytest.approx(3.73, abs=0.02)
    assert 0 < generate.zcdp_rho(1.0, 1e-9) < 1.0


def test_logistic_regression_without_noise(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (2000, 2))
    y = (x @ [3.0, -2.0] + 0.5 + rng.logistic(size=2000) > 0).astype(int)
    df = spark.createDataFrame([(int(t), float(a), float(b)) for t, (a, b) in zip(y, x)], "y int, a double, b double")
    w = private_models.logistic_regression(df, ["a", "b"], "y", 2.0, math.inf, c=100.0).weights[0]
    assert w == pytest.approx([3.0, -2.0, 0.5], abs=0.5)


def test_tree_network_keeps_levels(spark, sf):
    m = fx.mixed(spark, sf)
    s = generate.fit_tree_network(m, fx.MIXED).sample(500)
    assert s.count() == 500
    assert {r[0] for r in s.select("status").distinct().collect()} <= {"F", "O", "P"}
