"""Private aggregate and private model queries. Seeds are fixed so that the oracle can follow."""

import math

from pyspark.sql import functions as F

from tabloom.operators import ledger as lg
from tabloom.operators import private as dp
from tabloom.operators import private_models as pm
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd
from tabloom.plans.registry import query

U = fx.u_sql
BY = "o_orderpriority"
B = (0.0, 400000.0)


def orders(spark, d):
    return fx.table(spark, d, "orders")


def lap(salt, key, scale):
    u = U(1, salt, key)
    return f"(-sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)) * ({scale})::DOUBLE)"


def geo(value, salt, keys, eps, sens=1.0):
    r = eps / sens
    x = f"(({U(1, salt, *keys)} - 0.5) * (1 + {math.exp(-r)!r}::DOUBLE))"
    return f"({value} + sign({x}) * floor(ln(abs({x})) / {-r!r}::DOUBLE))"


@query("private_count", "DP1", f"""SELECT {BY}, greatest(0, least(count(*), {geo('count(*) FILTER (o_totalprice > 100000)', 'count-big', [BY], 0.5)}))::BIGINT AS value FROM orders GROUP BY 1""")
def _(spark, d):
    o = orders(spark, d).withColumn("big", (F.col("o_totalprice") > 100000).cast("int"))
    return dp.count_nonzero(o, "big", 0.5, by=[BY], seed=1)


@query("private_sum", "DP2", f"""WITH g AS (SELECT {BY}, sum(greatest(0, least(400000, o_totalprice))) AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT {BY}, round(greatest(0, least(n * 400000.0::DOUBLE, s + {lap('sum-o_totalprice', BY, 400000 / 0.5)})), 1) AS value FROM g""")
def _(spark, d):
    return rnd(dp.total(orders(spark, d), "o_totalprice", B, 0.5, by=[BY], seed=1), "value", places=1)


@query("private_sum_whole", "DP2", f"""WITH g AS (SELECT p_brand, sum(greatest(5, least(40, p_size))) AS s, count(*) AS n FROM part GROUP BY 1)
SELECT p_brand, greatest(n * 5, least(n * 40, {geo('s', 'sum-p_size', ['p_brand'], 0.5, 35.0)}))::BIGINT AS value FROM g""")
def _(spark, d):
    return dp.total(fx.table(spark, d, "part"), "p_size", (5, 40), 0.5, by=["p_brand"], seed=1)


@query("private_mean", "DP3", f"""WITH g AS (SELECT {BY}, avg(greatest(0, least(400000, o_totalprice))) AS m, count(*) AS n FROM orders GROUP BY 1)
SELECT {BY}, round(greatest(0, least(400000, m + {lap('mean-o_totalprice', BY, '400000 / n / 0.5::DOUBLE')})), 3) AS value FROM g""")
def _(spark, d):
    return rnd(dp.mean(orders(spark, d), "o_totalprice", B, 0.5, by=[BY], seed=1), "value", places=3)


VAR_SQL = f"""WITH RECURSIVE g AS (SELECT p_brand, var_pop(greatest(5, least(40, p_size))) AS v, count(*) AS n, (35 / count(*)) ** 2 * (count(*) - 1) AS s FROM part GROUP BY 1),
it AS (SELECT p_brand, v, s, 0 AS i, s / 0.8::DOUBLE AS b FROM g UNION ALL
  SELECT p_brand, v, s, i + 1, s / (0.8::DOUBLE - ln((2 - exp(-s / b) - exp(-(306.25::DOUBLE - s) / b)) / (1 - exp(-306.25::DOUBLE / b)))) FROM it WHERE i < 300),
p AS (SELECT p_brand, v, b, 0.5::DOUBLE * exp(-v / b) + {U(1, 'var-p_size', 'p_brand')} * (1 - 0.5::DOUBLE * exp((v - 306.25::DOUBLE) / b) - 0.5::DOUBLE * exp(-v / b)) AS p FROM it WHERE i = 300),
r AS (SELECT p_brand, CASE WHEN p < 0.5 THEN v + b * ln(2 * p) ELSE v - b * ln(2 * (1 - p)) END AS value FROM p)"""


@query("private_variance", "DP4", f"{VAR_SQL} SELECT p_brand, round(value, 4) AS value FROM r")
def _(spark, d):
    return rnd(dp.variance(fx.table(spark, d, "part"), "p_size", (5, 40), 0.8, by=["p_brand"], seed=1), "value", places=4)


@query("private_deviation", "DP5", f"{VAR_SQL} SELECT p_brand, round(sqrt(value), 4) AS value FROM r")
def _(spark, d):
    return rnd(dp.deviation(fx.table(spark, d, "part"), "p_size", (5, 40), 0.8, by=["p_brand"], seed=1), "value", places=4)


@query("private_histogram", "DP6", f"""WITH c AS (SELECT least(floor((o_totalprice - 50000) / 25000), 13) AS b, count(*) AS k FROM orders WHERE o_totalprice BETWEEN 50000 AND 400000 GROUP BY 1),
h AS (SELECT i AS b, coalesce(k, 0) AS k FROM range(14) t(i) LEFT JOIN c ON c.b = i),
v AS (SELECT b, greatest(0, {geo('k', 'hist', ['b'], 0.4)})::DOUBLE AS v FROM h)
SELECT b::INTEGER AS o_totalprice_bin, round(v / ((SELECT sum(v) FROM v) * 25000) * 1000000, 6) AS value FROM v""")
def _(spark, d):
    h = dp.histogram(orders(spark, d), {"o_totalprice": (50000.0, 400000.0, 14)}, 0.4, density=True, seed=1)
    return h.withColumn("value", F.round(F.col("value") * 1000000, 6))


@query("private_histogram_grid", "DP7", f"""WITH c AS (SELECT least(floor((l_quantity - 1) / 7), 6) AS a, least(floor((l_discount - 0) / 0.02::DOUBLE), 4) AS b, count(*) AS k FROM lineitem
WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2), g AS (SELECT x AS a, y AS b FROM range(7) s(x), range(5) t(y))
SELECT g.a::INTEGER AS l_quantity_bin, g.b::INTEGER AS l_discount_bin, greatest(0, {geo('coalesce(k, 0)', 'hist', ['g.a', 'g.b'], 0.4)})::DOUBLE AS value FROM g LEFT JOIN c ON c.a = g.a AND c.b = g.b""")
def _(spark, d):
    return dp.histogram(fx.table(spark, d, "lineitem"), {"l_quantity": (1.0, 50.0, 7), "l_discount": (0.0, 0.1, 5)}, 0.4, seed=1)


@query("private_quantile", "DP8", f"""WITH x AS (SELECT {BY}, greatest(0, least(400000, o_totalprice)) AS x FROM orders UNION ALL SELECT DISTINCT {BY}, 0.0::DOUBLE FROM orders),
c AS (SELECT {BY}, x, count(*) - CASE WHEN x = 0 THEN 1 ELSE 0 END AS m FROM x GROUP BY 1, 2),
r AS (SELECT {BY}, x, sum(m) OVER (PARTITION BY {BY} ORDER BY x) AS i, sum(m) OVER (PARTITION BY {BY}) AS n, coalesce(lead(x) OVER (PARTITION BY {BY} ORDER BY x), 400000) AS nx FROM c),
s AS (SELECT *, -abs(i - 0.5::DOUBLE * n) * 0.05::DOUBLE / 2 + ln(nx - x) - ln(-ln({U(1, 'gap-o_totalprice', BY, 'x')})) AS score FROM r WHERE nx > x),
b AS (SELECT {BY}, arg_max(struct_pack(x := x, nx := nx), score) AS g FROM s GROUP BY 1)
SELECT {BY}, round(g.x + {U(1, 'point-o_totalprice', BY)} * (g.nx - g.x), 3) AS value FROM b""")
def _(spark, d):
    return rnd(dp.quantile(orders(spark, d), "o_totalprice", 0.5, B, 0.05, by=[BY], seed=1), "value", places=3)


COVB = {"l_quantity": (1.0, 50.0), "l_extendedprice": (0.0, 80000.0), "l_discount": (0.0, 0.1)}


def cov_sql(eps):
    cols, arms = list(COVB), []
    x = {c: f"greatest({lo}, least({hi}, {c}))" for c, (lo, hi) in COVB.items()}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            w = 2 * (COVB[a][1] - COVB[a][0]) * (COVB[b][1] - COVB[b][0])
            nz = lap("cov", f"'{a}', '{b}'", f"{w!r}::DOUBLE / n / {eps / 6!r}::DOUBLE").replace(f"CAST('{a}', '{b}' AS VARCHAR)", f"'{a}', '{b}'") if eps else "0"
            arms.append(f"SELECT '{a}' AS a, '{b}' AS b, v + {nz} AS value FROM (SELECT covar_samp({x[a]}, {x[b]}) AS v, count(*) AS n FROM lineitem)")
    return " UNION ALL ".join(arms)


@query("private_covariance", "DP9", f"SELECT a, b, round(value, 3) AS value FROM ({cov_sql(3.0)})")
def _(spark, d):
    return rnd(dp.covariance(fx.table(spark, d, "lineitem"), COVB, 3.0, seed=1), "value", places=3)


@query("private_merged_moments", "DP10", """SELECT 'l_quantity' AS "column", count(*) AS n, round(avg(l_quantity) * 1.00012345::DOUBLE, 6) AS mean, round(var_pop(l_quantity), 5) AS variance FROM lineitem
UNION ALL SELECT 'l_discount', count(*), round(avg(l_discount) * 1.00012345::DOUBLE, 6), round(var_pop(l_discount), 5) FROM lineitem""")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("batch", F.date_trunc("month", "l_shipdate"))
    m = dp.merge_moments(dp.moments(li, ["l_quantity", "l_discount"], by=["batch"]))
    return m.select("column", "n", F.round(F.col("mean") * 1.00012345, 6).alias("mean"), F.round(F.col("m2") / F.col("n"), 5).alias("variance"))


@query("private_composition", "DP11", """WITH s AS (SELECT l_discount / 100 AS e, l_tax / 10000000 AS d FROM lineitem),
a AS (SELECT sum(e) AS s, sum((1 - exp(-e)) * e / (1 + exp(-e))) AS x, sum(e * e) AS q, sum(ln(1 - d)) AS l FROM s)
SELECT round(least(s, x + sqrt(2 * q * ln(1 / 1e-6)), x + sqrt(2 * q * ln(exp(1) + sqrt(q) / 1e-6))), 6) AS epsilon, round(1 - (1 - 1e-6) * exp(l), 8) AS delta FROM a""")
def _(spark, d):
    s = fx.table(spark, d, "lineitem").select((F.col("l_discount") / 100).alias("epsilon"), (F.col("l_tax") / 10000000).alias("delta"))
    return lg.composition(s, 1e-6).select(F.round("epsilon", 6).alias("epsilon"), F.round("delta", 8).alias("delta"))


@query("private_level_frequencies", "DP12", f"""WITH {fx.MIXED_SQL}, c AS (SELECT 'segment' AS col, segment AS v, count(*) AS n FROM mixed GROUP BY 2 UNION ALL SELECT 'nation', nation, count(*) FROM mixed GROUP BY 2)
SELECT col AS "column", v AS value, round(ln(greatest({geo('n', 'freq', ['col', 'v'], 0.25)}, 1)), 6) AS freq FROM c""")
def _(spark, d):
    return rnd(dp.level_frequencies(fx.mixed(spark, d), ["segment", "nation"], 0.5, log=True, seed=1), "freq")


@query("private_standard_scale", "SCL11 DM8", f"""WITH RECURSIVE g AS (SELECT avg(greatest(0, least(400000, o_totalprice))) AS m, var_pop(greatest(0, least(400000, o_totalprice))) AS v, count(*)::DOUBLE AS n FROM orders),
z AS (SELECT greatest(0, least(400000, m + {lap("mean-o_totalprice", "'all'", '400000 / n / 0.5::DOUBLE')})) AS m, v, (400000 / n) ** 2 * (n - 1) AS s FROM g),
it AS (SELECT m, v, s, 0 AS i, s / 0.5::DOUBLE AS b FROM z UNION ALL SELECT m, v, s, i + 1, s / (0.5::DOUBLE - ln((2 - exp(-s / b) - exp(-(40000000000.0::DOUBLE - s) / b)) / (1 - exp(-40000000000.0::DOUBLE / b)))) FROM it WHERE i < 100),
p AS (SELECT m, v, b, 0.5::DOUBLE * exp(-v / b) + {U(1, 'var-o_totalprice', "'all'")} * (1 - 0.5::DOUBLE * exp((v - 40000000000.0::DOUBLE) / b) - 0.5::DOUBLE * exp(-v / b)) AS p FROM it WHERE i = 100),
f AS (SELECT m, sqrt(CASE WHEN p < 0.5 THEN v + b * ln(2 * p) ELSE v - b * ln(2 * (1 - p)) END) AS sd FROM p)
SELECT o_orderkey, round((o_totalprice - m) / (sd * 4), 5) AS o_totalprice FROM orders, f""")
def _(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_totalprice")
    return rnd(dp.fit_private_standard(o, {"o_totalprice": B}, 1.0, width=4.0, seed=1).transform(o), "o_totalprice", places=5)


@query("private_min_max_scale", "SCL11")
def _(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_totalprice")
    return rnd(dp.fit_private_min_max(o, {"o_totalprice": (0.0, 600000.0)}, 1.0, seed=1).transform(o), "o_totalprice", places=5)


# --- models -------------------------------------------------------------------------

INF = math.inf
LX = {"l_quantity": (1.0, 50.0)}
PB = (0.0, 120000.0)


@query("model_linear_regression", "DM1", """SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS weight FROM lineitem
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 5) FROM lineitem""")
def _(spark, d):
    m = pm.linear_regression(fx.table(spark, d, "lineitem"), LX, "l_extendedprice", (0.0, 1e7), INF).frame(spark)
    return m.select(
        "term", F.when(F.col("term") == "intercept", F.round("weight", 4)).otherwise(F.round("weight", 5)).alias("weight"))


@query("model_linear_regression_private", "DM1")
def _(spark, d):
    m = pm.linear_regression(fx.table(spark, d, "lineitem"), {**LX, "l_discount": (0.0, 0.1)}, "l_extendedprice", PB, 2.0, seed=1)
    return rnd(m.frame(spark), "weight", places=3)


@query("model_naive_bayes", "DM2", f"""WITH {fx.MIXED_SQL}, s AS (SELECT status, ln(count(*) / (SELECT count(*) FROM mixed)) AS lp, avg(price) AS a, var_pop(price) AS va, avg(balance) AS b, var_pop(balance) AS vb FROM mixed GROUP BY 1),
j AS (SELECT id, s.status, lp - (price - a) ** 2 / (2 * va) - 0.5::DOUBLE * ln(2 * pi() * va) - (balance - b) ** 2 / (2 * vb) - 0.5::DOUBLE * ln(2 * pi() * vb) AS z FROM mixed, s)
SELECT id, arg_max(status, z) AS prediction FROM j GROUP BY 1""")
def _(spark, d):
    m = fx.mixed(spark, d)
    nb = pm.naive_bayes(m, {"price": (0.0, 1e6), "balance": (-1e4, 1e5)}, "status", INF)
    return nb.predict(m).select("id", "prediction")


@query("model_naive_bayes_private", "DM2")
def _(spark, d):
    m = fx.mixed(spark, d)
    nb = pm.naive_bayes(m, {"price": (0.0, 6e5), "balance": (-1e3, 1e4)}, "status", 1.0, seed=1)
    return nb.predict(m).groupBy("status", "prediction").agg(F.count("*").alias("n"))


KB = {"l_quantity": (0.0, 50.0), "l_discount": (0.0, 0.1)}


def kmeans_sql(rounds=7):
    q = []
    q.append("c0 AS (SELECT 0 AS i, 12.5::DOUBLE AS x, 0.025::DOUBLE AS y UNION ALL SELECT 1, 37.5, 0.075)")
    for r in range(rounds):
        q.append(f"""c{r + 1} AS (SELECT k AS i, avg(l_quantity) AS x, avg(l_discount) AS y FROM (SELECT l_quantity, l_discount,
          (SELECT arg_min(i, struct_pack(d := (l_quantity - x) ** 2 + (l_discount - y) ** 2, i := i)) FROM c{r}) AS k FROM lineitem) GROUP BY 1)""")
    return f"WITH {', '.join(q)} SELECT i AS cluster, round(x, 4) AS l_quantity, round(y, 6) AS l_discount FROM c{rounds}"


@query("model_k_means", "DM3", kmeans_sql())
def _(spark, d):
    import numpy as np

    m = pm.k_means(fx.table(spark, d, "lineitem"), KB, 2, INF, start=np.array([[12.5, 0.025], [37.5, 0.075]]))
    rows = [(i, round(float(p[0]), 4), round(float(p[1]), 6)) for i, p in enumerate(m.points)]
    return spark.createDataFrame(rows, "cluster int, l_quantity double, l_discount double")


@query("model_k_means_private", "DM3")
def _(spark, d):
    li = fx.table(spark, d, "lineitem")
    m = pm.k_means(li, KB, 4, 2.0, seed=1)
    return m.assign(li).groupBy("cluster").agg(F.count("*").alias("n"))


@query("model_components", "DM4", """WITH s AS (SELECT avg(l_quantity) AS mq, avg(l_tax * 500) AS mt, var_samp(l_quantity) AS a, var_samp(l_tax * 500) AS b, covar_samp(l_quantity, l_tax * 500) AS c FROM lineitem),
e AS (SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS l FROM s), v AS (SELECT *, l - b AS vx, c AS vy FROM e),
n AS (SELECT *, CASE WHEN (CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END) < 0 THEN -1 ELSE 1 END / sqrt(vx * vx + vy * vy) AS k FROM v)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) * vx * k + (l_tax * 500 - mt) * vy * k, 4) AS pc_1 FROM lineitem, n""")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("tax", F.col("l_tax") * 500)
    m = pm.components(li, {"l_quantity": (0.0, 60.0), "tax": (0.0, 60.0)}, 1, INF)
    return rnd(m.transform(li).select("l_orderkey", "l_linenumber", "pc_1"), "pc_1", places=4)


@query("model_components_private", "DM4")
def _(spark, d):
    li = fx.table(spark, d, "lineitem")
    m = pm.components(li, {"l_quantity": (0.0, 50.0), "l_discount": (0.0, 0.1), "l_tax": (0.0, 0.1)}, 2, 3.0, seed=1)
    return rnd(m.transform(li).select("l_orderkey", "l_linenumber", "pc_1", "pc_2"), "pc_1", "pc_2", places=4)


@query("model_logistic_regression", "DM5")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "status", (F.col("price") / 5e5).alias("price"), (F.col("balance") / 1e4).alias("balance"))
    lr = pm.logistic_regression(m, ["price", "balance"], "status", 1.5, 5.0, seed=1)
    return lr.predict(m).groupBy("status", "prediction").agg(F.count("*").alias("n"))


@query("model_random_forest", "DM6")
def _(spark, d):
    m = fx.mixed(spark, d)
    seg = sorted(r[0] for r in m.select("segment").distinct().collect())
    f = pm.random_forest(m, "id", {"segment": seg, "price": (0.0, 6e5), "balance": (-1e3, 1e4)}, "status", ["F", "O", "P"], 2.0, seed=1)
    return f.predict(m, "id").groupBy("status", "prediction").agg(F.count("*").alias("n"))


@query("model_covariance_regression", "DM7", """SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 5) AS weight,
round(sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 6) AS error FROM lineitem""")
def _(spark, d):
    m = pm.covariance_regression(fx.table(spark, d, "lineitem"), {"l_quantity": (0.0, 1e3), "l_extendedprice": (0.0, 1e7)}, ["l_quantity"], "l_extendedprice", INF)
    return spark.createDataFrame([("l_quantity", round(float(m.weights[0]), 5), round(float(m.errors[0]), 6))], "term string, weight double, error double")


@query("model_standard_scaler", "DM8")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("batch", F.date_trunc("year", "l_shipdate"))
    s = dp.merge_moments(dp.moments(li, ["l_quantity", "l_discount"], by=["batch"]))
    return rnd(pm.standard_scaler(s, KB, 1.0, seed=1), "mean", "variance")
