"""Scoring queries."""

from pyspark.sql import functions as F

from tabloom.operators import scoring as so
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd
from tabloom.plans.registry import query
from tabloom.plans.splitting import poisson_sql

U = fx.u_sql

CLASS_SQL = fx.PRED_SQL + """, k AS (SELECT c, (SELECT count(*) FROM pr WHERE label = c) AS s, (SELECT count(*) FROM pr WHERE pred = c) AS q,
  (SELECT count(*) FROM pr WHERE label = c AND pred = c) AS t FROM (SELECT DISTINCT label AS c FROM pr))"""


@query("score_accuracy", "SCO1", f"""WITH {CLASS_SQL} SELECT round(sum(t) / sum(s), 6) AS accuracy, round(avg(t / s), 6) AS bacc,
round(exp(avg(ln(t / s))), 6) AS gmean FROM k""")
def _(spark, d):
    r = so.label_scores(fx.predictions(spark, d))
    return rnd(r.select("accuracy", "bacc", "gmean"), "accuracy", "bacc", "gmean")


@query("score_f1", "SCO2", f"""WITH {CLASS_SQL} SELECT round(avg(2 * t / (s + q)), 6) AS f1_macro, round(sum(s * 2 * t / (s + q)) / sum(s), 6) AS f1_weighted,
round(max(CASE WHEN c = 'F' THEN 2 * t / (s + q) END), 6) AS f1 FROM k""")
def _(spark, d):
    r = so.label_scores(fx.predictions(spark, d), positive="F")
    return rnd(r.select("f1_macro", "f1_weighted", "f1"), "f1_macro", "f1_weighted", "f1")


@query("score_ranking", "SCO3", f"""WITH {fx.SCORES_SQL}, r AS (SELECT y, p, (rank() OVER (ORDER BY p) + rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM sc),
a AS (SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc, avg((y - p) ** 2) AS brier, sum(y) AS np FROM r),
g AS (SELECT p, sum(y) AS pos, sum(sum(y)) OVER (ORDER BY p DESC) AS cp, sum(count(*)) OVER (ORDER BY p DESC) AS cn FROM sc GROUP BY p)
SELECT round(auc, 6) AS auc, round((SELECT sum(pos * cp / cn) FROM g) / np, 6) AS aps, round(brier, 6) AS brier FROM a""")
def _(spark, d):
    return rnd(so.score_metrics(fx.scores(spark, d)), "auc", "aps", "brier")


@query("score_hard_auc", "SCO4", f"""WITH {fx.PRED_SQL} SELECT round((avg(CAST(pred = 'F' AS INTEGER)) FILTER (label = 'F')
+ sum(CAST(pred = label AS INTEGER)) FILTER (label <> 'F') / count(*) FILTER (label <> 'F')) / 2, 6) AS hard_auc FROM pr""")
def _(spark, d):
    return rnd(so.label_scores(fx.predictions(spark, d), positive="F").select("hard_auc"), "hard_auc")


@query("score_regression", "SCO5", f"""WITH {fx.REGRESSION_SQL}, p AS (SELECT price AS y, quantity * 1500 AS p FROM reg)
SELECT round(avg(abs(y - p)), 3) AS mae, round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 6) AS r2 FROM p, (SELECT avg(y) AS m FROM p)""")
def _(spark, d):
    m = fx.mixed_regression(spark, d).select(F.col("price").alias("y"), (F.col("quantity") * 1500).alias("p"))
    return so.regression_scores(m).select(F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"))


@query("score_one_vs_rest_auc", "SCO6", f"""WITH t AS (SELECT o_orderstatus AS c, round(o_totalprice / 600000, 3) AS pf, round({U(9, 'p', 'o_orderkey')}, 2) AS po, 0.5::DOUBLE AS pp FROM orders),
l AS (SELECT 'F' AS k, CAST(c = 'F' AS INTEGER) AS y, pf AS p FROM t UNION ALL SELECT 'O', CAST(c = 'O' AS INTEGER), po FROM t UNION ALL SELECT 'P', CAST(c = 'P' AS INTEGER), pp FROM t),
r AS (SELECT k, y, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2 AS rk FROM l),
a AS (SELECT k, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc, sum(y) AS n FROM r GROUP BY 1)
SELECT round(sum(auc * n) / sum(n), 6) AS auc_ovr_weighted FROM a""")
def _(spark, d):
    from tabloom.functions.rng import u01

    t = fx.table(spark, d, "orders").select(F.col("o_orderstatus").alias("c"), F.round(F.col("o_totalprice") / 600000, 3).alias("pf"),
                                            F.round(u01(9, "p", "o_orderkey"), 2).alias("po"), F.lit(0.5).alias("pp"))
    return rnd(so.weighted_one_vs_rest_auc(t, "c", {"F": "pf", "O": "po", "P": "pp"}), "auc_ovr_weighted")


@query("score_bootstrap", "SCO7", f"""WITH {fx.SCORES_SQL}, b AS (SELECT y, p, r, {poisson_sql(U(0, 'boot', 'id', 'r'))} AS w FROM sc, range(1, 101) t(r)),
g AS (SELECT r, p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM b GROUP BY 1, 2),
c AS (SELECT *, sum(neg) OVER (PARTITION BY r ORDER BY p) - neg / 2 AS below, sum(pos) OVER (PARTITION BY r ORDER BY p DESC) AS cp,
  sum(pos + neg) OVER (PARTITION BY r ORDER BY p DESC) AS cn FROM g),
m AS (SELECT r, sum(pos * below) / (sum(pos) * sum(neg)) AS auc, sum(pos * cp / nullif(cn, 0)) / sum(pos) AS aps,
  sum(pos * (1 - p) ** 2 + neg * p * p) / sum(pos + neg) AS brier, sum(CASE WHEN p > 0.5 THEN pos ELSE neg END) / sum(pos + neg) AS acc FROM c GROUP BY 1)
SELECT round(avg(auc), 6) AS auc, round(avg(aps), 6) AS aps, round(avg(brier), 6) AS brier, round(avg(acc), 6) AS acc FROM m""")
def _(spark, d):
    return rnd(so.bootstrap_scores(fx.scores(spark, d), "id", replicates=100), "auc", "aps", "brier", "acc")


@query("score_imbalance", "SCO8", "SELECT round(avg(toxic), 6) AS positive_rate FROM labels")
def _(spark, d):
    return rnd(so.imbalance(fx.table(spark, d, "labels"), "toxic"), "positive_rate")
