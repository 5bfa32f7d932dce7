"""Fidelity queries."""

from pyspark.sql import functions as F

from tabloom.operators import fidelity as fid
from tabloom.operators.profile import associations
from tabloom.plans import fixtures as fx
from tabloom.plans.registry import query


def rnd(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def unpivot_sql(src, cols, cast="VARCHAR"):
    return " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS {cast}) AS v FROM {src}" for c in cols)


CATS, NUMS = fx.CATS, fx.NUMS

SHARES_SQL = fx.HALVES_SQL + f""", rc AS (SELECT col, v, count(*) AS n FROM ({unpivot_sql('rl', CATS)}) GROUP BY 1, 2),
sc AS (SELECT col, v, count(*) AS n FROM ({unpivot_sql('sy', CATS)}) GROUP BY 1, 2),
sh AS (SELECT coalesce(rc.col, sc.col) AS col, coalesce(rc.v, sc.v) AS v,
  coalesce(rc.n, 0) / (SELECT count(*) FROM rl) AS p, coalesce(sc.n, 0) / (SELECT count(*) FROM sy) AS q
  FROM rc FULL JOIN sc ON rc.col = sc.col AND rc.v = sc.v),
jsd AS (SELECT col, sqrt(greatest(0, 0.5::DOUBLE * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
  + 0.5::DOUBLE * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END))) AS jsd FROM sh GROUP BY 1)"""

GAPS_SQL = f""", nv AS (SELECT col, v, 1 AS r, 0 AS s FROM ({unpivot_sql('rl', NUMS, 'DOUBLE')})
  UNION ALL SELECT col, v, 0, 1 FROM ({unpivot_sql('sy', NUMS, 'DOUBLE')})),
nd AS (SELECT col, v, sum(r) AS r, sum(s) AS s FROM nv GROUP BY 1, 2),
cdf AS (SELECT col, v, r, lead(v) OVER w AS nx,
  abs(sum(r) OVER w / (SELECT count(*) FROM rl) - sum(s) OVER w / (SELECT count(*) FROM sy)) AS gap
  FROM nd WINDOW w AS (PARTITION BY col ORDER BY v)),
gaps AS (SELECT col, sum(coalesce(nx - v, 0) * gap) / (max(v) FILTER (r > 0) - min(v) FILTER (r > 0)) AS wd,
  1 - max(gap) AS ks FROM cdf GROUP BY 1)"""


@query("fidelity_report", "FID1 FID2 FID3", f"""WITH {SHARES_SQL}{GAPS_SQL}
SELECT 'jsd' AS metric, round(avg(jsd), 6) AS value FROM jsd UNION ALL
SELECT 'wd', round(avg(wd), 6) FROM gaps UNION ALL SELECT 'ks', round(avg(ks), 6) FROM gaps""")
def _(spark, d):
    real, synth = fx.real_and_synthetic(spark, d)
    return rnd(fid.fidelity_report(real, synth, fx.MIXED), "value")


@query("fidelity_category_divergence", "FID1", f"WITH {SHARES_SQL} SELECT col AS \"column\", round(jsd, 6) AS jsd FROM jsd")
def _(spark, d):
    return rnd(fid.category_divergence(*fx.real_and_synthetic(spark, d), fx.MIXED), "jsd")


@query("fidelity_numeric_gaps", "FID2 FID3",
       f"WITH {SHARES_SQL}{GAPS_SQL} SELECT col AS \"column\", round(wd, 6) AS wd, round(ks, 6) AS ks FROM gaps")
def _(spark, d):
    return rnd(fid.numeric_gaps(*fx.real_and_synthetic(spark, d), fx.MIXED), "wd", "ks")


@query("fidelity_coded_ks", "FID3", f"""WITH {SHARES_SQL}
SELECT col AS "column", round(1 - max(abs(fp - fq)), 6) AS ks FROM (
  SELECT col, sum(p) OVER (PARTITION BY col ORDER BY v) AS fp, sum(q) OVER (PARTITION BY col ORDER BY v) AS fq FROM sh) GROUP BY 1""")
def _(spark, d):
    return rnd(fid.coded_ks(*fx.real_and_synthetic(spark, d), fx.MIXED), "ks")


CHI_SQL = """chi AS (SELECT col, sum((greatest(q, CASE WHEN q > 0 THEN 0 ELSE 0.000001 END)
  - CASE WHEN p > 0 THEN p ELSE 0.000001 END) ** 2 / CASE WHEN p > 0 THEN p ELSE 0.000001 END) AS statistic,
  count(*) - 1 AS dof FROM sh GROUP BY 1)"""


@query("fidelity_chi_square", "FID4", f"""WITH {SHARES_SQL}, {CHI_SQL}
SELECT col AS "column", round(statistic, 6) AS statistic, dof FROM chi""")
def _(spark, d):
    return rnd(fid.chi_square(*fx.real_and_synthetic(spark, d), fx.MIXED), "statistic")


# Upper tail of the chi-square law by the power series of the lower incomplete gamma function.
CHI_P = "1 - list_sum([pow(statistic / 2, dof / 2 + i) * exp(-statistic / 2) / gamma(dof / 2 + i + 1) for i in range(0, 60)])"


@query("fidelity_chi_square_p", "FID4", f"""WITH {SHARES_SQL}, {CHI_SQL}
SELECT col AS "column", round(statistic, 6) AS statistic, dof, round({CHI_P}, 6) AS p_value FROM chi""")
def _(spark, d):
    return rnd(fid.chi_square_p(*fx.real_and_synthetic(spark, d), fx.MIXED), "statistic", "p_value")


def assoc_sql(src, name):
    """Association matrix of one table, every pair by its own aggregate."""
    arms = [f"SELECT 'price' AS a, 'balance' AS b, corr(price, balance) AS value FROM {src}"]
    for c in CATS:
        for n in NUMS:
            arms.append(f"""SELECT '{c}', '{n}', sqrt(sum(k * (m - (SELECT avg({n}) FROM {src})) ** 2)
              / (SELECT var_pop({n}) * count(*) FROM {src})) FROM (SELECT count(*) AS k, avg({n}) AS m FROM {src} GROUP BY {c})""")
    for i, a in enumerate(CATS):
        for b in CATS[i + 1:]:
            arms.append(f"""SELECT '{a}', '{b}', sqrt(greatest(0, phi - (k - 1) * (r - 1) / (n - 1))
              / (least(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1)) FROM (
              SELECT sum(x * x / (na * nb)) - 1 AS phi, max(n) AS n, count(DISTINCT {a}) AS k, count(DISTINCT {b}) AS r FROM (
                SELECT {a}, {b}, count(*)::DOUBLE AS x, sum(count(*)) OVER (PARTITION BY {a}) AS na,
                       sum(count(*)) OVER (PARTITION BY {b}) AS nb, sum(count(*)) OVER () AS n FROM {src} GROUP BY {a}, {b}))""")
    return f"{name} AS ({' UNION ALL '.join(arms)})"


@query("fidelity_associations", "FID5", f"""WITH {fx.HALVES_SQL}, {assoc_sql('rl', 'ar')}
SELECT a, b, round(value, 6) AS value FROM ar""")
def _(spark, d):
    return rnd(associations(fx.real_and_synthetic(spark, d)[0], fx.MIXED), "value")


@query("fidelity_association_difference", "FID6", f"""WITH {fx.HALVES_SQL}, {assoc_sql('rl', 'ar')}, {assoc_sql('sy', 'ay')}
SELECT round(sqrt(2 * sum((ar.value - ay.value) ** 2)), 6) AS diff_corr FROM ar JOIN ay USING (a, b)""")
def _(spark, d):
    return rnd(fid.association_difference(*fx.real_and_synthetic(spark, d), fx.MIXED), "diff_corr")


def dimension_sql(number, share):
    one = lambda kind, src: f"SELECT '{kind}' AS kind, round(sqrt(avg((p - q) ** 2)), 4) AS rmse, round(corr(p, q), 4) AS pearson FROM {src}"
    return f"""WITH {SHARES_SQL},
nd AS (SELECT (SELECT {number}(price) FROM rl)::DOUBLE AS p, (SELECT {number}(price) FROM sy)::DOUBLE AS q UNION ALL
       SELECT (SELECT {number}(balance) FROM rl), (SELECT {number}(balance) FROM sy)),
cd AS (SELECT {share.format('p')} AS p, {share.format('q')} AS q FROM sh)
{one('categorical', 'cd')} UNION ALL {one('numeric', 'nd')} UNION ALL {one('overall', '(SELECT * FROM cd UNION ALL SELECT * FROM nd)')}"""


@query("fidelity_dimension_wise", "FID7", dimension_sql("avg", "{}"))
def _(spark, d):
    return rnd(fid.dimension_wise(*fx.real_and_synthetic(spark, d), fx.MIXED), "rmse", "pearson", places=4)


@query("fidelity_dimension_wise_std", "FID7", dimension_sql("stddev_pop", "sqrt({0} * (1 - {0}))"))
def _(spark, d):
    return rnd(fid.dimension_wise(*fx.real_and_synthetic(spark, d), fx.MIXED, "std"), "rmse", "pearson", places=4)


@query("fidelity_preset", "FID12", f"""WITH {SHARES_SQL}{GAPS_SQL}, {CHI_SQL}
SELECT 'jsd' AS metric, round(avg(jsd), 6) AS value FROM jsd UNION ALL
SELECT 'ks', round(avg(ks), 6) FROM gaps UNION ALL SELECT 'cs', round(avg({CHI_P}), 6) FROM chi""")
def _(spark, d):
    return rnd(fid.run_preset(*fx.real_and_synthetic(spark, d), fx.MIXED, "multi-table"), "value")
