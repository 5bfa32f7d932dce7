"""Profiling queries."""

from pyspark.sql import functions as F

from tabloom.operators import profile
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd, unpivot_sql
from tabloom.plans.registry import query

CATS, NUMS = fx.CATS, fx.NUMS


@query("profile_table", "PRF1", f"""WITH {fx.MIXED_SQL},
lv AS (SELECT col, v, count(*) AS n FROM ({unpivot_sql('mixed', CATS)}) GROUP BY 1, 2)
SELECT col AS "column", count(*) AS size, string_agg(v, ',' ORDER BY n DESC, v) AS levels, 'categorical' AS kind,
  NULL::DOUBLE AS min, NULL::DOUBLE AS max FROM lv GROUP BY 1 UNION ALL
SELECT col, NULL, NULL, 'continuous', min(v), max(v) FROM ({unpivot_sql('mixed', NUMS, 'DOUBLE')}) GROUP BY 1""")
def _(spark, d):
    return profile.table_profile(fx.mixed(spark, d), fx.MIXED)


@query("profile_cardinality", "PRF2", f"""WITH {fx.MIXED_SQL}
SELECT col AS "column", count(DISTINCT v) AS size FROM ({unpivot_sql('mixed', CATS)}) GROUP BY 1""")
def _(spark, d):
    return profile.cardinalities(fx.mixed(spark, d), CATS)


@query("profile_feature_domains", "PRF3", """WITH u AS (
SELECT 'l_linenumber' AS col, l_linenumber::DOUBLE AS v, l_linenumber::VARCHAR AS s FROM lineitem UNION ALL
SELECT 'l_quantity', l_quantity, NULL FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice, NULL FROM lineitem),
g AS (SELECT col, count(DISTINCT v) AS size, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1)
SELECT col AS "column", size, CASE WHEN size <= 10 THEN 'categorical' ELSE 'continuous' END AS kind,
CASE WHEN size <= 10 THEN (SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM u WHERE u.col = g.col) END AS domain,
CASE WHEN size > 10 THEN lo END AS min, CASE WHEN size > 10 THEN hi END AS max FROM g""")
def _(spark, d):
    return profile.feature_domains(fx.table(spark, d, "lineitem"), ["l_linenumber", "l_quantity", "l_extendedprice"])


@query("profile_contingency", "PRF4", """WITH t AS (SELECT l_returnflag, l_linestatus,
  floor(l_quantity / 2)::BIGINT AS q1, floor(l_quantity / 8)::BIGINT AS q3 FROM lineitem)
SELECT 0 AS cell_set, l_returnflag, l_linestatus, NULL AS q1, NULL AS q3, count(*) AS n FROM t GROUP BY 2, 3 UNION ALL
SELECT 1, NULL, l_linestatus, q1::VARCHAR, NULL, count(*) FROM t GROUP BY 3, 4 UNION ALL
SELECT 2, l_returnflag, l_linestatus, NULL, q3::VARCHAR, count(*) FROM t GROUP BY 2, 3, 5""")
def _(spark, d):
    t = fx.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", profile.generalise(F.col("l_quantity"), 1).alias("q1"),
                                              profile.generalise(F.col("l_quantity"), 3).alias("q3"))
    return profile.contingency(t, [["l_returnflag", "l_linestatus"], ["l_linestatus", "q1"], ["l_returnflag", "l_linestatus", "q3"]])


def _pair_sql(a, b):
    return f"""SELECT '{a}' AS a, '{b}' AS b, sum(p * log2(p / (pa * pb))) AS mi,
  sum(abs(p - pa * pb)) + (1 - sum(pa * pb)) AS filled FROM (SELECT count(*) / (SELECT count(*) FROM mixed) AS p,
  sum(count(*)) OVER (PARTITION BY {a}) / (SELECT count(*) FROM mixed) AS pa,
  sum(count(*)) OVER (PARTITION BY {b}) / (SELECT count(*) FROM mixed) AS pb FROM mixed GROUP BY {a}, {b})"""


def _grid_sql(a, b):
    """Distance over the full grid of cells, empty ones included."""
    return f"""SELECT '{a}' AS a, '{b}' AS b, (SELECT sum(abs(coalesce(c.n, 0) / t.n - (x.n / t.n) * (y.n / t.n)))
  FROM (SELECT {a}, count(*) AS n FROM mixed GROUP BY 1) x CROSS JOIN (SELECT {b}, count(*) AS n FROM mixed GROUP BY 1) y
  CROSS JOIN (SELECT count(*) AS n FROM mixed) t
  LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM mixed GROUP BY 1, 2) c ON c.{a} = x.{a} AND c.{b} = y.{b}) AS distance"""


PAIRS = [("priority", "segment"), ("priority", "nation"), ("priority", "status"), ("segment", "nation"),
         ("segment", "status"), ("nation", "status")]


@query("profile_mutual_information", "PRF5 PRF7", f"""WITH {fx.MIXED_SQL}, p AS ({' UNION ALL '.join(_pair_sql(*p) for p in PAIRS)})
SELECT a, b, round(mi, 6) AS mi FROM p""")
def _(spark, d):
    return rnd(profile.dependence(fx.mixed(spark, d), [*CATS, "status"]).select("a", "b", "mi"), "mi")


@query("profile_independence_distance", "PRF6 PRF7", f"""WITH {fx.MIXED_SQL}, p AS ({' UNION ALL '.join(_grid_sql(*p) for p in PAIRS)})
SELECT a, b, round(distance, 6) AS distance FROM p""")
def _(spark, d):
    return rnd(profile.dependence(fx.mixed(spark, d), [*CATS, "status"]).select("a", "b", "distance"), "distance")


@query("profile_class_shares", "PRF8", f"""WITH {fx.MIXED_SQL}
SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM mixed), 6) AS share FROM mixed GROUP BY 1""")
def _(spark, d):
    return rnd(profile.class_shares(fx.mixed(spark, d), "status"), "share")
