"""Generator queries."""

from pyspark.sql import functions as F

from tabloom.functions.tables import materialise
from tabloom.operators import generate as ge
from tabloom.operators.multiplicative import fit_multiplicative_weights
from tabloom.operators.private import level_frequencies
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd
from tabloom.plans.registry import query

U = fx.u_sql
CATS, NUMS = fx.CATS, fx.NUMS
#: Known limits of the numeric columns, for generators that must not read them from the data.
BOUNDS = {"price": (0.0, 6e5), "balance": (-1e3, 1e4)}


def size_of(df):
    """As many synthetic rows as there are real ones, so that the work follows the table."""
    return df.count()


def summary(df, cats, nums):
    """Level counts and column means of a synthetic table, which is drawn once for both."""
    df = materialise(df.select(*cats, *nums))
    c = df.select(*cats).unpivot([], list(cats), "column", "level").groupBy("column", "level").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("mean"))
    m = df.agg(*[F.round(F.avg(x), 3).alias(x) for x in nums]).unpivot([], list(nums), "column", "mean") if nums else None
    return c.unionByName(m.select("column", F.lit(None).cast("string").alias("level"), F.lit(None).cast("long").alias("n"), "mean")) if nums else c


def law_sql(col, src="mixed", by=None):
    part = f"PARTITION BY {by} " if by else ""
    keep = f"{by}, " if by else ""
    return (f"SELECT {keep}{col}, sum(n) OVER ({part}ORDER BY {col}) / sum(n) OVER ({part}) AS hi, coalesce(lag(c) OVER ({part}ORDER BY {col}), 0) AS lo "
            f"FROM (SELECT *, sum(n) OVER ({part}ORDER BY {col}) / sum(n) OVER ({part}) AS c FROM (SELECT {keep}{col}, count(*) AS n FROM {src} GROUP BY ALL))")


@query("generate_independent_levels", "GEN5", f"""WITH {fx.MIXED_SQL}, r AS (SELECT i AS "row", {U(0, 'level-segment', 'i')} AS u1, {U(0, 'level-nation', 'i')} AS u2 FROM range(0, (SELECT count(*) FROM mixed)) t(i))
SELECT "row", segment, nation FROM r JOIN ({law_sql('segment')}) s ON u1 >= s.lo AND u1 < s.hi JOIN ({law_sql('nation')}) n ON u2 >= n.lo AND u2 < n.hi""")
def _(spark, d):
    m = fx.mixed(spark, d)
    model = ge.Independent(fx.MIXED, ge.level_laws(m, ["segment", "nation"]), {})
    return model.sample(size_of(m))


@query("generate_independent", "GEN5")
def _(spark, d):
    m = fx.mixed(spark, d)
    return summary(ge.fit_independent(m, fx.MIXED, 3).sample(size_of(m)), [*CATS, "status"], NUMS)


@query("generate_uniform", "GEN6", f"""WITH lv AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS c, count(*) OVER () AS k FROM (SELECT DISTINCT p_brand FROM part)),
m AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS x, max(p_retailprice) AS y, count(*) AS n FROM part), r AS (SELECT i AS "row" FROM range(0, (SELECT n FROM m)) t(i))
SELECT "row", p_brand, (a + floor({U(0, 'p_size', '"row"')} * (b - a + 1)))::BIGINT AS p_size, round(x + {U(0, 'p_retailprice', '"row"')} * (y - x), 4) AS p_retailprice
FROM r, m, lv WHERE c = least(floor({U(0, 'p_brand', '"row"')} * k), k - 1)""")
def _(spark, d):
    p = fx.table(spark, d, "part")
    s = fx.MIXED.with_roles(key="p_partkey", categorical=("p_brand",), numeric=("p_size", "p_retailprice"), target=None)
    return rnd(ge.fit_uniform(p, s).sample(spark, size_of(p)), "p_retailprice", places=4)


@query("generate_identity", "GEN7", f"WITH {fx.MIXED_SQL} SELECT * FROM mixed")
def _(spark, d):
    return ge.identity(fx.mixed(spark, d))


@query("generate_copula", "GEN4")
def _(spark, d):
    m = materialise(fx.mixed(spark, d))
    return summary(ge.fit_copula(m, fx.MIXED).sample(spark, size_of(m)), [*CATS, "status"], NUMS)


@query("generate_tree_network", "GEN8")
def _(spark, d):
    m = fx.mixed(spark, d)
    return summary(ge.fit_tree_network(m, fx.MIXED).sample(size_of(m)), [*CATS, "status"], NUMS)


@query("generate_private_network", "GEN9")
def _(spark, d):
    m = fx.mixed(spark, d)
    return summary(ge.fit_private_network(m, fx.MIXED, 10.0, bounds=BOUNDS, seed=1).sample(size_of(m)), [*CATS, "status"], NUMS)


@query("generate_multiplicative_weights", "GEN10")
def _(spark, d):
    m = fx.mixed(spark, d)
    g = fit_multiplicative_weights(m, fx.MIXED, BOUNDS, 3.0, groups=[["priority", "segment", "nation"], ["status", "price", "balance"]], seed=1)
    return summary(g.sample(size_of(m)), [*CATS, "status"], NUMS)


@query("generate_private_tree", "GEN11")
def _(spark, d):
    m = fx.mixed(spark, d)
    return summary(ge.fit_private_tree(m, fx.MIXED, 2.0, bounds=BOUNDS, seed=1).sample(size_of(m)), [*CATS, "status"], NUMS)


@query("generate_condition_rows", "GEN12", f"""WITH {fx.MIXED_SQL}, lg AS (SELECT col, v, ln(count(*) + 1) AS w FROM (SELECT 'priority' AS col, priority AS v FROM mixed UNION ALL SELECT 'segment', segment FROM mixed UNION ALL SELECT 'nation', nation FROM mixed) GROUP BY 1, 2),
c AS (SELECT col, v, sum(w) OVER (PARTITION BY col ORDER BY v) / sum(w) OVER (PARTITION BY col) AS hi FROM lg), law AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY col ORDER BY v), 0) AS lo FROM c),
r AS (SELECT i AS "row", list_extract(['priority', 'segment', 'nation'], (least(floor({U(0, 'col', 'i')} * 3) + 1, 3))::BIGINT) AS col, {U(0, 'level', 'i')} AS u FROM range(0, (SELECT count(*) FROM mixed)) t(i)),
a AS (SELECT "row", r.col, v FROM r JOIN law ON law.col = r.col AND u >= lo AND u < hi),
k AS (SELECT col, v, id, row_number() OVER (PARTITION BY col, v ORDER BY id) AS rk, count(*) OVER (PARTITION BY col, v) AS sz FROM (SELECT id, 'priority' AS col, priority AS v FROM mixed UNION ALL SELECT id, 'segment', segment FROM mixed UNION ALL SELECT id, 'nation', nation FROM mixed))
SELECT "row", a.col AS "column", a.v AS value, id FROM a JOIN k ON k.col = a.col AND k.v = a.v AND rk = least(floor({U(0, 'real', '"row"')} * sz) + 1, sz)""")
def _(spark, d):
    m = fx.mixed(spark, d)
    return ge.condition_rows(m, fx.MIXED, size_of(m))


@query("generate_condition_rows_private", "GEN12 DP12")
def _(spark, d):
    m = materialise(fx.mixed(spark, d))
    f = level_frequencies(m, CATS, 1.0, seed=1)
    return ge.condition_rows(m, fx.MIXED, size_of(m), frequencies=f).groupBy("column", "value").agg(F.count("*").alias("n"))


@query("generate_clean_sample", "GEN13", f"""SELECT l_orderkey, l_linenumber, greatest(0, least(1, l_quantity / 40 - 0.1::DOUBLE)) AS x,
CASE WHEN l_discount * 10 >= l_tax * 10 AND l_discount * 10 >= 0.4::DOUBLE THEN 0 WHEN l_tax * 10 >= 0.4::DOUBLE THEN 1 ELSE 2 END AS code FROM lineitem""")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 40 - 0.1).alias("x"),
                                               (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), F.lit(0.4).alias("c"))
    return ge.clean_sample(li, ["x"], {"code": ["a", "b", "c"]})


@query("generate_per_class", "GEN14", f"""WITH {fx.MIXED_SQL}, q AS (SELECT status, count(*) AS n, round_even((SELECT count(*) FROM mixed)::DOUBLE * count(*) / (SELECT count(*) FROM mixed), 0)::BIGINT AS quota FROM mixed GROUP BY 1),
st AS (SELECT *, coalesce(sum(quota) OVER (ORDER BY status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM q),
r AS (SELECT i AS "row", status, n, {U(0, 'level-segment', 'i')} AS u FROM st JOIN range(0, (SELECT sum(quota) FROM q)::BIGINT) t(i) ON i >= s AND i < s + quota),
k AS (SELECT status, price, row_number() OVER (PARTITION BY status ORDER BY id) AS rk FROM mixed)
SELECT "row", r.status, law.segment, k.price FROM r JOIN ({law_sql('segment', by='status')}) law ON law.status = r.status AND u >= lo AND u < hi
JOIN k ON k.status = r.status AND rk = least(floor({U(0, 'value-price', '"row"')} * n) + 1, n)""")
def _(spark, d):
    m = fx.mixed(spark, d)
    s = fx.MIXED.with_roles(categorical=("segment",), numeric=("price",))
    return ge.per_class(m, s, size_of(m))


@query("generate_typed_adapter", "GEN15", f"""WITH {fx.MIXED_SQL} SELECT id, segment, round(price * 1.05::DOUBLE + dense_rank() OVER (ORDER BY segment) - 1, 4) AS price FROM mixed""")
def _(spark, d):
    m = fx.mixed(spark, d)
    s = fx.MIXED.with_roles(categorical=("segment",), numeric=("price",))
    return ge.typed_adapter(m, s, lambda t: t.withColumn("price", F.round(F.col("price") * 1.05 + F.col("segment"), 4)))
