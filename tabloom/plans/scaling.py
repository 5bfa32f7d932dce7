"""Scaling and discretisation queries."""

from pyspark.sql import functions as F

from tabloom.operators import scale as sc
from tabloom.operators import encode as enc
from tabloom.operators.profile import cardinalities
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd
from tabloom.plans.registry import query

NUMS = fx.NUMS


@query("scale_robust", "SCL1", f"""WITH {fx.MIXED_SQL}, q AS (SELECT quantile_cont(price, 0.5) AS pm, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS pw,
quantile_cont(balance, 0.5) AS bm, quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25) AS bw FROM mixed)
SELECT id, priority, segment, nation, round((price - pm) / pw, 6) AS price, round((balance - bm) / bw, 6) AS balance, status FROM mixed, q""")
def _(spark, d):
    m = fx.mixed(spark, d)
    return rnd(sc.fit_robust(m, NUMS).transform(m), *NUMS)


@query("scale_min_max", "SCL2", f"""WITH {fx.MIXED_SQL}, q AS (SELECT min(price) AS a, max(price) AS b, min(balance) AS c, max(balance) AS e FROM mixed)
SELECT id, round((price - a) / (b - a) * 2 - 1, 6) AS price, round((balance - c) / (e - c) * 2 - 1, 6) AS balance, round(price, 2) AS back FROM mixed, q""")
def _(spark, d):
    m = fx.mixed(spark, d)
    f = sc.fit_min_max(m, NUMS, -1.0, 1.0)
    t = f.transform(m)
    back = f.inverse(t).select("id", F.round("price", 2).alias("back"))
    return rnd(t.select("id", *NUMS), *NUMS).join(back, "id")


@query("scale_standard", "SCL3", f"""WITH {fx.MIXED_SQL}, q AS (SELECT avg(price) AS a, stddev_pop(price) AS b, avg(balance) AS c, stddev_pop(balance) AS e FROM mixed)
SELECT id, round((price - a) / b, 6) AS price, round((balance - c) / e, 6) AS balance FROM mixed, q""")
def _(spark, d):
    m = fx.mixed(spark, d)
    return rnd(sc.fit_standard(m, NUMS).transform(m).select("id", *NUMS), *NUMS)


@query("scale_bins", "SCL4", f"""WITH {fx.MIXED_SQL}, q AS (SELECT min(price) AS a, (max(price) - min(price)) / 15 AS w FROM mixed)
SELECT id, least(floor((price - a) / w), 14)::INTEGER AS code, round((least(floor((price - a) / w), 14) + 0.5::DOUBLE) * w + a, 3) AS centre FROM mixed, q""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "price")
    b = sc.fit_bins(m, ["price"], 15)
    t = b.transform(m)
    return t.withColumnRenamed("price", "code").join(b.inverse(t).select("id", F.round("price", 3).alias("centre")), "id")


@query("scale_tree_bins", "SCL5", f"""WITH {fx.MIXED_SQL}, r AS (SELECT min(price) AS a, max(price) AS b FROM mixed),
q AS (SELECT a - (b - a) * 0.03::DOUBLE AS lo, (b - a) * 1.06::DOUBLE / 16 AS w FROM r), t AS (SELECT id, floor((price - lo) / (w + 0.00000001::DOUBLE))::INTEGER AS code, lo, w FROM mixed, q)
SELECT id, code, code // 4 AS parent, (code // 4) * 4 AS child_from, (code // 4 + 1) * 4 AS child_to, round((code + 0.5::DOUBLE) * w + lo, 3) AS centre FROM t""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "price")
    b = sc.fit_tree_bins(m, ["price"])
    t = b.transform(m)
    parent = sc.tree_parent(F.col("price"), 2)
    lo, hi = sc.tree_children(parent, 2)
    codes = t.select("id", F.col("price").alias("code"), parent.alias("parent"), lo.alias("child_from"), hi.alias("child_to"))
    return codes.join(b.inverse(t).select("id", F.round("price", 3).alias("centre")), "id")


@query("scale_category_taxonomy", "SCL6", f"""WITH {fx.MIXED_SQL}, c AS (SELECT id, dense_rank() OVER (ORDER BY nation) - 1 AS code FROM mixed),
z AS (SELECT greatest(1, ceil(count(DISTINCT code) / 4))::BIGINT AS depth FROM c)
SELECT id, code, least(code, 4 * (depth - 1)) AS level1, least(code, 4 * (depth - 3)) AS level3 FROM c, z""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "nation")
    size = cardinalities(m, ["nation"]).first()["size"]
    t = enc.fit_labels(m, ["nation"]).transform(m).withColumnRenamed("nation", "code")
    return t.select("id", "code", sc.nested_group(F.col("code"), size, 1).alias("level1"), sc.nested_group(F.col("code"), size, 3).alias("level3"))


def _class_mixture(m):
    """A mixture with one component per order status: its share, mean and deviation."""
    rows = m.groupBy("status").agg(F.count("*").alias("n"), F.avg("price").alias("m"), F.stddev_pop("price").alias("s")).orderBy("status").collect()
    total = sum(r["n"] for r in rows)
    return sc.Mixture([r["n"] / total for r in rows], [r["m"] for r in rows], [r["s"] for r in rows])


COMP_SQL = """k AS (SELECT row_number() OVER (ORDER BY status) AS k, count(*) / (SELECT count(*) FROM mixed) AS w, avg(price) AS m, stddev_pop(price) AS s FROM mixed GROUP BY status),
po AS (SELECT id, price, k, m, s, w / s * exp(-((price - m) ** 2) / (2 * s * s)) / sum(w / s * exp(-((price - m) ** 2) / (2 * s * s))) OVER (PARTITION BY id) AS p FROM mixed, k)"""


@query("scale_mode_normalise", "SCL7", f"""WITH {fx.MIXED_SQL}, {COMP_SQL},
cu AS (SELECT *, sum(p) OVER (PARTITION BY id ORDER BY k) AS c, {fx.u_sql(4, 'mode-price', 'id')} AS u FROM po)
SELECT id, k::INTEGER AS price_mode, round(greatest(-0.99, least(0.99, (price - m) / (4 * s))), 6) AS price_norm FROM cu
WHERE u <= c OR k = 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1""")
def _(spark, d):
    m = fx.mixed(spark, d)
    t = sc.mode_normalise(m, "price", _class_mixture(m), "id", width=4.0, seed=4)
    return rnd(t.select("id", "price_mode", "price_norm"), "price_norm")


@query("scale_mode_normalise_fitted", "SCL7")
def _(spark, d):
    m = fx.mixed(spark, d)
    mix = sc.fit_mixture(m, "balance", 5)
    t = sc.mode_normalise(m, "balance", mix, "id")
    back = sc.mode_denormalise(t, "balance", mix).select("id", F.col("balance").alias("back"))
    return rnd(t.select("id", "balance", "balance_mode", "balance_norm").join(back, "id"), "balance_norm", "back", places=3)


@query("scale_mixed_normalise", "SCL8", """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q FROM lineitem),
c AS (SELECT avg(q) AS m, stddev_pop(q) AS s FROM b),
t AS (SELECT id, q, CASE WHEN q = 1 THEN 2 WHEN q = 50 THEN 3 ELSE 1 END AS slot FROM b),
r AS (SELECT slot, row_number() OVER (ORDER BY count(*) DESC, slot) - 1 AS k FROM t GROUP BY 1)
SELECT id, k::INTEGER AS quantity_slot, round(CASE WHEN slot > 1 THEN 0 ELSE greatest(-0.99, least(0.99, (q - m) / (4 * s))) END, 6) AS quantity_norm
FROM t JOIN r USING (slot), c""")
def _(spark, d):
    m = fx.mixed_regression(spark, d).select("id", "quantity")
    st = sc.column_stats(m, ["quantity"])["quantity"]
    t = sc.mixed_normalise(m, "quantity", [1.0, 50.0], sc.Mixture([1.0], [st["mean"]], [st["std"]]), "id")
    return rnd(t.select("id", "quantity_slot", "quantity_norm"), "quantity_norm")


@query("scale_margin", "SCL9", f"""WITH {fx.MIXED_SQL}, q AS (SELECT min(price) - 0.001::DOUBLE AS a, max(price) + 0.001::DOUBLE AS b FROM mixed),
c AS (SELECT *, dense_rank() OVER (ORDER BY segment) - 1 AS code FROM mixed)
SELECT id, round((price - a) / (b - a) * 2 - 1, 6) AS price, round((code + 0.001::DOUBLE) / 4.002::DOUBLE * 2 - 1, 6) AS segment, code::DOUBLE AS back FROM c, q""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "segment", "price")
    spec = fx.MIXED.with_roles(categorical=("segment",), numeric=("price",), target=None)
    coded = enc.fit_labels(m, ["segment"]).transform(m)
    f = sc.fit_margin_scale(coded, spec, {"segment": 5})
    t = f.transform(coded)
    return rnd(t, "price", "segment").join(sc.margin_inverse(t, spec, f).select("id", F.col("segment").alias("back")), "id")


@query("scale_processor", "SCL10", f"""WITH {fx.MIXED_SQL}, q AS (SELECT min(price) AS a, max(price) AS b FROM mixed)
SELECT id, round((price - a) / (b - a), 6) AS price, CAST(segment = 'BUILDING' AS INTEGER) AS "segment_BUILDING", CAST(segment = 'MACHINERY' AS INTEGER) AS "segment_MACHINERY",
segment AS back FROM mixed, q""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "segment", "price")
    p = sc.Processor(fx.MIXED.with_roles(categorical=("segment",), numeric=("price",), target=None)).fit(m)
    t = p.transform(m)
    back = p.inverse(t).select("id", F.col("segment").alias("back"))
    return rnd(t.select("id", "price", "segment_BUILDING", "segment_MACHINERY"), "price").join(back, "id")


@query("scale_sliding_windows", "SCL12", f"""WITH q AS (SELECT min(value) AS a, max(value) AS b FROM events),
e AS (SELECT event_id, (value - a) / (b - a) AS v, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events, q),
w AS (SELECT event_id, v, lead(v, 1) OVER (ORDER BY r) AS v1, lead(v, 2) OVER (ORDER BY r) AS v2, lead(v, 3) OVER (ORDER BY r) AS v3, r, n FROM e)
SELECT row_number() OVER (ORDER BY {fx.u_sql(0, 'window', 'event_id')}, event_id) AS position, event_id,
round(v, 6) AS v0, round(v1, 6) AS v1, round(v2, 6) AS v2, round(v3, 6) AS v3 FROM w WHERE r <= n - 4""")
def _(spark, d):
    t = sc.sliding_windows(fx.table(spark, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], ["value"], 4, key="event_id")
    return t.select("position", "event_id", *[F.round(F.col("value")[i], 6).alias(f"v{i}") for i in range(4)])
