"""Cleaning queries."""

from pyspark.sql import functions as F

from tabloom.operators import clean
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd
from tabloom.plans.registry import query

CATS, NUMS, U = fx.CATS, fx.NUMS, fx.u_sql


@query("clean_split_target", "CLN1", f"""WITH {fx.MIXED_SQL} SELECT id, priority, nation, price, balance, status FROM mixed""")
def _(spark, d):
    x, y, _spec = clean.split_target(fx.mixed(spark, d), fx.MIXED, drop=["segment"])
    return x.join(y, "id")


@query("clean_markers", "CLN2", f"""WITH {fx.NULLS_SQL} SELECT id, nullif(priority, '?') AS priority, segment FROM nul""")
def _(spark, d):
    return clean.markers_to_null(fx.mixed_nulls(spark, d), ["priority"]).select("id", "priority", "segment")


@query("clean_drop_incomplete", "CLN3", f"""WITH {fx.NULLS_SQL} SELECT * FROM nul WHERE priority <> '?' AND segment IS NOT NULL
AND nation IS NOT NULL AND price IS NOT NULL AND balance IS NOT NULL AND status IS NOT NULL""")
def _(spark, d):
    return clean.drop_incomplete(clean.markers_to_null(fx.mixed_nulls(spark, d), ["priority"]), fx.MIXED)


def _mode(c):
    return f"(SELECT {c} FROM nul WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("clean_impute_mode", "CLN4", f"""WITH {fx.NULLS_SQL} SELECT id,
{', '.join(f'coalesce({c}, {_mode(c)}) AS {c}' for c in ('segment', 'nation', 'balance'))} FROM nul""")
def _(spark, d):
    return clean.impute_mode(fx.mixed_nulls(spark, d), ["segment", "nation", "balance"]).select("id", "segment", "nation", "balance")


@query("clean_sentinel", "CLN5", f"""WITH {fx.NULLS_SQL} SELECT id, coalesce(segment, 'empty') AS segment,
coalesce(price, -9999999.0::DOUBLE) AS price, segment AS segment_back, price AS price_back FROM nul""")
def _(spark, d):
    t = clean.null_to_sentinel(fx.mixed_nulls(spark, d), fx.MIXED)
    back = clean.sentinel_to_null(t, fx.MIXED)
    return t.select("id", "segment", "price").join(
        back.select("id", F.col("segment").alias("segment_back"), F.col("price").alias("price_back")), "id")


@query("clean_fill_uniform", "CLN6", f"""WITH {fx.NULLS_SQL}
SELECT id, round(coalesce(price, 100 + {U(1, 'fill-price', 'id')} * 800), 3) AS price FROM nul""")
def _(spark, d):
    t = clean.fill_uniform(fx.mixed_nulls(spark, d), {"price": (100.0, 900.0)}, "id", 1)
    return rnd(t.select("id", "price"), "price", places=3)


@query("clean_clip", "CLN7", f"""WITH {fx.MIXED_SQL}
SELECT id, greatest(50000, least(300000, price)) AS price, greatest(0, least(5000, balance)) AS balance FROM mixed""")
def _(spark, d):
    return clean.clip_columns(fx.mixed(spark, d), {"price": (50000, 300000), "balance": (0, 5000)}).select("id", *NUMS)


@query("clean_clip_norm", "CLN8", f"""WITH {fx.MIXED_SQL}, n AS (SELECT *, greatest(sqrt(price * price + balance * balance) / 100000, 1) AS f FROM mixed)
SELECT id, round(price / f, 3) AS price, round(balance / f, 3) AS balance FROM n""")
def _(spark, d):
    return rnd(clean.clip_to_norm(fx.mixed(spark, d), NUMS, 100000.0).select("id", *NUMS), *NUMS, places=3)


@query("clean_log_transform", "CLN9", f"""WITH {fx.MIXED_SQL}, lo AS (SELECT min(balance) AS b FROM mixed)
SELECT id, round(ln(balance - b + 1), 6) AS balance, round(ln(price), 6) AS price, round(balance, 3) AS back FROM mixed, lo""")
def _(spark, d):
    m = fx.mixed(spark, d)
    t = clean.log_transform(m, NUMS)
    back = clean.log_inverse(t, ["balance"], clean.column_minima(m, ["balance"])).select("id", F.round("balance", 3).alias("back"))
    return rnd(t.select("id", *NUMS), *NUMS).join(back, "id")


@query("clean_restore_integers", "CLN10", f"""WITH {fx.MIXED_SQL} SELECT id, round_even(price, 0)::BIGINT AS price FROM mixed""")
def _(spark, d):
    return clean.restore_integers(fx.mixed(spark, d), ["price"]).select("id", "price")


@query("clean_rare_levels", "CLN11", """WITH k AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 80)
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'OTHER' END AS p_brand FROM part""")
def _(spark, d):
    return clean.group_rare_levels(fx.table(spark, d, "part"), "p_brand", 80).select("p_partkey", "p_brand")


@query("clean_text_numbers", "CLN12", """SELECT l_orderkey, l_linenumber, floor(l_discount * 100 + 0.5)::DOUBLE AS pct,
CAST(l_tax > 0 AS INTEGER) AS taxed, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS answer
FROM lineitem WHERE l_returnflag IN ('A', 'N')""")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax",
        F.concat(F.floor(F.col("l_discount") * 100 + 0.5).cast("string"), F.lit("%")).alias("pct"),
        F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "N", "no").alias("answer"))
    return li.select("l_orderkey", "l_linenumber", clean.percent_to_number(F.col("pct")).alias("pct"),
                     clean.positive_flag(F.col("l_tax")).alias("taxed"), clean.yes_no(F.col("answer")).alias("answer")).dropna(subset=["answer"])


@query("clean_day_difference", "CLN13", """SELECT l_orderkey, l_linenumber,
(l_shipdate::DATE - o_orderdate::DATE)::INTEGER AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, d):
    li, o = fx.table(spark, d, "lineitem"), fx.table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", clean.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"))


@query("clean_drop_all_duplicates", "CLN14", """SELECT l_suppkey, l_quantity, l_discount FROM lineitem
GROUP BY 1, 2, 3 HAVING count(*) = 1""")
def _(spark, d):
    return clean.drop_all_duplicates(fx.table(spark, d, "lineitem"), ["l_suppkey", "l_quantity", "l_discount"])


@query("clean_exclude_values", "CLN15", f"""WITH {fx.RESULTS_SQL} SELECT * FROM res
WHERE generator IS NOT NULL AND random_state NOT IN (3, 5)""")
def _(spark, d):
    return clean.exclude_values(clean.exclude_values(fx.results(spark, d), "generator", [None]), "random_state", [3, 5])


@query("clean_rename_levels", "CLN16", f"""WITH {fx.RESULTS_SQL} SELECT dataset, random_state, teacher,
CASE encoder WHEN 'TargetEncoder' THEN 'Target' WHEN 'NoneType' THEN 'nan' ELSE encoder END AS encoder,
CASE generator WHEN 'PrivBNGenerator' THEN 'PrivBayes' WHEN 'ProportionalSMOTEGenerator' THEN 'SMOTE' ELSE generator END AS generator FROM res""")
def _(spark, d):
    from tabloom.operators.results import rename_labels

    return rename_labels(fx.results(spark, d)).select("dataset", "random_state", "teacher", "encoder", "generator")


@query("clean_flip_sign", "CLN17", f"""WITH {fx.RESULTS_SQL} SELECT dataset, encoder, generator, teacher, random_state, -jsd AS jsd,
CASE WHEN dataset = 'set1' THEN -performance ELSE performance END AS performance FROM res""")
def _(spark, d):
    r = clean.flip_sign(fx.results(spark, d), ["jsd"])
    r = clean.flip_sign(r, ["performance"], when=F.col("dataset") == "set1")
    return r.select("dataset", "encoder", "generator", "teacher", "random_state", "jsd", "performance")


@query("clean_positional_titles", "CLN18", f"""WITH {fx.MIXED_SQL}
SELECT id, priority AS "0", segment AS "1", nation AS "2", price AS "3", balance AS "4", status FROM mixed""")
def _(spark, d):
    return clean.positional_titles(fx.mixed(spark, d), fx.MIXED)[0]
