"""Encoder queries."""

from pyspark.sql import functions as F

from tabloom.operators import encode as enc
from tabloom.operators import split
from tabloom.operators.profile import cardinalities
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd
from tabloom.plans.registry import query

CATS, U = fx.CATS, fx.u_sql


def code_sql(c, src="mixed", key="id"):
    """1-based code by first appearance, as a (value, code) query."""
    return f"(SELECT {c} AS v, row_number() OVER (ORDER BY min({key})) AS code FROM {src} WHERE {c} IS NOT NULL GROUP BY 1)"


def per_col(fmt, cols=CATS, places=6):
    """One output column per categorical column from a template with {c}."""
    return ", ".join(f"round({fmt.format(c=c)}, {places}) AS {c}" for c in cols)


@query("encode_ordinal", "ENC1", f"""WITH {fx.NULLS_SQL}
SELECT id, p.code AS priority, CASE WHEN segment IS NULL THEN -2 ELSE s.code END AS segment,
  CASE WHEN nation IS NULL THEN -2 ELSE n.code END AS nation
FROM nul LEFT JOIN {code_sql('priority', 'nul')} p ON priority = p.v LEFT JOIN {code_sql('segment', 'nul')} s ON segment = s.v
LEFT JOIN {code_sql('nation', 'nul')} n ON nation = n.v""")
def _(spark, d):
    m = fx.mixed_nulls(spark, d)
    return enc.fit_ordinal(m, CATS, "id").transform(m).select("id", *CATS)


@query("encode_labels", "ENC2", f"WITH {fx.MIXED_SQL} SELECT id, dense_rank() OVER (ORDER BY status) - 1 AS status FROM mixed")
def _(spark, d):
    m = fx.mixed(spark, d)
    return enc.fit_labels(m, ["status"]).transform(m).select("id", "status")


@query("encode_deep_ordinal", "ENC3", f"""WITH {fx.MIXED_SQL}
SELECT id, p.code AS "0", s.code AS "1", n.code AS "2", price AS "3", balance AS "4", dense_rank() OVER (ORDER BY status) - 1 AS status,
  nation AS back FROM mixed JOIN {code_sql('priority')} p ON priority = p.v
JOIN {code_sql('segment')} s ON segment = s.v JOIN {code_sql('nation')} n ON nation = n.v""")
def _(spark, d):
    m = fx.mixed(spark, d)
    f = enc.fit_deep_ordinal(m, fx.MIXED)
    t = f.transform(m)
    return t.join(f.inverse(t).select("id", F.col("nation").alias("back")), "id")


@query("encode_one_hot", "ENC4", f"""WITH {fx.MIXED_SQL} SELECT id, CAST(status = 'F' AS INTEGER) AS "status_F",
CAST(status = 'O' AS INTEGER) AS "status_O", CAST(status = 'P' AS INTEGER) AS "status_P", status AS back FROM mixed""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "status")
    levels = {"status": enc.levels_of(m, "status")}
    hot = enc.one_hot(m, ["status"], levels)
    back = enc.one_hot_inverse(hot, levels).select("id", F.col("status").alias("back"))
    return hot.join(back, "id")


@query("encode_binary_digits", "ENC5", f"""WITH {fx.MIXED_SQL}
SELECT id, {', '.join(f'(code // {2 ** (4 - i)}) % 2 AS nation_{i}' for i in range(5))} FROM mixed JOIN {code_sql('nation')} n ON nation = n.v""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "nation")
    sizes = {r["column"]: r["size"] for r in cardinalities(m, ["nation"]).collect()}
    return enc.digits(m, ["nation"], enc.fit_ordinal(m, ["nation"], "id"), sizes)


@query("encode_base_n_digits", "ENC5", f"""WITH {fx.MIXED_SQL}
SELECT id, {', '.join(f'(code // {4 ** (2 - i)}) % 4 AS nation_{i}' for i in range(3))} FROM mixed JOIN {code_sql('nation')} n ON nation = n.v""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "nation")
    sizes = {r["column"]: r["size"] for r in cardinalities(m, ["nation"]).collect()}
    return enc.digits(m, ["nation"], enc.fit_ordinal(m, ["nation"], "id"), sizes, base=4)


@query("encode_count", "ENC6", f"""WITH {fx.BINARY_SQL}
SELECT id, {per_col('count(*) OVER (PARTITION BY {c})::DOUBLE')} FROM bin""")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    return rnd(enc.fit_formula(m, fx.BINARY, enc.count(), default=0.0).transform(m).select("id", *CATS), *CATS)


PRIOR = "(SELECT avg({y}) FROM {t})"
SIG = "(1 / (1 + exp(-(count(*) OVER (PARTITION BY {{c}}) - {k}) / {f}::DOUBLE)))"


def target_sql(y, t, k=20, f=10.0):
    w = SIG.format(k=k, f=f)
    prior = PRIOR.format(y=y, t=t)
    return (f"CASE WHEN count(*) OVER (PARTITION BY {{c}}) = 1 THEN {prior} ELSE {prior} * (1 - {w}) "
            f"+ avg({y}) OVER (PARTITION BY {{c}}) * {w} END")


@query("encode_target", "ENC7", f"WITH {fx.BINARY_SQL} SELECT id, {per_col(target_sql('y', 'bin'))} FROM bin")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    return rnd(enc.fit_formula(m, fx.BINARY, enc.target_mean(20, 10.0)).transform(m).select("id", *CATS), *CATS)


@query("encode_ordered_target", "ENC8", f"""WITH {fx.BINARY_SQL} SELECT id, {per_col(
    '(coalesce(sum(y) OVER (PARTITION BY {c} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (SELECT avg(y) FROM bin)) '
    '/ (row_number() OVER (PARTITION BY {c} ORDER BY id) - 1 + 1)')} FROM bin""")
def _(spark, d):
    return rnd(enc.ordered_target(fx.mixed_binary(spark, d), fx.BINARY).select("id", *CATS), *CATS)


@query("encode_ordered_target_full", "ENC8", f"""WITH {fx.BINARY_SQL} SELECT id, {per_col(
    '(sum(y) OVER (PARTITION BY {c}) + (SELECT avg(y) FROM bin)) / (count(*) OVER (PARTITION BY {c}) + 1)')} FROM bin""")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    return rnd(enc.fit_formula(m, fx.BINARY, enc.ordered_full()).transform(m).select("id", *CATS), *CATS)


def intercept_sql(c):
    return f"""(SELECT c, w.b / (w.b + w.within / n) * (s / n - w.m) AS e FROM (SELECT {c} AS c, count(*) AS n, sum(price) AS s FROM reg GROUP BY 1),
  (SELECT within, m, greatest(0, ((sb - sum_y * sum_y / big) / (k - 1) - within) / ((big - n2 / big) / (k - 1))) AS b FROM (
    SELECT (sum(q) - sum(s * s / n)) / (sum(n) - count(*)) AS within, sum(s) / sum(n) AS m, sum(s * s / n) AS sb, sum(s) AS sum_y,
           sum(n)::DOUBLE AS big, sum(n * n) AS n2, count(*) AS k
    FROM (SELECT count(*) AS n, sum(price) AS s, sum(price * price) AS q FROM reg GROUP BY {c}))) w)"""


@query("encode_intercepts_regression", "ENC9", f"""WITH {fx.REGRESSION_SQL}
SELECT id, round(coalesce(a.e, 0), 3) AS flag, round(coalesce(b.e, 0), 3) AS line FROM reg
LEFT JOIN {intercept_sql('flag')} a ON flag = a.c LEFT JOIN {intercept_sql('line')} b ON line = b.c""")
def _(spark, d):
    m = fx.mixed_regression(spark, d)
    return rnd(enc.fit_intercepts(m, fx.REGRESSION).transform(m).select("id", "flag", "line"), "flag", "line", places=3)


def newton_sql(c, src, y, base):
    """Eight Newton steps on the level counts, written out as nested queries."""
    q = f"SELECT {c} AS c, count(*)::DOUBLE AS n, sum({y})::DOUBLE AS s, {base} AS g, 0.0::DOUBLE AS b FROM {src} GROUP BY 1"
    for _ in range(8):
        q = f"""SELECT c, n, s, g, b + (s - n * p - b) / (n * p * (1 - p) + 1) AS b FROM (
          SELECT *, 1 / (1 + exp(-(g + b))) AS p FROM ({q}))"""
    return f"(SELECT c, b AS e FROM ({q}))"


LOGIT = "(SELECT ln(sum(y) / (count(*) - sum(y))) FROM bin)"


@query("encode_intercepts_binary", "ENC9", f"""WITH {fx.BINARY_SQL}
SELECT id, {', '.join(f'round(t{i}.e, 6) AS {c}' for i, c in enumerate(CATS))} FROM bin
{' '.join(f'JOIN {newton_sql(c, "bin", "y", LOGIT)} t{i} ON {c} = t{i}.c' for i, c in enumerate(CATS))}""")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    return rnd(enc.fit_intercepts(m, fx.BINARY).transform(m).select("id", *CATS), *CATS)


@query("encode_intercepts_noisy", "ENC9")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    return enc.jitter(enc.fit_intercepts(m, fx.BINARY).transform(m).select("id", *CATS), CATS, "id", 0.05, 1)


KFOLD_SQL = f"f AS (SELECT *, ntile(5) OVER (ORDER BY {U(2, 'fold', 'id')}, id) - 1 AS fold FROM bin)"
STRAT_SQL = f"""cl AS (SELECT y AS cy, count(*) AS n, row_number() OVER (ORDER BY min(id)) AS o FROM bin GROUP BY 1),
pos AS (SELECT b.*, row_number() OVER (PARTITION BY y ORDER BY {U(2, 'fold', 'id')}, id) AS r FROM bin b),
start AS (SELECT cy, n, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM cl),
own AS (SELECT cy, i, sum(len(list_filter(range(st::BIGINT, (st + n)::BIGINT), lambda p: p % 5 = i))) OVER (PARTITION BY cy ORDER BY i) AS upto
  FROM start, range(5) t(i)),
f AS (SELECT pos.*, (SELECT count(*) FROM own WHERE cy = y AND upto < r) AS fold FROM pos)"""


def oof_sql(y, places=6, cols=CATS, src="f", k=20, f=10.0):
    """Out-of-fold smoothed mean by explicit exclusion of the own fold."""
    outs = []
    for c in cols:
        n = f"(count(*) OVER (PARTITION BY {c}) - count(*) OVER (PARTITION BY {c}, fold))"
        s = f"(sum({y}) OVER (PARTITION BY {c}) - sum({y}) OVER (PARTITION BY {c}, fold))"
        p = f"((sum({y}) OVER () - sum({y}) OVER (PARTITION BY fold)) / (count(*) OVER () - count(*) OVER (PARTITION BY fold)))"
        w = f"(1 / (1 + exp(-({n} - {k}) / {f}::DOUBLE)))"
        outs.append((c, f"CASE WHEN {n} = 1 THEN {p} WHEN {n} = 0 THEN (SELECT avg({y}) FROM {src}) ELSE {p} * (1 - {w}) + {s} / {n} * {w} END"))
    return ", ".join(f"round({e}, {places}) AS {c}" for c, e in outs)


@query("encode_cross_fitted_target", "ENC10 ENC12", f"WITH {fx.BINARY_SQL}, {KFOLD_SQL} SELECT id, {oof_sql('y')} FROM f")
def _(spark, d):
    m = split.k_folds(fx.mixed_binary(spark, d), "id", 5, shuffle=True, seed=2)
    return rnd(enc.cross_fitted(m, fx.BINARY, "fold", 5, k=20, f=10.0).select("id", *CATS), *CATS)


@query("encode_stratified_cross_fitted_target", "ENC11 ENC12", f"WITH {fx.BINARY_SQL}, {STRAT_SQL} SELECT id, {oof_sql('y')} FROM f")
def _(spark, d):
    m = split.stratified_k_folds(fx.mixed_binary(spark, d), "id", "y", 5, shuffle=True, seed=2)
    return rnd(enc.cross_fitted(m, fx.BINARY, "fold", 5, k=20, f=10.0).select("id", *CATS), *CATS)


@query("encode_cross_fitted_intercepts", "ENC12 ENC9")
def _(spark, d):
    m = split.k_folds(fx.mixed_binary(spark, d), "id", 5, shuffle=True, seed=2)
    return rnd(enc.cross_fitted(m, fx.BINARY, "fold", 5, kind="intercepts").select("id", *CATS), *CATS)


@query("encode_stratified_cross_fitted_intercepts", "ENC12 ENC9")
def _(spark, d):
    m = split.stratified_k_folds(fx.mixed_binary(spark, d), "id", "y", 5, shuffle=True, seed=2)
    return rnd(enc.cross_fitted(m, fx.BINARY, "fold", 5, kind="intercepts").select("id", *CATS), *CATS)


CLASS_SQL = "cls AS (SELECT row_number() OVER (ORDER BY min(id)) AS o, status AS s FROM mixed GROUP BY 2)"


def multi_sql(fmt, src="mixed"):
    """Two encoded columns per feature; the class names depend on the data, so columns are
    reported long: (id, column, value)."""
    arms = []
    for c in CATS:
        y = "CAST(status = s AS INTEGER)"
        arms.append(f"""SELECT id, '{c}_' || s AS col, {fmt(c, y)} AS value FROM {src}, cls WHERE o > 1""")
    return " UNION ALL ".join(arms)


def long_form(df, key="id"):
    cols = [c for c in df.columns if c != key]
    return rnd(df.unpivot([key], cols, "col", "value"), "value")


def _multi_target(c, y):
    w = f"(1 / (1 + exp(-(count(*) OVER (PARTITION BY s, {c}) - 20) / 10.0::DOUBLE)))"
    p = f"(sum({y}) OVER (PARTITION BY s) / count(*) OVER (PARTITION BY s))"
    return f"round({p} * (1 - {w}) + avg({y}) OVER (PARTITION BY s, {c}) * {w}, 6)"


@query("encode_multiclass_target", "ENC13 ENC14", f"WITH {fx.MIXED_SQL}, {CLASS_SQL} {multi_sql(_multi_target)}")
def _(spark, d):
    m = fx.mixed(spark, d)
    t = enc.fit_formula(m, fx.MIXED, enc.target_mean(20, 10.0)).transform(m)
    return long_form(t.drop("price", "balance", "status"))


def _multi_ordered(c, y):
    p = f"(sum({y}) OVER (PARTITION BY s) / count(*) OVER (PARTITION BY s))"
    return (f"round((coalesce(sum({y}) OVER (PARTITION BY s, {c} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {p}) "
            f"/ row_number() OVER (PARTITION BY s, {c} ORDER BY id), 6)")


@query("encode_multiclass_ordered_target", "ENC14", f"WITH {fx.MIXED_SQL}, {CLASS_SQL} {multi_sql(_multi_ordered)}")
def _(spark, d):
    return long_form(enc.ordered_target(fx.mixed(spark, d), fx.MIXED).drop("price", "balance", "status"))


@query("encode_multiclass_intercepts", "ENC14 ENC9")
def _(spark, d):
    m = fx.mixed(spark, d)
    return long_form(enc.fit_intercepts(m, fx.MIXED).transform(m).drop("price", "balance", "status"))


@query("encode_multiclass_cross_fitted_target", "ENC14 ENC11")
def _(spark, d):
    m = split.stratified_k_folds(fx.mixed(spark, d), "id", "status", 5, shuffle=True, seed=2)
    return long_form(enc.cross_fitted(m, fx.MIXED, "fold", 5).drop("price", "balance", "status", "fold"))


@query("encode_multiclass_cross_fitted_intercepts", "ENC14 ENC11")
def _(spark, d):
    m = split.stratified_k_folds(fx.mixed(spark, d), "id", "status", 5, shuffle=True, seed=2)
    return long_form(enc.cross_fitted(m, fx.MIXED, "fold", 5, kind="intercepts").drop("price", "balance", "status", "fold"))


@query("encode_collapse", "ENC15", f"WITH {fx.MIXED_SQL} SELECT id, price, balance, status, 1.0::DOUBLE AS cat FROM mixed")
def _(spark, d):
    return enc.collapse(fx.mixed(spark, d), CATS)


@query("encode_hashing", "ENC16", f"""WITH {fx.MIXED_SQL}, h AS (SELECT id, {', '.join(f"('0x' || substr(md5({c}), 32, 1))::BIGINT % 8 AS h{i}" for i, c in enumerate(CATS))} FROM mixed)
SELECT id, {', '.join(f"CAST(h0 = {b} AS INTEGER) + CAST(h1 = {b} AS INTEGER) + CAST(h2 = {b} AS INTEGER) AS col_{b}" for b in range(8))} FROM h""")
def _(spark, d):
    return enc.hashing(fx.mixed(spark, d).select("id", *CATS), CATS, 8)


CONTRAST_SQL = {
    "sum": "CASE WHEN code = 5 THEN -1.0::DOUBLE WHEN code = {j} + 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "helmert": "CASE WHEN code <= {j} + 1 THEN -1.0::DOUBLE WHEN code = {j} + 2 THEN {j} + 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "backward_difference": "CASE WHEN code <= {j} + 1 THEN ({j} + 1.0::DOUBLE - 5) / 5 ELSE ({j} + 1.0::DOUBLE) / 5 END",
}

for _kind, _sql in CONTRAST_SQL.items():
    def _run(spark, d, kind=_kind):
        m = fx.mixed(spark, d).select("id", "segment")
        return rnd(enc.contrasts(m, "segment", kind, enc.fit_ordinal(m, ["segment"], "id"), 5), *[f"segment_{j}" for j in range(4)])

    query(f"encode_contrast_{_kind}", "ENC17", f"""WITH {fx.MIXED_SQL}
SELECT id, {', '.join(f'round({_sql.format(j=j)}, 6) AS segment_{j}' for j in range(4))} FROM mixed JOIN {code_sql('segment')} s ON segment = s.v""")(_run)


@query("encode_contrast_polynomial", "ENC17", f"""WITH {fx.MIXED_SQL}
SELECT id, round((code - 2) / sqrt(2), 6) AS status_0, round(CASE WHEN code = 2 THEN -2 ELSE 1 END / sqrt(6), 6) AS status_1
FROM mixed JOIN {code_sql('status')} s ON status = s.v""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "status")
    return rnd(enc.contrasts(m, "status", "polynomial", enc.fit_ordinal(m, ["status"], "id"), 3), "status_0", "status_1")


@query("encode_leave_one_out", "ENC18", f"""WITH {fx.BINARY_SQL} SELECT id, {per_col(
    '(sum(y) OVER (PARTITION BY {c}) - y) / (count(*) OVER (PARTITION BY {c}) - 1)')} FROM bin""")
def _(spark, d):
    return rnd(enc.leave_one_out(fx.mixed_binary(spark, d), fx.BINARY).select("id", *CATS), *CATS)


@query("encode_m_estimate", "ENC19", f"""WITH {fx.BINARY_SQL} SELECT id, {per_col(
    '(sum(y) OVER (PARTITION BY {c}) + 2 * (SELECT avg(y) FROM bin)) / (count(*) OVER (PARTITION BY {c}) + 2)')} FROM bin""")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    return rnd(enc.fit_formula(m, fx.BINARY, enc.m_estimate(2.0)).transform(m).select("id", *CATS), *CATS)


@query("encode_james_stein", "ENC20", f"""WITH {fx.BINARY_SQL}, v AS (SELECT var_samp(y) AS v, avg(y) AS m FROM bin)
SELECT id, {per_col('avg(y) OVER (PARTITION BY {c}) + var_samp(y) OVER (PARTITION BY {c}) / (var_samp(y) OVER (PARTITION BY {c}) + v) * (m - avg(y) OVER (PARTITION BY {c}))')}
FROM bin, v""")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    return rnd(enc.fit_formula(m, fx.BINARY, enc.james_stein()).transform(m).select("id", *CATS), *CATS)


@query("encode_weight_of_evidence", "ENC21", f"""WITH {fx.BINARY_SQL}, t AS (SELECT sum(y) AS g, sum(1 - y) AS b FROM bin)
SELECT id, {per_col('ln(((sum(y) OVER (PARTITION BY {c}) + 1) / (g + 2)) / ((sum(1 - y) OVER (PARTITION BY {c}) + 1) / (b + 2)))')} FROM bin, t""")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    return rnd(enc.fit_formula(m, fx.BINARY, enc.weight_of_evidence()).transform(m).select("id", *CATS), *CATS)


@query("encode_quantile", "ENC22", f"""WITH {fx.REGRESSION_SQL},
q AS (SELECT flag, (quantile_cont(price, 0.5) * count(*) + (SELECT quantile_cont(price, 0.5) FROM reg)) / (count(*) + 1) AS e FROM reg GROUP BY 1)
SELECT id, round(e, 3) AS flag FROM reg JOIN q USING (flag)""")
def _(spark, d):
    m = fx.mixed_regression(spark, d)
    s = fx.REGRESSION.with_roles(categorical=("flag",))
    return rnd(enc.fit_quantile(m, s).transform(m).select("id", "flag"), "flag", places=3)


@query("encode_map_default", "ENC23", f"""WITH {fx.MIXED_SQL}, t AS (SELECT n_name, n_regionkey::DOUBLE AS e FROM nation WHERE n_regionkey <> 0)
SELECT id, coalesce(e, -1) AS nation FROM mixed LEFT JOIN t ON nation = n_name""")
def _(spark, d):
    t = fx.table(spark, d, "nation").where("n_regionkey <> 0").select(
        F.lit("nation").alias("column"), F.col("n_name").alias("value"), F.col("n_regionkey").cast("double").alias("e"))
    return enc.map_levels(fx.mixed(spark, d), t, ["nation"]).select("id", "nation")
