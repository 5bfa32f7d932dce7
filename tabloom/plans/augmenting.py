"""Augmentation, nearest-neighbour, oversampling and privacy-distance queries."""

from pyspark.sql import functions as F

from tabloom.functions.rng import u01
from tabloom.operators import augment as au
from tabloom.operators import privacy, smote, split
from tabloom.operators.knn import nearest
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd
from tabloom.plans.registry import query

U = fx.u_sql


@query("augment_union", "AUG1", f"WITH {fx.HALVES_SQL} SELECT *, 'real' AS origin FROM rl UNION ALL SELECT id, priority, segment, nation, round(price, 4), balance, status, 'synthetic' FROM sy")
def _(spark, d):
    real, synth = fx.real_and_synthetic(spark, d)
    return au.union_origin(real, synth.withColumn("price", F.round("price", 4)))


@query("augment_combine_by_position", "AUG2", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return au.combine_by_position(c, fx.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"))


@query("augment_inject_target", "AUG3", f"WITH {fx.MIXED_SQL} SELECT id, price, status FROM mixed")
def _(spark, d):
    x, y = au.extract_target(fx.mixed(spark, d).select("id", "price", "status"), "id", "status")
    return au.inject_target(x, y, "id")


@query("augment_nearest_class", "AUG5", """WITH c AS (SELECT DISTINCT quality::DOUBLE * 3 AS c FROM labels UNION SELECT 1.0::DOUBLE)
SELECT l_orderkey, l_linenumber, (SELECT arg_min(c, struct_pack(d := abs(c - l_discount * 40), n := -c)) FROM c) AS cls FROM lineitem""")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 40).alias("v"))
    classes = fx.table(spark, d, "labels").select((F.col("quality") * 3.0).alias("c")).union(spark.range(1).select(F.lit(1.0)))
    return au.nearest_class(li, "v", classes, "cls").drop("v")


@query("augment_multiplied_quota", "AUG6", "SELECT count(*) AS n, round_even(count(*) * 2.5::DOUBLE, 0)::BIGINT AS generated, (round_even(count(*) * 2.5::DOUBLE, 0) + count(*))::BIGINT AS total FROM orders")
def _(spark, d):
    return au.multiplied_quota(fx.table(spark, d, "orders"), 2.5, True)


QUOTA = {"proportional": "round_even(n + 1000 * n / t, 0) - n", "balanced": "round_even(n + 1000 / k, 0) - n",
         "share": "round_even(1000 * n / t, 0)", "equal": "round_even(1000 / k, 0)"}


@query("augment_quotas", "AUG7", "WITH c AS (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM orders GROUP BY 1) "
       + " UNION ALL ".join(f"SELECT '{k}' AS kind, o_orderpriority, n, ({e})::BIGINT AS quota FROM c" for k, e in QUOTA.items()))
def _(spark, d):
    o, out = fx.table(spark, d, "orders"), None
    for k in QUOTA:
        q = au.quotas(o, "o_orderpriority", 1000, k).select(F.lit(k).alias("kind"), "o_orderpriority", "n", "quota")
        out = q if out is None else out.unionByName(q)
    return out


@query("augment_balance_gap", "AUG8", f"WITH {fx.BINARY_SQL}, c AS (SELECT y, count(*) AS n FROM bin GROUP BY 1) SELECT arg_min(y, n) AS minority, max(n) - min(n) AS missing FROM c")
def _(spark, d):
    return au.balance_gap(fx.mixed_binary(spark, d), "y")


@query("augment_balanced_table", "AUG8")
def _(spark, d):
    m = fx.mixed_binary(spark, d).select("id", "balance", "y")
    gap = au.balance_gap(m, "y").first()
    v = m.select("id", F.array("balance").alias("vec"), "y").where(F.col("y") == gap["minority"])
    new = smote.smote_unlabelled(v, gap["missing"]).select(F.lit(gap["minority"]).alias("y"), F.col("vec")[0].alias("balance"))
    return m.select("y", "balance").unionByName(new).groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("balance"), 4).alias("mean"))


@query("augment_noisy_vote", "AUG10", f"""WITH {fx.BINARY_SQL}, p AS (SELECT *, ntile(5) OVER (ORDER BY id) AS part FROM bin),
t AS (SELECT part, avg(balance) FILTER (y = 1) AS m1, avg(balance) FILTER (y = 0) AS m0 FROM p GROUP BY 1),
v AS (SELECT id, count(*) FILTER ((balance > (m1 + m0) / 2) = (m1 > m0)) AS votes FROM bin, t GROUP BY 1)
SELECT id, votes, CAST(votes - sign({U(6, 'vote', 'id')} - 0.5) * ln(1 - 2 * abs({U(6, 'vote', 'id')} - 0.5)) * 0.8::DOUBLE > 2.5 AS INTEGER) AS label FROM v""")
def _(spark, d):
    m = fx.mixed_binary(spark, d).select("id", "balance", "y")
    mean = lambda c: F.avg(F.when(F.col("y") == c, F.col("balance")))
    teachers = split.partitions(m, "id", 5).groupBy("part").agg(mean(1).alias("m1"), mean(0).alias("m0"))
    models = teachers.agg(F.collect_list(F.struct("m1", "m0"))).scalar()  # one entry per teacher
    v = m.select("id", "balance", models.alias("t")).select(
        "id", F.size(F.filter("t", lambda t: (F.col("balance") > (t["m1"] + t["m0"]) / 2) == (t["m1"] > t["m0"]))).cast("long").alias("votes"))
    return au.noisy_majority(v, "votes", 5, 0.8, u01(6, "vote", "id"))


@query("augment_foreign_keys", "AUG11", f"""WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer)
SELECT o_orderkey, c_custkey AS custkey FROM orders JOIN p ON r = least(floor({U(0, 'fk', 'o_orderkey')} * n) + 1, n)""")
def _(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey")
    return au.fill_foreign_keys(o, fx.table(spark, d, "customer"), "c_custkey", "o_orderkey", "custkey")


@query("augment_experiment_grid", "AUG12", f"""WITH {fx.RESULTS_SQL}, g AS (SELECT DISTINCT coalesce(generator, 'none') AS generator FROM res), e AS (SELECT DISTINCT encoder FROM res),
s AS (SELECT DISTINCT random_state FROM res) SELECT * FROM g, e, s, (VALUES ('f1'), ('roc_auc')) m(metric)""")
def _(spark, d):
    r = fx.results(spark, d).withColumn("generator", F.coalesce("generator", F.lit("none")))
    return au.experiment_grid(spark, generator=au.class_list(r, "generator"), encoder=au.class_list(r, "encoder"),
                              random_state=au.class_list(r, "random_state"), metric=["f1", "roc_auc"])


# --- neighbours ---------------------------------------------------------------------

def dist_sql(a="a.embedding", b="b.embedding"):
    return f"sqrt(list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: (z[1] - z[2]) ** 2)))"


@query("nearest_rows", "KNN1", f"""WITH p AS (SELECT a.vec_id, b.vec_id AS o, {dist_sql()} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS k FROM p)
SELECT vec_id AS id, k AS place, o AS neighbour, round(d, 6) AS dist FROM r WHERE k <= 5""")
def _(spark, d):
    v = fx.vectors(spark, d)
    n = nearest(v, v, 5, exclude_self=True).select("id", F.posexplode("neighbours"))
    return n.select("id", (F.col("pos") + 1).cast("long").alias("place"), F.col("col.id").alias("neighbour"), F.round("col.dist", 6).alias("dist"))


PRV_COLUMNS = ("priority", "segment", "nation", "status", "price", "balance")


def coded_sql(rows):
    """Features and target of (t, ...) as numbers, each in units of its own table t."""
    codes = ", ".join(f"(dense_rank() OVER (ORDER BY {c}))::DOUBLE AS x{i}" if i < 4 else f"{c} AS x{i}" for i, c in enumerate(PRV_COLUMNS))
    units = ", ".join(f"(x{i} - avg(x{i}) OVER (PARTITION BY t)) / coalesce(nullif(stddev_pop(x{i}) OVER (PARTITION BY t), 0), 1) AS x{i}" for i in range(6))
    return f"cd AS (SELECT t, id, {codes} FROM ({rows})), st AS (SELECT t, id, {units} FROM cd)"


PRV_SQL = f"{fx.HALVES_SQL}, {coded_sql('SELECT 0 AS t, * FROM rl UNION ALL SELECT 1, * FROM sy')}, rs AS (SELECT * FROM st WHERE t = 0), ss AS (SELECT * FROM st WHERE t = 1)"


def two_sql(a, b, extra=""):
    gap = " + ".join(f"(a.x{i} - b.x{i}) ** 2" for i in range(6))
    return f"nn AS (SELECT i, m[1] AS d1, m[2] AS d2 FROM (SELECT a.id AS i, min(sqrt({gap}), 2) AS m FROM {a} a, {b} b {extra} GROUP BY 1))"


@query("privacy_two_nearest", "PRV1 KNN1", f"WITH {PRV_SQL}, {two_sql('rs', 'ss')} SELECT i AS id, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM nn")
def _(spark, d):
    return rnd(privacy.two_nearest(*fx.real_and_synthetic(spark, d), fx.MIXED), "d1", "d2")


@query("privacy_closest_record", "PRV1 PRV2", f"""WITH {PRV_SQL}, {two_sql('rs', 'ss')}
SELECT round(quantile_cont(d1, 0.05), 6) AS dcr, round(quantile_cont(d1 / nullif(d2, 0), 0.05), 6) AS nndr FROM nn""")
def _(spark, d):
    return rnd(privacy.closest_record(*fx.real_and_synthetic(spark, d), fx.MIXED), "dcr", "nndr")


@query("privacy_within_sample", "PRV3", f"""WITH {fx.HALVES_SQL}, smp AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {U(0, 'sample', 'id')}, id) AS r, count(*) OVER () AS n FROM rl) WHERE r <= floor(n * 0.15::DOUBLE)),
{coded_sql('SELECT 0 AS t, * FROM smp')}, rs AS (SELECT * FROM st), {two_sql('rs', 'rs', 'WHERE a.id <> b.id')}
SELECT round(quantile_cont(d1, 0.05), 6) AS dcr, round(quantile_cont(d1 / nullif(d2, 0), 0.05), 6) AS nndr FROM nn""")
def _(spark, d):
    s = split.sample_share(fx.real_and_synthetic(spark, d)[0], "id", 0.15)
    return rnd(privacy.closest_record(s, s, fx.MIXED, exclude_self=True), "dcr", "nndr")


# --- oversampling -------------------------------------------------------------------

def smote_sql(quota):
    """First two coordinates of every synthetic row, by brute force inside each class."""
    return f"""WITH c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM embeddings GROUP BY 1),
q AS (SELECT label, n, ({quota})::BIGINT AS quota, coalesce(sum(({quota})::BIGINT) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM c),
ask AS (SELECT (st + i)::BIGINT AS "row", label, n FROM q, range(0, (SELECT max(quota) FROM q)) t(i) WHERE i < quota),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
bs AS (SELECT "row", ask.label, vec_id, embedding FROM ask JOIN rk ON rk.label = ask.label AND r = floor({U(0, 'base', '"row"')} * n) + 1),
nb AS (SELECT vec_id, o, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS k FROM (SELECT a.vec_id, b.vec_id AS o, {dist_sql()} AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)),
j AS (SELECT "row", bs.label, bs.embedding AS x, e.embedding AS z, {U(0, 'gap', '"row"')} AS g FROM bs JOIN nb ON nb.vec_id = bs.vec_id AND nb.k = floor({U(0, 'near', '"row"')} * 5) + 1 JOIN embeddings e ON e.vec_id = nb.o)
SELECT "row", label, round(x[1]::DOUBLE + g * (z[1]::DOUBLE - x[1]::DOUBLE), 6) AS v1, round(x[64]::DOUBLE + g * (z[64]::DOUBLE - x[64]::DOUBLE), 6) AS v64 FROM j"""


def ends(df, *keep):
    return df.select("row", *keep, F.round(F.col("vec")[0], 6).alias("v1"), F.round(F.col("vec")[63], 6).alias("v64"))


@query("generate_smote_proportional", "GEN1", smote_sql("round_even(n + 2 * t * n / t, 0) - n"))
def _(spark, d):
    v = fx.vectors(spark, d)
    return ends(smote.smote(v, 2 * v.count()), "label")


@query("generate_smote_balanced", "GEN2", smote_sql("round_even(n + 2 * t / k, 0) - n"))
def _(spark, d):
    v = fx.vectors(spark, d)
    return ends(smote.smote(v, 2 * v.count(), kind=smote.BALANCED), "label")


@query("generate_smote_unlabelled", "GEN3")
def _(spark, d):
    v = fx.vectors(spark, d)
    return ends(smote.smote_unlabelled(v, 2 * v.count()))
