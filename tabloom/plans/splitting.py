"""Split, fold and resample queries."""

from pyspark.sql import functions as F

from tabloom.operators import split
from tabloom.plans import fixtures as fx
from tabloom.plans.registry import query

U = fx.u_sql
SLIM = "id, status"


def slim(spark, d):
    return fx.mixed(spark, d).select("id", "status")


def rank_sql(seed, salt, by=""):
    return f"row_number() OVER ({by} ORDER BY {U(seed, salt, 'id')}, id)"


@query("split_train_test", "SPL1", f"""WITH {fx.MIXED_SQL}, r AS (SELECT id, status, {rank_sql(0, 'split')} AS r FROM mixed)
SELECT id, status, CASE WHEN r <= 500 THEN 'train' ELSE 'test' END AS part FROM r WHERE r <= 500 + 50000""")
def _(spark, d):
    return split.train_test(slim(spark, d), "id", 500, 50000)


@query("split_stratified", "SPL2", f"""WITH {fx.MIXED_SQL}, c AS (SELECT status, count(*) AS n, 5000 * count(*) / (SELECT count(*) FROM mixed) AS x FROM mixed GROUP BY 1),
q AS (SELECT status, floor(x)::BIGINT + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, status) <= 5000 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM c),
r AS (SELECT id, status, {rank_sql(0, 'split', 'PARTITION BY status')} AS r FROM mixed)
SELECT id, status, CASE WHEN r <= quota THEN 'train' ELSE 'test' END AS part FROM r JOIN q USING (status)""")
def _(spark, d):
    return split.stratified_split(slim(spark, d), "id", "status", 5000)


@query("split_folds", "SPL3", f"""WITH {fx.MIXED_SQL} SELECT id, status, (ntile(7) OVER (ORDER BY id) - 1)::INTEGER AS fold FROM mixed""")
def _(spark, d):
    return split.k_folds(slim(spark, d), "id", 7)


@query("split_folds_shuffled", "SPL3", f"""WITH {fx.MIXED_SQL} SELECT id, status, (ntile(7) OVER (ORDER BY {U(0, 'fold', 'id')}, id) - 1)::INTEGER AS fold FROM mixed""")
def _(spark, d):
    return split.k_folds(slim(spark, d), "id", 7, shuffle=True)


def strat_sql(order):
    return f"""WITH {fx.MIXED_SQL}, cl AS (SELECT status AS s, count(*) AS n, row_number() OVER (ORDER BY min(id)) AS o FROM mixed GROUP BY 1),
st AS (SELECT s, n, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM cl),
cells AS (SELECT s, i, count(*) AS k FROM st, range(7) t(i), generate_series(a, a + n - 1) g(p) WHERE p % 7 = i GROUP BY 1, 2),
up AS (SELECT s, i, sum(k) OVER (PARTITION BY s ORDER BY i) AS upto FROM cells),
r AS (SELECT id, status, row_number() OVER (PARTITION BY status ORDER BY {order}) AS r FROM mixed)
SELECT id, status, (SELECT count(*) FROM up WHERE s = status AND upto < r)::INTEGER AS fold FROM r"""


@query("split_stratified_folds", "SPL4", strat_sql("id"))
def _(spark, d):
    return split.stratified_k_folds(slim(spark, d), "id", "status", 7)


@query("split_stratified_folds_shuffled", "SPL4", strat_sql(f"{U(0, 'fold', 'id')}, id"))
def _(spark, d):
    return split.stratified_k_folds(slim(spark, d), "id", "status", 7, shuffle=True)


@query("split_shuffle", "SPL5", f"""WITH {fx.MIXED_SQL}, r AS (SELECT id, status, {rank_sql(3, 'split')} AS r, count(*) OVER () AS n FROM mixed)
SELECT id, status, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM r""")
def _(spark, d):
    return split.shuffle_split(slim(spark, d), "id", seed=3)


@query("split_equal_chunks", "SPL6", f"""WITH {fx.MIXED_SQL}, r AS (SELECT id, status, row_number() OVER (ORDER BY id) AS r, count(*) OVER () AS n FROM mixed)
SELECT id, status, ((r - 1) // 400)::INTEGER AS fold FROM r WHERE r <= (n // 400) * 400""")
def _(spark, d):
    return split.equal_chunks(slim(spark, d), "id", 400)


@query("split_equal_chunks_stratified", "SPL6", f"""WITH {fx.MIXED_SQL}, h AS (SELECT * FROM (SELECT id, status, row_number() OVER (ORDER BY id) AS q, count(*) OVER () AS n FROM mixed) WHERE q <= (n // 400) * 400),
cl AS (SELECT status AS s, count(*) AS c, max(n // 400) AS k, row_number() OVER (ORDER BY min(id)) AS o FROM h GROUP BY 1),
st AS (SELECT s, k, c, coalesce(sum(c) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM cl),
own AS (SELECT s, k, p % k AS i, count(*) AS m FROM (SELECT s, k, unnest(range(a, a + c)) AS p FROM st) GROUP BY 1, 2, 3),
al AS (SELECT s, i, coalesce(m, 0) AS m FROM (SELECT s, k, unnest(range(k)) AS i FROM st) LEFT JOIN own USING (s, k, i)),
up AS (SELECT s, i, sum(m) OVER (PARTITION BY s ORDER BY i) AS upto FROM al),
r AS (SELECT id, status, row_number() OVER (PARTITION BY status ORDER BY id) AS r FROM h)
SELECT id, status, (SELECT count(*) FROM up WHERE s = status AND upto < r)::INTEGER AS fold FROM r""")
def _(spark, d):
    return split.equal_chunks(slim(spark, d), "id", 400, "status")


def poisson_sql(u):
    cum, term, total = [], 2.718281828459045**-1, 0.0
    for i in range(9):
        total += term
        cum.append(total)
        term /= i + 1
    return " + ".join(f"CAST({u} > {c!r}::DOUBLE AS INTEGER)" for c in cum)


@query("split_bootstrap", "SPL7", f"""WITH {fx.MIXED_SQL}, b AS (SELECT id, price, r, {poisson_sql(U(0, 'boot', 'id', 'r'))} AS w FROM mixed, range(1, 101) t(r))
SELECT r::INTEGER AS replicate, count(*) AS n_rows, sum(w)::BIGINT AS weight, round(sum(w * price) / sum(w), 4) AS mean FROM b WHERE w > 0 GROUP BY 1""")
def _(spark, d):
    b = split.bootstrap_weights(fx.mixed(spark, d).select("id", "price"), "id", 100)
    return b.groupBy("replicate").agg(F.count("*").alias("n_rows"), F.sum("w").alias("weight"),
                                      F.round(F.sum(F.col("w") * F.col("price")) / F.sum("w"), 4).alias("mean"))


@query("split_sample_share", "SPL8", f"""WITH {fx.MIXED_SQL}, r AS (SELECT id, status, {rank_sql(0, 'sample')} AS r, count(*) OVER () AS n FROM mixed)
SELECT id, status FROM r WHERE r <= floor(n * 0.15::DOUBLE)""")
def _(spark, d):
    return split.sample_share(slim(spark, d), "id", 0.15)


@query("split_partitions", "SPL9", f"""WITH {fx.MIXED_SQL} SELECT id, status, (ntile(9) OVER (ORDER BY id) - 1)::INTEGER AS part FROM mixed""")
def _(spark, d):
    return split.partitions(slim(spark, d), "id", 9)


SIZES = (0, 10, 100, 250, 1000, 2500, 10000)


@query("split_prefixes", "SPL10", f"""WITH {fx.MIXED_SQL}, r AS (SELECT id, status, {rank_sql(0, 'prefix')} AS r FROM mixed)
SELECT id, status, s::INTEGER AS n_samples FROM r, unnest({list(SIZES)}) t(s) WHERE r <= s""")
def _(spark, d):
    return split.prefixes(slim(spark, d), "id", SIZES)
