"""Noise mechanism queries: every mechanism over a whole column, seeded so that the oracle can follow."""

from pyspark.sql import functions as F

from tabloom.functions import draws, noise
from tabloom.functions.rng import u01
from tabloom.functions.tables import materialise
from tabloom.plans import fixtures as fx
from tabloom.plans.registry import query

U = fx.u_sql
K = "o_orderkey"


def value():
    return F.col("o_totalprice")


def lap_sql(salt, b):
    u = U(1, salt, K)
    return f"(-sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)) * {b}::DOUBLE)"


def register(name, ids, build, sql):
    def run(spark, d):
        return fx.table(spark, d, "orders").select(K, F.round(build(lambda s: u01(1, s, K)), 3).alias("v"))

    query(name, ids, f"SELECT {K}, round({sql}, 3) AS v FROM orders")(run)


register("noise_laplace", "DPM1", lambda u: noise.laplace(value(), u("lap"), 0.5, 100.0, 0.01),
         f"o_totalprice + {lap_sql('lap', 'CAST(100 / (0.5::DOUBLE - ln(0.99::DOUBLE)) AS DOUBLE)')}")
register("noise_laplace_truncated", "DPM2", lambda u: noise.laplace_truncated(value(), u("lap"), 0.5, 20000.0, 0, 500000),
         f"greatest(0, least(500000, o_totalprice + {lap_sql('lap', 40000)}))")
register("noise_laplace_folded", "DPM2", lambda u: noise.laplace_folded(value(), u("lap"), 0.5, 20000.0, 0, 500000),
         f"least(((o_totalprice + {lap_sql('lap', 40000)}) % 1000000 + 1000000) % 1000000, 1000000 - ((o_totalprice + {lap_sql('lap', 40000)}) % 1000000 + 1000000) % 1000000)")
BN = noise.bounded_noise_limit(1.0, 0.1, 1000.0)
register("noise_laplace_bounded_noise", "DPM4", lambda u: noise.laplace_bounded_noise(value(), u("bn"), 1.0, 0.1, 1000.0),
         f"(SELECT o_totalprice + CASE WHEN p < 0.5 THEN {BN[0]!r}::DOUBLE * ln(2 * p) ELSE -{BN[0]!r}::DOUBLE * ln(2 * (1 - p)) END FROM (SELECT a + {U(1, 'bn', K)} * (1 - 2 * a) AS p FROM (SELECT 0.5::DOUBLE * exp(-{BN[1]!r}::DOUBLE / {BN[0]!r}::DOUBLE) AS a)))")


@query("noise_laplace_bounded_domain", "DPM3", f"""WITH RECURSIVE it AS (SELECT 0 AS i, 40000.0::DOUBLE AS b UNION ALL
  SELECT i + 1, 20000 / (0.5::DOUBLE - ln((2 - exp(-20000 / b) - exp(-(500000 - 20000) / b)) / (1 - exp(-500000 / b)))) FROM it WHERE i < 200),
s AS (SELECT b FROM it WHERE i = 200),
c AS (SELECT {K}, greatest(0, least(500000, o_totalprice)) AS v, b, {U(1, 'bd', K)} AS u FROM orders, s),
p AS (SELECT {K}, v, b, 0.5::DOUBLE * exp(-v / b) + u * (1 - 0.5::DOUBLE * exp((v - 500000) / b) - 0.5::DOUBLE * exp(-v / b)) AS p FROM c)
SELECT {K}, round(CASE WHEN p < 0.5 THEN v + b * ln(2 * p) ELSE v - b * ln(2 * (1 - p)) END, 2) AS v FROM p""")
def _(spark, d):
    v = noise.laplace_bounded_domain(value(), u01(1, "bd", K), 0.5, 20000.0, 0.0, 500000.0)
    return fx.table(spark, d, "orders").select(K, F.round(v, 2).alias("v"))


def geo_sql(value, decay):
    u, q = U(1, 'geo', K), f"exp(-{decay})"
    return (f"({value} + CASE WHEN {u} * (1 + {q}) <= {q} THEN -floor(-ln({u} * (1 + {q})) / {decay})"
            f" ELSE ceil(-ln((1 - {u}) * (1 + {q})) / {decay}) - 1 END)")


@query("noise_geometric", "DPM5", f"""WITH g AS (SELECT {K}, {geo_sql('o_custkey', '(0.25::DOUBLE)')} AS g FROM orders)
SELECT {K}, g::BIGINT AS g, greatest(100, least(1000, g))::BIGINT AS truncated, (100 + least(((g - 100) % 1800 + 1800) % 1800, 1800 - ((g - 100) % 1800 + 1800) % 1800))::BIGINT AS folded FROM g""")
def _(spark, d):
    u, v = u01(1, "geo", K), F.col("o_custkey")
    return fx.table(spark, d, "orders").select(K, noise.geometric(v, u, 0.25).alias("g"), noise.geometric_truncated(v, u, 0.25, 100, 1000).alias("truncated"),
                                               noise.geometric_folded(v, u, 0.25, 100, 1000).alias("folded"))


def normal_sql(scale):
    return f"o_totalprice + {scale!r}::DOUBLE * sqrt(-2 * ln({U(1, 'g1', K)})) * cos(2 * pi() * {U(1, 'g2', K)})"


SC, SA = noise.gaussian_scale(0.5, 1e-5, 100.0), noise.gaussian_analytic_scale(2.0, 1e-5, 100.0)
register("noise_gaussian", "DPM6", lambda u: noise.gaussian(value(), u("g1"), u("g2"), SC), normal_sql(SC))
register("noise_gaussian_analytic", "DPM7", lambda u: noise.gaussian(value(), u("g1"), u("g2"), SA), normal_sql(SA))
TOP, CUM = noise.discrete_table(noise.gaussian_discrete_scale(0.8, 1e-5))


@query("noise_gaussian_discrete", "DPM8", f"""WITH u AS (SELECT {K}, o_custkey, {U(1, 'gd', K)} AS u FROM orders)
SELECT {K}, o_custkey + len(list_filter({CUM[:-1]}::DOUBLE[], lambda c: c < u)) - {TOP} AS v FROM u""")
def _(spark, d):
    scale = noise.gaussian_discrete_scale(0.8, 1e-5)
    o = fx.table(spark, d, "orders").withColumn("u", u01(1, "gd", K))
    return o.select(K, noise.gaussian_discrete(F.col("o_custkey"), F.col("u"), scale).alias("v"))


register("noise_staircase", "DPM9", lambda u: noise.staircase(value(), (u("a"), u("b"), u("c"), u("e")), 1.0, 100.0, 0.3),
         f"""o_totalprice + CASE WHEN {U(1, 'a', K)} < 0.5 THEN -1 ELSE 1 END * 100 * (floor(ln({U(1, 'b', K)}) / -1) +
         CASE WHEN {U(1, 'e', K)} < 0.3::DOUBLE / (0.3::DOUBLE + 0.7::DOUBLE * exp(-1)) THEN 0.3::DOUBLE * {U(1, 'c', K)} ELSE 0.3::DOUBLE + 0.7::DOUBLE * {U(1, 'c', K)} END)""")
register("noise_uniform", "DPM10", lambda u: noise.uniform(value(), u("un"), 0.1, 10.0), f"o_totalprice + ({U(1, 'un', K)} - 0.5) * 100")


@query("noise_binary", "DPM11", f"""SELECT l_orderkey, l_linenumber, CASE WHEN {U(1, 'bin', 'l_orderkey', 'l_linenumber')} < 1 / (1 + exp(-0.7::DOUBLE)) THEN l_linestatus
WHEN l_linestatus = 'O' THEN 'F' ELSE 'O' END AS v FROM lineitem""")
def _(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", noise.binary(
        F.col("l_linestatus"), u01(1, "bin", "l_orderkey", "l_linenumber"), 0.7, "O", "F").alias("v"))


def draw_sql(law):
    return f"""WITH {law}, cum AS (SELECT *, sum(w) OVER (PARTITION BY value ORDER BY out) / sum(w) OVER (PARTITION BY value) AS hi, (sum(w) OVER (PARTITION BY value ORDER BY out) - w) / sum(w) OVER (PARTITION BY value) AS lo FROM law),
u AS (SELECT c_custkey, n_name, {U(1, 'cat', 'c_custkey')} AS u FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, n_name, out AS v FROM u JOIN cum ON value = n_name AND u >= lo AND u < hi"""


def released(spark, d, utilities, epsilon):
    law = materialise(draws.interval_table(draws.category_transitions(utilities, epsilon), ["value"], "out", "p"))
    c, n = fx.table(spark, d, "customer"), fx.table(spark, d, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", F.col("n_name").alias("value"))
    return draws.draw(rows, law, ["value"], "out", u01(1, "cat", "c_custkey"), "v").select("c_custkey", "n_name", "v")


@query("noise_category", "DPM12", draw_sql("""law AS (SELECT a.n_name AS value, b.n_name AS out, exp(-2 * abs(a.n_nationkey - b.n_nationkey) / 24 / 2) AS w FROM nation a, nation b)"""))
def _(spark, d):
    n = fx.table(spark, d, "nation").select(F.lit(1).alias("j"), "n_name", "n_nationkey")
    pairs = n.select("j", F.col("n_name").alias("value"), F.col("n_nationkey").alias("a")).join(
        n.select("j", F.col("n_name").alias("out"), F.col("n_nationkey").alias("b")), "j")
    return released(spark, d, pairs.select("value", "out", F.abs(F.col("a") - F.col("b")).cast("double").alias("utility")), 2.0)


@query("noise_hierarchy", "DPM13", draw_sql("""cnt AS (SELECT max(z) - min(z) AS gap FROM (SELECT n_regionkey, sum(exp(-1.5::DOUBLE * CASE WHEN a.n_name = b.n_name THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 2 END / 2)) AS z
  FROM nation a JOIN (SELECT n_name, n_regionkey FROM nation) b ON TRUE GROUP BY a.n_name, a.n_regionkey)),
law AS (SELECT a.n_name AS value, b.n_name AS out, exp(-1.5::DOUBLE * CASE WHEN a.n_name = b.n_name THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 2 END / 2 / CASE WHEN gap < 1e-8 THEN 1 ELSE 2 END) AS w FROM nation a, nation b, cnt)""".replace("SELECT n_regionkey, sum", "SELECT a.n_regionkey, sum")))
def _(spark, d):
    return released(spark, d, draws.hierarchy_utilities(fx.table(spark, d, "nation"), "n_name", ["n_regionkey"]), 1.5)


CAND = """c AS (SELECT p_brand, p_type, count(*) AS n, sum(p_size)::DOUBLE AS m FROM part GROUP BY 1, 2)"""


def cands(spark, d):
    return fx.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("p_size").cast("double").alias("m"))


@query("noise_exponential_select", "DPM14", f"""WITH {CAND} SELECT p_brand, arg_max(p_type, n * 0.4::DOUBLE / 2 + ln(m) - ln(-ln({U(1, 'em', 'p_brand', 'p_type')}))) AS p_type FROM c GROUP BY 1""")
def _(spark, d):
    return draws.exponential_select(cands(spark, d), ["p_brand"], "p_type", F.col("n"), 0.4, 1.0, u01(1, "em", "p_brand", "p_type"), measure=F.col("m"))


@query("noise_permute_and_flip", "DPM15", f"""WITH {CAND} SELECT p_brand, arg_max(p_type, n * 0.4::DOUBLE - ln({U(1, 'pf', 'p_brand', 'p_type')})) AS p_type FROM c GROUP BY 1""")
def _(spark, d):
    return draws.permute_and_flip(cands(spark, d), ["p_brand"], "p_type", F.col("n"), 0.4, 1.0, u01(1, "pf", "p_brand", "p_type"), monotonic=True)


@query("noise_expected_error", "DPM16", """SELECT c_custkey, round(500 * (exp((-1000 - c_acctbal) / 1000) - exp((c_acctbal - 10000) / 1000)), 4) AS bias,
round(2000000 - 1000 * (1000 + c_acctbal + 1000) * exp(-(c_acctbal + 1000) / 1000) - 1000 * (1000 + 10000 - c_acctbal) * exp(-(10000 - c_acctbal) / 1000)
 - (500 * (exp((-1000 - c_acctbal) / 1000) - exp((c_acctbal - 10000) / 1000))) ** 2, 2) AS variance FROM customer""")
def _(spark, d):
    v = F.col("c_acctbal")
    return fx.table(spark, d, "customer").select("c_custkey", F.round(noise.truncated_bias(v, 1000.0, -1000.0, 10000.0), 4).alias("bias"),
                                                 F.round(noise.truncated_variance(v, 1000.0, -1000.0, 10000.0), 2).alias("variance"))


@query("noise_rounded", "DPM17", f"""SELECT {K}, round_even(o_totalprice + {lap_sql('lap', 200)}, 0)::BIGINT AS v, round_even(o_totalprice + {lap_sql('lap', 200)}, 0)::BIGINT::VARCHAR AS text FROM orders""")
def _(spark, d):
    v = noise.rounded(noise.laplace(value(), u01(1, "lap", K), 0.5, 100.0))
    return fx.table(spark, d, "orders").select(K, v.alias("v"), noise.as_text(v).alias("text"))
