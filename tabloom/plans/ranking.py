"""Result-table queries."""

from pyspark.sql import functions as F

from tabloom.operators import results as rs
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd
from tabloom.plans.registry import query

KEY = "dataset, encoder, generator, teacher, random_state"


@query("results_first_baselines", "RES1", f"""WITH {fx.RESULTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, random_state ORDER BY run_time, encoder) AS o FROM res
WHERE generator IS NULL AND teacher IS NULL)
SELECT {KEY}, performance FROM r WHERE o = 1 UNION ALL SELECT {KEY}, performance FROM res WHERE generator IS NOT NULL OR teacher IS NOT NULL""")
def _(spark, d):
    r = rs.first_baselines(fx.results(spark, d), by=["dataset", "random_state"], order=["run_time", "encoder"])
    return r.select(*KEY.split(", "), "performance")


@query("results_average_folds", "RES2", f"""WITH {fx.RESULTS_SQL}, t AS (SELECT *, CASE WHEN random_state > 2 THEN random_state % 3 END AS fold FROM res)
SELECT dataset, encoder, generator, teacher, n_samples, round(avg(jsd), 6) AS jsd, avg(fold) AS generated_fold FROM t WHERE fold IS NOT NULL GROUP BY 1, 2, 3, 4, 5
UNION ALL SELECT dataset, encoder, generator, teacher, n_samples, round(jsd, 6), NULL FROM t WHERE fold IS NULL AND NOT n_samples BETWEEN 100 AND 199""")
def _(spark, d):
    r = fx.results(spark, d).withColumn("generated_fold", F.when(F.col("random_state") > 2, F.col("random_state") % 3))
    return rnd(rs.average_folds(r, ["dataset", "encoder", "generator", "teacher"], ["jsd"], 100, 200), "jsd")


@query("results_score_lists", "RES3", f"""WITH {fx.RESULTS_SQL} SELECT dataset, encoder, generator, teacher,
string_agg(random_state || ':' || floor(performance * 1000)::BIGINT, ',' ORDER BY random_state) AS scores FROM res GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    r = fx.results(spark, d).withColumn("v", F.concat(F.col("random_state"), F.lit(":"), F.floor(F.col("performance") * 1000)))
    s = rs.score_lists(r, "v")
    return s.withColumn("scores", F.concat_ws(",", "scores"))


# Two-sided 5 % points of Student's t for 1..6 degrees of freedom.
T05 = [12.706204736432095, 4.302652729911275, 3.182446305284263, 2.7764451051977987, 2.570581835636314, 2.4469118511449692]


def tests_sql(se="sd / sqrt(n)", dof="n - 1"):
    crit = "CASE " + " ".join(f"WHEN {dof} = {i + 1} THEN {t}" for i, t in enumerate(T05)) + " END"
    return f"""nm AS (SELECT dataset, concat_ws(' ', encoder, coalesce(generator, 'nan'), coalesce(teacher, 'nan')) AS c, random_state AS s, performance AS x FROM res),
pd AS (SELECT dataset, p.c AS a, q.c AS b, avg(p.x - q.x) AS m, stddev_samp(p.x - q.x) AS sd, count(*) AS n FROM nm p JOIN nm q USING (dataset, s) GROUP BY 1, 2, 3),
ts AS (SELECT dataset, a, b, CASE WHEN ({se} > 1e-12 AND abs(m) / ({se}) > {crit}) OR ({se} <= 1e-12 AND abs(m) > 1e-12) THEN CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.5::DOUBLE END AS win FROM pd)"""


@query("results_paired_tests", "RES4", f"WITH {fx.RESULTS_SQL}, {tests_sql()} SELECT * FROM ts")
def _(spark, d):
    return rs.paired_tests(fx.results(spark, d), "performance").drop("p_value")


@query("results_resampled_tests", "RES5", f"WITH {fx.RESULTS_SQL}, {tests_sql('sd * sqrt(1 / 5 + 0.25::DOUBLE)', '4')} SELECT * FROM ts")
def _(spark, d):
    return rs.paired_tests(fx.results(spark, d), "performance", resample=(5, 400, 100)).drop("p_value")


RANK_SQL = f"""{fx.RESULTS_SQL}, {tests_sql()},
rk AS (SELECT dataset, a, sum(win) AS wins, row_number() OVER (PARTITION BY dataset ORDER BY sum(win), a) - 1 AS rank FROM ts GROUP BY 1, 2)"""


def ranks(spark, d):
    return rs.win_ranks(rs.paired_tests(fx.results(spark, d), "performance"))


@query("results_win_ranks", "RES6", f"WITH {RANK_SQL} SELECT dataset, a, wins, rank FROM rk")
def _(spark, d):
    return ranks(spark, d)


# Fixed values, printed tables at 5 %: studentised range over the root of 2 for 2..20 items, chi-square for 1..19 degrees of freedom.
NEMENYI_05 = [1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544]
CHI2_05 = [3.841, 5.991, 7.815, 9.488, 11.070, 12.592, 14.067, 15.507, 16.919, 18.307, 19.675, 21.026, 22.362, 23.685, 24.996, 26.296, 27.587, 28.869, 30.144]

FRIEDMAN_SQL = """tr AS (SELECT dataset, a, rank() OVER (PARTITION BY dataset ORDER BY wins) + (count(*) OVER (PARTITION BY dataset, wins) - 1) / 2 AS tr FROM rk),
ti AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*) AS c FROM rk GROUP BY dataset, wins)),
z AS (SELECT count(DISTINCT dataset) AS n, count(DISTINCT a) AS k FROM rk)"""


@query("results_friedman", "RES7", f"""WITH {RANK_SQL}, {FRIEDMAN_SQL}
SELECT n, k, round((12 / (n * k * (k + 1)) * (SELECT sum(s * s) FROM (SELECT sum(tr) AS s FROM tr GROUP BY a)) - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))), 6) AS statistic FROM z, ti""")
def _(spark, d):
    return rnd(rs.friedman(ranks(spark, d), score="wins").drop("p_value"), "statistic")


@query("results_nemenyi_ranks", "RES7", f"""WITH {RANK_SQL}, {FRIEDMAN_SQL}, m AS (SELECT a, avg(tr) AS m FROM tr GROUP BY 1),
fr AS (SELECT (12 / (n * k * (k + 1)) * (SELECT sum(s * s) FROM (SELECT sum(tr) AS s FROM tr GROUP BY a)) - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))) AS f FROM z, ti),
w AS (SELECT x.a, CASE WHEN (SELECT f FROM fr) < (list_extract({CHI2_05}, (k - 1)::BIGINT))::DOUBLE OR abs(x.m - y.m) <= (list_extract({NEMENYI_05}, (k - 1)::BIGINT))::DOUBLE * sqrt(k * (k + 1) / (6 * n)) THEN 0.5::DOUBLE WHEN x.m > y.m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS win FROM m x, m y, z),
s AS (SELECT a, sum(win) AS wins FROM w GROUP BY 1)
SELECT a, wins, rank() OVER (ORDER BY wins) + (count(*) OVER (PARTITION BY wins) - 1) / 2 - 1 AS rank FROM s""")
def _(spark, d):
    return rs.overall_ranks(rs.nemenyi(ranks(spark, d), score="wins"))


@query("results_top_runs", "RES8", f"""WITH {fx.RESULTS_SQL}, f AS (SELECT * FROM res WHERE generator IS NOT NULL OR teacher IS NULL),
t AS (SELECT dataset, encoder, generator, teacher, random_state, row_number() OVER (PARTITION BY dataset ORDER BY performance DESC, encoder, generator, teacher, random_state) AS place FROM f)
SELECT *, 'efficacy' AS kind FROM t WHERE place <= 5""")
def _(spark, d):
    r = rs.without_teacher_only(fx.results(spark, d))
    t = rs.top_n(r, 5, ["dataset"], [F.desc("performance"), *[F.asc_nulls_last(c) for c in ("encoder", "generator", "teacher", "random_state")]])
    return t.select("dataset", "encoder", "generator", "teacher", "random_state", "place", rs.metric_kind(F.lit("performance")).alias("kind"))


TOP_SQL = f"""{fx.RESULTS_SQL}, top AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY dataset, random_state ORDER BY performance DESC, encoder, generator NULLS LAST, teacher NULLS LAST) <= 3)"""


def top3(spark, d):
    return rs.top_n(fx.results(spark, d), 3, ["dataset", "random_state"],
                    [F.desc("performance"), F.asc("encoder"), F.asc_nulls_last("generator"), F.asc_nulls_last("teacher")])


@query("results_top_counts", "RES9", f"""WITH {TOP_SQL}, c AS (SELECT coalesce(generator, 'nan') AS generator, dataset FROM top),
g AS (SELECT generator, dataset FROM c UNION ALL SELECT 'total', dataset FROM c)
SELECT generator, {', '.join(f"count(*) FILTER (dataset = 'set{i}') AS set{i}" for i in range(4))}, count(*) AS total FROM g GROUP BY 1""")
def _(spark, d):
    return rs.top_counts(top3(spark, d), "generator", "dataset", [f"set{i}" for i in range(4)])


@query("results_membership_counts", "RES10", f"""WITH {TOP_SQL}
SELECT dataset, count(*) FILTER (encoder IN ('TargetEncoder') AND coalesce(generator, 'nan') IN ('nan', 'PrivBNGenerator')) AS n,
count(*) FILTER (encoder NOT IN ('TargetEncoder') AND coalesce(generator, 'nan') NOT IN ('nan', 'PrivBNGenerator')) AS n_out FROM top GROUP BY 1""")
def _(spark, d):
    t = top3(spark, d)
    lists = {"encoder": ["TargetEncoder"], "generator": ["nan", "PrivBNGenerator"]}
    out = rs.membership_counts(t, lists, "dataset", exclude=True).withColumnRenamed("n", "n_out")
    return rs.membership_counts(t, lists, "dataset").join(out, "dataset")


@query("results_run_times", "RES11", f"""WITH {fx.RESULTS_SQL} SELECT coalesce(generator, 'nan') AS generator, min(run_time) AS low, round(quantile_cont(run_time, 0.25), 6) AS q1,
round(quantile_cont(run_time, 0.5), 6) AS median, round(quantile_cont(run_time, 0.75), 6) AS q3, max(run_time) AS high FROM res GROUP BY 1""")
def _(spark, d):
    return rnd(rs.run_time_summary(fx.results(spark, d)), "q1", "median", "q3")


@query("results_means", "RES12", f"""WITH {fx.RESULTS_SQL} SELECT coalesce(teacher, generator, encoder) AS model, random_state, round(avg(performance), 5) AS performance, round(avg(run_time), 4) AS run_time FROM res GROUP BY 1, 2""")
def _(spark, d):
    r = rs.mean_by(fx.results(spark, d), ["model", "random_state"], ["performance", "run_time"], {"model": ["teacher", "generator", "encoder"]})
    return r.select("model", "random_state", F.round("performance", 5).alias("performance"), F.round("run_time", 4).alias("run_time"))


@query("results_with_baselines", "RES13", f"""WITH {fx.RESULTS_SQL}, b AS (SELECT dataset, encoder, avg(performance) FILTER (generator IS NULL AND teacher IS NULL) AS s,
avg(performance) FILTER (generator IS NULL AND teacher IS NOT NULL) AS t FROM res GROUP BY 1, 2)
SELECT {KEY}, performance, round(s, 5) AS student_baseline, round(t, 5) AS teacher_baseline FROM res JOIN b USING (dataset, encoder) WHERE generator IS NOT NULL""")
def _(spark, d):
    r = rs.with_baselines(fx.results(spark, d))
    return rnd(r.select(*KEY.split(", "), "performance", "student_baseline", "teacher_baseline"), "student_baseline", "teacher_baseline", places=5)


@query("results_facet_series", "RES13", f"""WITH {fx.RESULTS_SQL} SELECT dataset, coalesce(generator, 'nan') AS generator, random_state, round(avg(performance), 5) AS mean,
round(quantile_cont(performance, 0.25), 5) AS q1, round(quantile_cont(performance, 0.5), 5) AS median, round(quantile_cont(performance, 0.75), 5) AS q3
FROM (SELECT * REPLACE (performance * 1.00012345::DOUBLE AS performance) FROM res) GROUP BY 1, 2, 3""")
def _(spark, d):
    r = rs.facet_series(fx.results(spark, d).select("dataset", "generator", "random_state", (F.col("performance") * 1.00012345).alias("performance")),
                        ["dataset", "generator"], "random_state", "performance")
    return rnd(r, "mean", "q1", "median", "q3", places=5)


PRE_SQL = fx.BENCH_SQL + """, me AS (SELECT synthesizer, dataset, modality, avg(normalized_score) AS normalized_score, avg(metric_time) AS metric_time, avg(model_time) AS model_time,
  arg_min(error, iteration) FILTER (error IS NOT NULL) AS e FROM bs GROUP BY 1, 2, 3),
pp AS (SELECT synthesizer, dataset, modality, normalized_score, metric_time, model_time,
  CAST(coalesce(metric_time IS NULL AND contains(e, 'Synthesizer Timeout'), FALSE) AS INTEGER) AS timeout,
  CAST(coalesce(metric_time IS NULL AND contains(e, 'MemoryError'), FALSE) AS INTEGER) AS memory_error,
  CASE WHEN metric_time IS NULL AND NOT contains(coalesce(e, ''), 'Synthesizer Timeout') AND NOT contains(coalesce(e, ''), 'MemoryError') THEN coalesce(e, '') END AS error FROM me)"""


@query("leaderboard_preprocess", "RES14", f"""WITH {PRE_SQL} SELECT synthesizer, dataset, modality, round(normalized_score, 5) AS normalized_score,
round(metric_time, 4) AS metric_time, round(model_time, 4) AS model_time, timeout, memory_error, error FROM pp""")
def _(spark, d):
    p = rs.preprocess_scores(fx.bench_scores(spark, d))
    return p.withColumns({"normalized_score": F.round("normalized_score", 5), "metric_time": F.round("metric_time", 4), "model_time": F.round("model_time", 4)})


def one_modality(spark, d):
    return rs.preprocess_scores(fx.bench_scores(spark, d)).where("modality = 'single-table'")


ONE_SQL = PRE_SQL + ", one AS (SELECT * FROM pp WHERE modality = 'single-table'), dat AS (SELECT * FROM one WHERE synthesizer <> 'Uniform')"
TOTAL_SQL = "(SELECT count(DISTINCT dataset) FROM dat)"


@query("leaderboard_summary", "RES15", f"""WITH {ONE_SQL} SELECT synthesizer, {TOTAL_SQL} AS total, count(normalized_score) AS solved, count(normalized_score) || ' / ' || {TOTAL_SQL} AS coverage,
round(count(normalized_score) / {TOTAL_SQL}, 6) AS coverage_perc, round(avg(normalized_score), 4) AS avg_score, round(avg(model_time)) AS time FROM dat GROUP BY 1""")
def _(spark, d):
    b = rs.leaderboard(one_modality(spark, d), ["Uniform"])
    return b.select("synthesizer", "total", "solved", "coverage", F.round("coverage_perc", 6).alias("coverage_perc"), F.round("avg_score", 4).alias("avg_score"), "time")


@query("leaderboard_places", "RES16", f"""WITH {ONE_SQL}, r AS (SELECT synthesizer, normalized_score, dense_rank() OVER (PARTITION BY dataset ORDER BY normalized_score DESC NULLS LAST) AS s,
dense_rank() OVER (PARTITION BY dataset ORDER BY model_time) AS t FROM dat WHERE synthesizer <> 'Identity')
SELECT synthesizer, count(*) FILTER (s = 1 AND normalized_score IS NOT NULL) AS best, count(*) FILTER (t = 1) AS best_time, count(*) FILTER (t = 2) AS second_best_time,
count(*) FILTER (t = 3) AS third_best_time FROM r GROUP BY 1 UNION ALL SELECT DISTINCT synthesizer, 0, 0, 0, 0 FROM dat WHERE synthesizer = 'Identity'""")
def _(spark, d):
    return rs.leaderboard(one_modality(spark, d), ["Uniform"]).select("synthesizer", "best", "best_time", "second_best_time", "third_best_time")


@query("leaderboard_beats_baseline", "RES17", f"""WITH {ONE_SQL} SELECT s.synthesizer, count(*) FILTER (b.dataset IS NOT NULL AND coalesce(s.normalized_score, '-inf'::DOUBLE) >= coalesce(b.normalized_score, '-inf'::DOUBLE)) AS beat_uniform
FROM dat s LEFT JOIN (SELECT * FROM one WHERE synthesizer = 'Uniform') b ON s.dataset = b.dataset GROUP BY 1""")
def _(spark, d):
    return rs.leaderboard(one_modality(spark, d), ["Uniform"]).select("synthesizer", "beat_uniform")


@query("leaderboard_error_counts", "RES18", f"""WITH {ONE_SQL} SELECT synthesizer, sum(timeout)::BIGINT AS timeout, sum(memory_error)::BIGINT AS memory_error, count(error) AS errors,
({TOTAL_SQL} - count(normalized_score) - count(error) - sum(timeout) - sum(memory_error))::BIGINT AS metric_errors FROM dat GROUP BY 1""")
def _(spark, d):
    return rs.leaderboard(one_modality(spark, d), ["Uniform"]).select("synthesizer", "timeout", "memory_error", "errors", "metric_errors")


@query("leaderboard_error_matrix", "RES18", f"""WITH {PRE_SQL} SELECT error, count(*) AS "all", count(*) FILTER (synthesizer = 'CTGAN') AS "CTGAN", count(*) FILTER (synthesizer = 'GaussianCopula') AS "GaussianCopula",
count(*) FILTER (synthesizer = 'Identity') AS "Identity", count(*) FILTER (synthesizer = 'Uniform') AS "Uniform" FROM pp WHERE error IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return rs.error_matrix(rs.preprocess_scores(fx.bench_scores(spark, d)), ["CTGAN", "GaussianCopula", "Identity", "Uniform"])


@query("leaderboard_libraries", "RES19", f"""WITH {PRE_SQL} SELECT DISTINCT synthesizer, CASE WHEN synthesizer IN ('CTGAN', 'GaussianCopula') THEN 'SDV' ELSE 'Other' END AS library FROM pp""")
def _(spark, d):
    return rs.preprocess_scores(fx.bench_scores(spark, d)).select("synthesizer", rs.library_of(F.col("synthesizer")).alias("library")).distinct()


@query("leaderboard_modality_report", "RES20", f"""WITH {ONE_SQL}, r AS (SELECT synthesizer, dense_rank() OVER (PARTITION BY dataset ORDER BY model_time) AS t FROM dat WHERE synthesizer <> 'Identity'),
w AS (SELECT synthesizer, count(*) FILTER (t = 1) AS wins, count(*) FILTER (t = 2) AS second, count(*) FILTER (t = 3) AS third FROM r GROUP BY 1)
SELECT synthesizer, wins, second, third, 'SDV' AS library, round((SELECT count(normalized_score) FROM dat x WHERE x.synthesizer = w.synthesizer) / {TOTAL_SQL}, 6) AS coverage FROM w""")
def _(spark, d):
    t = rs.modality_report(rs.preprocess_scores(fx.bench_scores(spark, d)), "single-table", ["Uniform"])
    return rnd(t["summary"], "coverage")
