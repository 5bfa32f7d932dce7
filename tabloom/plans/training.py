"""Model, pipeline and model-based metric queries."""

import math

from pyspark.sql import functions as F

from tabloom.functions.tables import materialise
from tabloom.operators import augment as au
from tabloom.operators import generate as ge
from tabloom.operators import models as mo
from tabloom.operators import private_models as pm
from tabloom.operators import split
from tabloom.operators.self_label import fit_self_labelled
from tabloom.plans import fixtures as fx
from tabloom.plans.fidelity import rnd
from tabloom.plans.registry import query

U = fx.u_sql


def halves(spark, d, spec_df):
    s = materialise(split.shuffle_split(materialise(spec_df), "id", 0.2, seed=4))
    return s.where("part = 'train'").drop("part"), s.where("part = 'test'").drop("part")


def per_class(df, spec, n, seed):
    return ge.per_class(df, spec, n, seed=seed)


def copula(df, spec, n, seed):
    """Regression-style copula draw with the target as one more column."""
    m = ge.fit_copula(df, spec, knots=50)
    return m.sample(df.sparkSession, n, seed)


def scores(df, *extra):
    return rnd(df, *[c for c, t in df.dtypes if t == "double"], places=4)


@query("train_teacher_boosted", "MOD1")
def _(spark, d):
    train, test = halves(spark, d, fx.mixed_binary(spark, d))
    prep, m = mo.tuned(train, fx.BINARY, "gbt", {"maxDepth": [2, 3]}, folds=2, maxIter=2)
    return scores(mo.evaluate(prep.transform(test), fx.BINARY, m))


@query("train_teacher_boosted_regression", "MOD1")
def _(spark, d):
    train, test = halves(spark, d, fx.mixed_regression(spark, d))
    prep, m = mo.tuned(train, fx.REGRESSION, "gbt_reg", mo.BOOSTING_GRID, folds=5)
    return scores(mo.evaluate(prep.transform(test), fx.REGRESSION, m))


@query("train_teacher_forest", "MOD2")
def _(spark, d):
    train, test = halves(spark, d, fx.mixed(spark, d))
    prep, m = mo.tuned(train, fx.MIXED, "forest", mo.FOREST_GRID, folds=2)
    return scores(mo.evaluate(prep.transform(test), fx.MIXED, m))


@query("train_student_tree", "MOD3")
def _(spark, d):
    train, test = halves(spark, d, fx.mixed(spark, d))
    prep, m = mo.tuned(train, fx.MIXED, "tree", {"maxDepth": [3, 6], "impurity": ["gini", "entropy"]}, folds=2)
    return scores(mo.evaluate(prep.transform(test), fx.MIXED, m))


@query("train_preprocess", "MOD4", f"""WITH {fx.NULLS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY {U(4, 'split', 'id')}, id) AS r, count(*) OVER () AS n FROM nul),
s AS (SELECT *, r > ceil(n * 0.2::DOUBLE) AS train FROM r), md AS (SELECT segment AS m FROM s WHERE train AND segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
bm AS (SELECT balance AS m FROM s WHERE train AND balance IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT id, train, coalesce(segment, md.m) AS segment, coalesce(balance, bm.m) AS balance FROM s, md, bm),
co AS (SELECT segment, row_number() OVER (ORDER BY min(id)) AS code FROM f WHERE train GROUP BY 1), lim AS (SELECT min(balance) AS a, max(balance) AS b FROM f WHERE train)
SELECT id, code AS segment, round((balance - a) / (b - a), 6) AS balance FROM f JOIN co USING (segment), lim""")
def _(spark, d):
    spec = fx.MIXED.with_roles(categorical=("segment",), numeric=("balance",), target="status")
    s = split.shuffle_split(fx.mixed_nulls(spark, d), "id", 0.2, seed=4)
    p = mo.Preprocessor(spec, encoder="ordinal", scaler="min_max").fit(s.where("part = 'train'"))
    return rnd(p.transform(s).select("id", "segment", "balance"), "balance")


@query("train_pipeline_steps", "MOD5", f"""WITH {fx.MIXED_SQL}, m AS (SELECT avg(price) AS m FROM mixed WHERE status = 'F'),
a AS (SELECT *, 'train' AS part FROM mixed WHERE status = 'F' UNION ALL SELECT *, 'new' FROM mixed WHERE status <> 'F')
SELECT part, id, status, round(price - m, 2) AS price FROM a, m UNION ALL SELECT 'train', -id - 1, status, round(price - m, 2) FROM mixed, m WHERE status = 'F'""")
def _(spark, d):
    m = fx.mixed(spark, d).select("id", "status", "price")

    def center(df):
        mean = df.agg(F.avg("price")).first()[0]
        return lambda t: t.withColumn("price", F.col("price") - mean)

    def double(df):
        return lambda t: t.unionByName(t.withColumn("id", -F.col("id") - 1))

    p = mo.Steps([("center", center, False), ("double", double, True)])
    train = p.fit_transform(m.where("status = 'F'")).withColumn("part", F.lit("train"))
    new = p.transform(m.where("status <> 'F'")).withColumn("part", F.lit("new"))
    return train.unionByName(new).select("part", "id", "status", F.round("price", 2).alias("price"))


@query("train_augmented", "MOD6")
def _(spark, d):
    train, test = halves(spark, d, fx.mixed(spark, d))
    return scores(mo.score_student(mo.augmented(train, fx.MIXED, per_class, train.count()), test, fx.MIXED))


@query("train_label_variants", "MOD7")
def _(spark, d):
    train, test = halves(spark, d, fx.mixed_binary(spark, d))
    teacher = mo.tuned(train, fx.BINARY, "forest", {"numTrees": [10]}, folds=2)
    return scores(mo.variants(train, test, fx.BINARY, per_class, train.count(), teacher))


@query("train_generator_tuning", "MOD8")
def _(spark, d):
    m = materialise(fx.mixed(spark, d))
    return scores(mo.tune_generator(m, fx.MIXED, [("per_class", per_class), ("copula", copula)], m.count()))


@query("experiment_result_rows", "MOD9")
def _(spark, d):
    m = materialise(fx.mixed(spark, d))
    total = m.count()
    n = total - math.ceil(total * 0.2)  # a fifth of the rows tests, all others train
    return scores(mo.experiment(m, fx.MIXED, per_class, generator="per_class", sizes=(n, 2 * n), train_size=n, max_test=None))


@query("train_synthetic_only", "MOD10")
def _(spark, d):
    train, test = halves(spark, d, fx.mixed(spark, d))
    return scores(mo.synthetic_only(train, test, fx.MIXED, copula, train.count()))


@query("train_joint_one_hot", "MOD11")
def _(spark, d):
    m = fx.mixed(spark, d)
    train, test = halves(spark, d, m)
    return scores(mo.joint_one_hot(mo.keyed(per_class(train, fx.MIXED, train.count(), 0), fx.MIXED, train), test, fx.MIXED, depth=10))


@query("train_oversampling", "MOD12")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    n = m.count()
    synth = mo.keyed(per_class(m, fx.BINARY, n, 0), fx.BINARY, m)
    return scores(mo.oversampling(m, synth, fx.BINARY, 0, n // 2))


@query("train_model_list", "MOD13")
def _(spark, d):
    train, test = halves(spark, d, fx.mixed_binary(spark, d))
    return scores(mo.score_models(train, test, fx.BINARY, ["logit", "tree", "forest"]))


@query("fidelity_dimension_prediction", "FID8")
def _(spark, d):
    return scores(mo.dimension_prediction(*fx.real_and_synthetic(spark, d), fx.MIXED))


@query("fidelity_preset_binary", "FID12")
def _(spark, d):
    train, test = halves(spark, d, fx.mixed_binary(spark, d))
    return scores(mo.run_problem_preset(test, train, fx.BINARY, "binary_classification"))


@query("fidelity_preset_likelihood", "FID12 FID10")
def _(spark, d):
    return scores(mo.run_problem_preset(*fx.real_and_synthetic(spark, d), fx.MIXED, "gaussian_likelihood"))


@query("fidelity_detection", "FID9")
def _(spark, d):
    return scores(mo.detection(*fx.real_and_synthetic(spark, d), fx.MIXED))


@query("fidelity_mixture_likelihood", "FID10")
def _(spark, d):
    return scores(mo.mixture_likelihood(*fx.real_and_synthetic(spark, d), list(fx.NUMS), k=10))


@query("fidelity_utility_difference", "FID11")
def _(spark, d):
    return scores(mo.utility_difference(*fx.real_and_synthetic(spark, d), fx.MIXED))


@query("fidelity_parent_child_detection", "FID13")
def _(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice").alias("price"))
    fake = au.fill_foreign_keys(o.drop("o_custkey"), c, "c_custkey", "id", "o_custkey")
    spec = fx.MIXED.with_roles(categorical=("segment",), numeric=("balance", "price"), target=None)
    return scores(mo.parent_child_detection((c, o), (c, fake), ("c_custkey", "o_custkey"), spec))


@query("augment_relabel", "AUG4")
def _(spark, d):
    m = fx.mixed_binary(spark, d)
    teacher = mo.fit_student(m, fx.BINARY)
    t = mo.augmented(m, fx.BINARY, per_class, m.count(), labels="teacher", teacher=teacher)
    return t.groupBy((F.col("id") < 0).alias("synthetic"), "y").agg(F.count("*").alias("n"))


@query("augment_self_labelled", "AUG9")
def _(spark, d):
    m = fx.mixed(spark, d)
    model = fit_self_labelled(m, fx.MIXED, {"price": (0.0, 6e5), "balance": (-1e3, 1e4)}, 3.0, seed=1)
    return model.sample(m.count()).groupBy("status").agg(F.count("*").alias("n"))
