"""Steps that many queries share: what they compute, and how often."""

import hashlib

import numpy as np
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tabloom.functions import digests, ordering
from tabloom.operators import encode, models, scoring, split
from tabloom.plans import fixtures, generation


def test_digests_of_texts_of_any_length():
    rng = np.random.default_rng(0)
    for size in (0, 1, 3, 4, 7, 20, 50, 51, 52, 53, 54, 70, 130):
        heads = [rng.integers(0, 256, size, np.uint8).tobytes() for _ in range(50)]
        for tail in (b"|1", b"|100"):
            want = [int(hashlib.md5(h + tail).hexdigest()[:13], 16) for h in heads]
            assert digests.leading_bits(heads, tail).tolist() == want


def test_summed_weights_are_those_of_the_rows(spark):
    rows = [(f"{i}" * (1 + i % 40) if i % 11 else None, None if i % 7 == 0 else i % 2, [0.25, 0.5, None, float("nan"), -0.0][i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, y int, p double").repartition(3)
    got = split.poisson_sums(df, "id", ["y", "p"], 12)
    want = split.poisson_weights(df, "id", 12).groupBy("replicate", "y", "p").agg(F.sum("w").alias("w")).where("w > 0")
    canon = lambda t: sorted(map(repr, t.withColumn("p", F.col("p") + 0.0).select("replicate", "y", "p", "w").collect()))
    assert canon(got) == canon(want) and got.dtypes == want.dtypes


def test_bootstrap_scores_hash_each_row_and_replicate_in_one_job(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(scoring, "materialise", lambda df: kept.append(df) or df)
    df = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 5 / 5).alias("p"))
    scoring.bootstrap_scores(df, "id", replicates=7).collect()
    assert len(kept) == 1
    assert "explode" not in kept[0]._jdf.queryExecution().toString()


def spied(monkeypatch, module):
    """Tables that a module writes, as (columns, rows)."""
    written, kept = [], module.materialise

    def spy(df):
        out = kept(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(module, "materialise", spy)
    return written


def test_quantiles_count_the_table_once(spark, monkeypatch):
    written = spied(monkeypatch, ordering)
    df = spark.range(900).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") % 30 / 3).cast("double").alias("v"))
    got = {r["g"]: r["q0"] for r in ordering.exact_quantiles(df, "v", [0.5], by=["g"]).collect()}
    assert got == {g: np.median([i % 30 // 3 for i in range(900) if i % 3 == g]) for g in range(3)}
    assert written == [(["g", "v", "n"], df.distinct().count())]
    weighed = df.groupBy("g", "v").agg(F.count("*").alias("k"))
    assert {r["g"]: r["q0"] for r in ordering.exact_quantiles(weighed, "v", [0.5], by=["g"], weight=F.col("k")).collect()} == got


def test_quantile_encoder_counts_levels_and_targets_once(spark, monkeypatch):
    written = spied(monkeypatch, encode)
    rows = [(i, "ab"[i % 2] if i % 7 else None, "x" if i % 3 else "y", float(i % 20) if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a string, b string, y double")
    spec = fixtures.REGRESSION.with_roles(categorical=("a", "b"), numeric=(), target="y")
    got = {(r["column"], r["value"]): r["e"] for r in encode.fit_quantile(df, spec).table.collect()}
    top = np.median([r[3] for r in rows if r[3] is not None])
    for c, column in ((1, "a"), (2, "b")):
        for level in {r[c] for r in rows} - {None}:
            mine = [r for r in rows if r[c] == level]
            want = (np.median([r[3] for r in mine if r[3] is not None]) * len(mine) + top) / (len(mine) + 1)
            assert abs(got[column, level] - want) < 1e-9
    assert written[0] == (["a", "b", "_y", "_w"], len({r[1:] for r in rows}))


def test_folds_are_plain_filters_with_the_scores_of_cross_validation(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 3 % 2).cast("int").alias("y"),
                                 (F.col("id") % 2).cast("int").alias("fold"))
    grid = {"maxDepth": [1, 3]}
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumn("_y", F.col("y").cast("double"))).select("features", "_y", "fold").persist()
    est = models.estimator("tree")
    maps = ParamGridBuilder().addGrid(est.maxDepth, grid["maxDepth"]).build()
    ev = MulticlassClassificationEvaluator(labelCol="_y", metricName="weightedFMeasure")
    want = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, foldCol="fold", numFolds=2, seed=1).fit(rows)
    rows.unpersist()
    monkeypatch.setattr(models, "CrossValidator", None)  # its folds pass a Python function
    got = models.fit_model(df, ["a", "b"], "y", "tree", grid=grid, fold="fold")
    assert np.allclose(got.metrics, want.avgMetrics) and got.fitted.depth == want.bestModel.depth


def test_summary_draws_a_synthetic_table_once(spark, monkeypatch):
    written = spied(monkeypatch, generation)
    out = generation.summary(spark.range(40).select((F.col("id") % 4).cast("string").alias("c"), F.col("id").alias("x")), ["c"], ["x"])
    assert written == [(["c", "x"], 40)] and out.count() == 5


def test_heads_under_many_endings():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 13, 15, 16, 50, 56, 70):
        heads = [b"0|boot|"[:size] + rng.integers(0, 256, max(size - 7, 0), np.uint8).tobytes() for _ in range(40)]
        prepared = digests.Heads(heads)
        for tail in (b"|1", b"|22", b"|100", b"", b"|1"):
            assert prepared.leading_bits(tail).tolist() == [int(hashlib.md5(h + tail).hexdigest()[:13], 16) for h in heads]


def test_rows_of_one_file_are_hashed_by_many_tasks(spark):
    df = spark.range(0, 4000, 1, 1).select("id", (F.col("id") % 2).cast("int").alias("y"))
    plan = split.poisson_sums(df, "id", ["y"], 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "hashpartitioning(id" in below and f", {ordering.range_count(spark)}), REPARTITION_BY_NUM" in below


def test_oversampling_splits_the_table_once(spark, monkeypatch):
    written = spied(monkeypatch, models)
    spec = fixtures.BINARY.with_roles(categorical=("a",), numeric=("v",), target="y")
    df = spark.range(120).select("id", F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("a"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).cast("int").alias("y"))
    out = models.oversampling(df, df.where("id < 60").withColumn("id", -F.col("id") - 1), spec, 0, 50)
    assert ({"id", "a", "v", "y", "part"}, 120) in [(set(c), n) for c, n in written]
    assert "Window" not in out._jdf.queryExecution().toString()  # the rows tested on are read, not split anew
    assert [r["training"] for r in out.select("training").collect()] == ["real_plus_minority", "synthetic_only"]


def test_steps_reached_by_heads_under_many_endings():
    rng = np.random.default_rng(2)
    for size in (0, 7, 15, 16, 17, 50, 54, 60):
        heads = [b"0|boot|"[:size] + rng.integers(0, 256, max(size - 7, 0), np.uint8).tobytes() for _ in range(40)]
        tails = [b"|9", b"|10", b"|99", b"|100"]
        want = [[int(hashlib.md5(h + t).hexdigest()[:13], 16) for h in heads] for t in tails]
        seen = sorted({want[i][j] + d for i, j, d in ((0, 3, -1), (1, 5, 0), (2, 7, 1), (3, 9, 0), (3, 11, 5))})  # the first 32 bits do not decide
        steps = np.array([0, *seen, 2**51, 2**52 - 1], np.uint64)
        steps.sort()
        assert digests.Heads(heads).reached(tails, steps).tolist() == [[sum(x >= int(s) for s in steps) for x in row] for row in want]


def test_a_key_of_many_rows_is_hashed_once(spark, monkeypatch, tmp_path):
    class Counted(digests.Heads):
        def __init__(self, heads, to=str(tmp_path / "hashed")):
            super().__init__(heads)
            with open(to, "a") as f:
                f.write(f"{len(heads)}\n")

    monkeypatch.setattr(split, "Heads", Counted)
    df = spark.range(0, 3000, 1, 5).select(F.when(F.col("id") % 1000 > 0, F.col("id") % 1000).alias("id"), (F.col("id") % 7).alias("y"))
    got = split.poisson_sums(df, "id", ["y"], 5).collect()
    assert sum(map(int, (tmp_path / "hashed").read_text().split())) == 1000
    want = split.poisson_weights(df, "id", 5).groupBy("replicate", "y").agg(F.sum("w").alias("w")).where("w > 0").collect()
    assert sorted(got) == sorted(want)
