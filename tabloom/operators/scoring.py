"""Scores of predictions against labels, from counts of distinct (label, prediction) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.ordering import running_totals
from tabloom.functions.tables import materialise
from tabloom.operators.split import poisson_sums


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Per class: tp, support, predicted, over all classes seen on either side."""
    pairs = df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    side = F.array(F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                            F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
                   F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    return (pairs.select(*by, F.explode(side).alias("x")).select(*by, "x.*").groupBy(*by, "cls")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_scores(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    c = confusion(df, label, pred, by)
    return c.select(*by, "cls", "tp", "support", "predicted", _ratio(F.col("tp"), F.col("support")).alias("recall"),
                    _ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def label_scores(df: DataFrame, label: str = "label", pred: str = "pred", positive=None, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, bacc, gmean, f1_macro, f1_weighted and, for a positive class, f1 and the area
    under the one-threshold curve (mean of the two rates). A ratio over zero is 0."""
    c = class_scores(df, label, pred, by)
    true = F.col("support") > 0
    aggs = [
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(true, F.col("recall"))).alias("bacc"),
        F.coalesce(F.exp(F.avg(F.when(true & (F.col("recall") > 0), F.log("recall")).when(true, F.lit(float("-inf"))))), F.lit(0.0)).alias("gmean"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    ]
    if positive is not None:
        is_pos = F.col("cls") == positive
        tpr = F.sum(F.when(is_pos, F.col("recall")).otherwise(0.0))
        tnr = _ratio(F.sum(F.when(~is_pos, F.col("tp")).otherwise(0)), F.sum(F.when(~is_pos, F.col("support")).otherwise(0)))
        aggs += [F.sum(F.when(is_pos, F.col("f1")).otherwise(0.0)).alias("f1"), ((tpr + tnr) / 2).alias("hard_auc")]
    return c.groupBy(*by).agg(*aggs)


def _curve(df: DataFrame, label: str, score: str, by: Sequence[str], weight: Column | None) -> DataFrame:
    """Distinct scores from high to low with running counts of positives and rows."""
    w = weight if weight is not None else F.lit(1)
    v = df.groupBy(*by, (-F.col(score)).alias("neg")).agg(
        F.sum(w * F.col(label)).cast("double").alias("pos"), F.sum(w).cast("double").alias("rows"))
    return running_totals(v, ["neg"], {"cp": F.col("pos"), "cn": F.col("rows")}, by=by, totals={"cp": "tp", "cn": "tn"})


def score_metrics(df: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """auc (ties count half), average precision and squared error of scores for a 0/1 label."""
    c = _curve(df, label, score, by, weight)
    pos, neg, p = F.col("pos"), F.col("rows") - F.col("pos"), -F.col("neg")
    # negatives with a lower score, plus half of the tied ones
    below = (F.col("tn") - F.col("tp")) - (F.col("cn") - F.col("cp")) + neg / 2
    auc = F.sum(pos * below) / (F.max("tp") * (F.max("tn") - F.max("tp")))
    aps = F.sum(pos * F.col("cp") / F.col("cn")) / F.max("tp")
    brier = F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / F.max("tn")
    return c.groupBy(*by).agg(auc.alias("auc"), aps.alias("aps"), brier.alias("brier"))


def regression_scores(df: DataFrame, label: str = "y", pred: str = "p", by: Sequence[str] = ()) -> DataFrame:
    e = F.col(label) - F.col(pred)
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"),
                               (1 - F.sum(e * e) / (F.var_pop(label) * F.count(label))).alias("r2"))


def weighted_one_vs_rest_auc(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """Area per class against the rest, weighted by class size. scores: class -> score column."""
    arms = F.array(*[F.struct(F.lit(c).alias("cls"), (F.col(label) == c).cast("int").alias("y"), F.col(s).alias("p")) for c, s in scores.items()])
    long = df.select(F.explode(arms).alias("x")).select("x.*")
    auc = score_metrics(long, by=["cls"])
    size = long.groupBy("cls").agg(F.sum("y").alias("n"))
    return auc.join(size, "cls").agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("auc_ovr_weighted"))


def threshold(df: DataFrame, score: str = "p", at: float = 0.5) -> DataFrame:
    return df.withColumn("pred", (F.col(score) > at).cast("int"))


def bootstrap_scores(df: DataFrame, key: str, label: str = "y", score: str = "p", replicates: int = 100, seed=0) -> DataFrame:
    """Mean auc, aps, brier and accuracy over resampled tables. Rows collapse to distinct
    (replicate, score, label) weights before anything is ordered; these are written once, so that each hash is
    worked out once."""
    w = materialise(poisson_sums(df, key, [label, score], replicates, seed))
    m = score_metrics(w, label, score, by=["replicate"], weight=F.col("w"))
    hit = F.when((F.col(score) > 0.5).cast("int") == F.col(label), F.col("w")).otherwise(0)
    acc = w.groupBy("replicate").agg((F.sum(hit) / F.sum("w")).alias("acc"))
    return m.join(acc, "replicate").agg(*[F.avg(c).alias(c) for c in ("auc", "aps", "brier", "acc")])


def imbalance(df: DataFrame, label: str = "y") -> DataFrame:
    return df.agg(F.avg(label).alias("positive_rate"))
