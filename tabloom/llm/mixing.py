"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.ordering import global_rank, running_totals
from tabloom.functions.rng import u01
from tabloom.llm.common import free_name, size_in_words, written


def targets(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """(source, size, weight) -> with `target`: share x all sizes, split by weight, none above max_epochs x size.

    Sources above their cap are clamped and what they leave is shared out again by weight among the others,
    until none is above. Each round is one aggregate to one row and clamps at least one source more.
    """
    capped = F.lit(False)
    sources = sources.withColumn("cap", F.lit(float(max_epochs)) * F.col("size"))
    budget = F.lit(float(share)) * F.sum("size")
    while True:
        free = F.when(~capped, F.col("weight"))
        r = sources.agg((budget - F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0))).alias("left"),
                        F.coalesce(F.sum(free), F.lit(0)).alias("weight"), F.count(F.when(capped, 1)).alias("n")).first()
        if not r["weight"]:
            return sources.withColumn("target", F.col("cap"))
        level = F.lit(float(r["left"])) * F.col("weight") / F.lit(float(r["weight"]))
        above = capped | (level > F.col("cap"))
        if sources.agg(F.count(F.when(above, 1))).first()[0] == r["n"]:
            return sources.withColumn("target", F.when(capped, F.col("cap")).otherwise(level))
        # A clamped source stays clamped: the level only rises. So the level alone names the clamped set.
        capped = level > F.col("cap")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = (5, 2, 1),
        share: float = 1.5, max_epochs: float = 2.0, seed: int = 6) -> DataFrame:
    """(id, text_hash, source, size, source_size, target, repeats) of every row.

    A source gets floor(target / size) whole passes. The rest of its target is filled by the documents that come
    first in a seeded order, until the middle of a document would pass it, so the taken words miss the target by
    half a document at most. Weights go to the sources in code point order, null last, and repeat.

    Null texts, ids and sources are values like any other (null text: size 0); rows of the same id, text and
    source share one decision. A source without words has target 0 and takes nothing. An empty table gives no
    rows. The seeded order is a keyed hash of the id, so reruns and recomputed tasks agree.
    """
    text = F.col(text_col).cast("string")
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"),
                               size_in_words(text).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size")).withColumn("last", F.col("source").isNull())
    sizes = global_rank(written(sizes), ["last", "source"], rank="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    planned = written(targets(written(sizes.select("source", "size", weight.alias("weight"))), share, max_epochs))
    planned = planned.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target")
    units = rows.groupBy("source", "id", "text_hash", "size").agg(F.count("*").alias("n")).withColumn("u", u01(seed, "mix", F.coalesce(F.col("id").cast("string"), F.lit(""))))
    units = running_totals(written(units), ["u", "id", "text_hash"], {"upto": F.col("n") * F.col("size")}, by=["source"], uniform=F.col("u"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (F.col("upto") - F.col("n") * F.col("size") / 2.0 <= rest) & (F.col("source_size") > 0) & (rest > 0)
    units = (units.join(planned, F.col("source").eqNullSafe(F.col("s"))).withColumn("whole", whole)
             .select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("text_hash").alias("h"), "source_size", "target",
                     (F.col("whole") + extra.cast("long")).cast("long").alias("repeats")))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))
    return rows.join(units, same).drop("s", "i", "h")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, epoch_col: str = "epoch", **how) -> DataFrame:
    """The mixed table itself: each document as often as it is taken, with the number of the pass."""
    plan = mix(docs, id_col, text_col, source_col, **how).select(F.col("id").alias("_i"), F.col("text_hash").alias("_h"), F.col("source").alias("_s"), F.col("repeats").alias("_r"))
    plan = plan.where(F.col("_r") > 0).distinct()
    mark = free_name(docs, "text_hash")
    tagged = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    on = tagged[id_col].eqNullSafe(plan["_i"]) & (tagged[mark] == plan["_h"]) & tagged[source_col].cast("string").eqNullSafe(plan["_s"])
    return tagged.join(plan, on).select(*[tagged[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), plan["_r"].cast("int"))).alias(epoch_col))
