"""Running column moments over arriving batches, exact or under continual release."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.clean import clip
from tabloom.operators.ledger import BudgetError, Ledger, spend
from tabloom.operators.private import merge_moments, moments
from tabloom.operators.private_models import generator

STATE = "column string, n long, mean double, m2 double, noise_n double, noise_s double, noise_q double"
#: Batches that a private stream may have, unless the caller says otherwise; noise grows with the logarithm.
HORIZON = 2**16
Bounds = Mapping[str, tuple[float, float]]


def blocks(t: int) -> list[int]:
    """Ends of the blocks that add up to the first t batches: one for each one-bit of t, the longest first."""
    out, end = [], 0
    for bit in reversed(range(t.bit_length())):
        if t >> bit & 1:
            end += 1 << bit
            out.append(end)
    return out


class BlockStore:
    """Folders `end-batch`: the block of batches that ends with batch number `end` and is as long as the lowest bit of `end`.

    A block is whole once Spark's success marker is there. At most 2 log2(t) + 2 folders are kept after t batches: those
    that add up to t, and those that add up to t - 1, from which a replayed batch starts again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self) -> dict[int, int]:
        """end -> batch of the whole blocks."""
        if not self.fs.exists(self.at(self.folder)):
            return {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(self.folder))]
        return {int(end): int(batch) for end, _, batch in (n.partition("-") for n in names) if self.fs.exists(self.at(f"{self.folder}/{end}-{batch}/_SUCCESS"))}

    def read(self, held: Mapping[int, int], ends: Sequence[int]) -> DataFrame:
        if not ends:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*[f"{self.folder}/{e}-{held[e]}" for e in ends])

    def write(self, rows: DataFrame, end: int, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{end}-{batch}")

    def prune(self, held: Mapping[int, int], t: int) -> None:
        for end in set(held) - {*blocks(t), *blocks(t - 1)}:
            self.fs.delete(self.at(f"{self.folder}/{end}-{held[end]}"), True)


def noise_scales(bounds: Bounds, epsilon: float, horizon: int) -> dict[str, tuple[float, float, float]]:
    """Laplace scales of count, sum and sum of squares (about the middle of the bounds) of one block, for each column.

    A row lies in one block of each length, so epsilon is shared by lengths, columns and the three numbers.
    """
    share = epsilon / (horizon.bit_length() * len(bounds) * 3)
    return {c: tuple(((hi - lo) / 2) ** power / share for power in (0, 1, 2)) for c, (lo, hi) in bounds.items()}


def run_moments(stream: DataFrame, cols: Sequence[str], state: str, checkpoint: str, *, bounds: Bounds | None = None, epsilon: float = math.inf, horizon: int = HORIZON,
                ledger: Ledger | None = None, seed=None) -> DataFrame:
    """Drain the stream and return (column, n, mean, m2) so far; a later call with the same folders goes on from there.

    Batches are leaves of a binary tree. A batch's state is merged with the blocks that it completes, so the state
    stays logarithmic in the number of batches. A replayed batch finds its block written and changes nothing.
    Nulls are not counted; without any batch the result is empty.

    With a finite epsilon (`bounds` needed; values are clipped to them) every block gets Laplace noise once, on the
    driver, and it is stored with it: releases after any batches are epsilon-private together, each with noise of at
    most log2(horizon) + 1 blocks. More than `horizon` batches are refused. `state` holds the exact numbers beside the
    noise, so it must stay as closed as the input. The ledger is charged when the state is new.
    """
    private = not math.isinf(epsilon)
    if private and set(cols) - set(bounds or {}):
        raise ValueError(f"bounds required for {sorted(set(cols) - set(bounds or {}))}")
    store = BlockStore(stream.sparkSession, state)
    if private and not store.listed():
        spend(ledger, epsilon)
    scales = noise_scales({c: bounds[c] for c in cols}, epsilon, horizon) if private else {}

    def save(batch: DataFrame, number: int):
        held = store.listed()
        t = max(held, default=0) + 1
        if number in held.values():
            return
        if private and t > horizon:
            raise BudgetError(f"the noise was made for {horizon} batches")
        values = batch.select(*[clip(F.col(c).cast("double"), *bounds[c]).alias(c) if private else F.col(c).cast("double").alias(c) for c in cols])
        part = blocks(t - 1)[len(blocks(t)) - 1:]  # blocks that end just before t and are completed by it
        rows = merge_moments(moments(values, cols).unionByName(store.read(held, part).select("column", "n", "mean", "m2")))
        got = {r["column"]: r for r in rows.collect()}  # one row a column
        rng = generator(None if seed is None else f"{seed}-{t}")
        made = []
        for c in cols:
            noise = [float(rng.laplace(0, s)) for s in scales[c]] if private else [0.0] * 3
            r = got.get(c)
            made.append((c, r["n"] if r else 0, r["mean"] if r else 0.0, r["m2"] if r else 0.0, *noise))
        store.write(stream.sparkSession.createDataFrame(made, STATE).coalesce(1), t, number)
        store.prune(store.listed(), t)

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return read_moments(stream.sparkSession, state, bounds if private else None)


def read_moments(spark: SparkSession, state: str, bounds: Bounds | None = None) -> DataFrame:
    """Moments of all batches so far; with `bounds` the released ones of a private stream.

    Released means lie in their bounds, counts are 1 or more and spreads are not negative.
    """
    store = BlockStore(spark, state)
    held = store.listed()
    rows = store.read(held, blocks(max(held, default=0)))
    if bounds is None:
        return merge_moments(rows.select("column", "n", "mean", "m2"))
    made = spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in bounds.items()], "column string, lo double, hi double")
    rows = rows.join(made, "column").withColumn("off", F.col("mean") - (F.col("lo") + F.col("hi")) / 2)
    n, off = F.col("n"), F.col("off")
    g = rows.groupBy("column", "lo", "hi").agg(F.sum(n + F.col("noise_n")).alias("n"), F.sum(n * off + F.col("noise_s")).alias("s"), F.sum(F.col("m2") + n * off * off + F.col("noise_q")).alias("q"))
    g = g.withColumn("n", F.greatest(F.round("n"), F.lit(1.0))).withColumn("s", F.col("s") / F.col("n"))
    m2 = F.col("q") - F.col("n") * F.col("s") * F.col("s")
    mean = F.greatest("lo", F.least("hi", (F.col("lo") + F.col("hi")) / 2 + F.col("s")))
    return g.select("column", F.col("n").cast("long").alias("n"), mean.alias("mean"), F.greatest(F.lit(0.0), m2).alias("m2"))


def error_bound(bounds: Bounds, epsilon: float, horizon: int, failure: float = 0.01) -> dict[str, tuple[float, float, float]]:
    """Error of a released count, sum and sum of squares that is passed with probability `failure` at most.

    A release adds k = log2(horizon) + 1 Laplace draws at most; their sum passes b sqrt(8 max(k, ln(2 / failure)) ln(2 / failure))
    with that probability or less.
    """
    k, tail = horizon.bit_length(), math.log(2 / failure)
    return {c: tuple(float(np.sqrt(8 * max(k, tail) * tail) * s) for s in scale) for c, scale in noise_scales(bounds, epsilon, horizon).items()}
