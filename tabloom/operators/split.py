"""Exact-size splits, folds and resamples.

Orders come from a keyed hash of the row (shuffled) or from the row key (by position).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.digests import Heads
from tabloom.functions.ordering import global_rank, range_count
from tabloom.functions.rng import digest_text, least_above, u01


def ranked(df: DataFrame, key: str, seed=None, *, salt: str = "split", by: Sequence[str] = (), shuffle: bool = True) -> DataFrame:
    """Add `_rank` (1-based) and `_n`, shuffled by the row hash or in key order."""
    if not shuffle:
        return global_rank(df, [key], by=by, rank="_rank", total="_n")
    df = df.withColumn("_u", u01(seed, salt, key))
    return global_rank(df, ["_u", key], by=by, rank="_rank", total="_n", uniform=F.col("_u")).drop("_u")


def train_test(df: DataFrame, key: str, train_size: int, max_test: int | None = None, seed=0) -> DataFrame:
    """`part` = train for exactly train_size rows, test for up to max_test of the rest."""
    r = ranked(df, key, seed)
    limit = F.lit(train_size + max_test) if max_test is not None else F.col("_n")
    part = F.when(F.col("_rank") <= train_size, "train").when(F.col("_rank") <= limit, "test")
    return r.withColumn("part", part).where("part is not null").drop("_rank", "_n")


def shuffle_split(df: DataFrame, key: str, test_share: float = 0.2, seed=0) -> DataFrame:
    """One shuffled split; the test part is rounded up."""
    r = ranked(df, key, seed)
    return r.withColumn("part", F.when(F.col("_rank") <= F.ceil(F.col("_n") * test_share), "test").otherwise("train")).drop("_rank", "_n")


def class_quotas(df: DataFrame, target: str, total: Column | int) -> DataFrame:
    """(target, n, quota): `total` rows shared over the classes in proportion, by largest remainder."""
    c = df.groupBy(target).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per class
    exact = F.col("n") * F.col("_t") / F.sum("n").over(w)
    c = c.withColumn("_t", total if isinstance(total, Column) else F.lit(total)).withColumn("_x", exact)
    c = c.withColumn("_short", F.col("_t") - F.sum(F.floor("_x")).over(w))
    order = Window.partitionBy(F.lit(0)).orderBy((F.floor("_x") - F.col("_x")).asc(), target)
    return c.withColumn("_o", F.row_number().over(order)).select(
        target, "n", (F.floor("_x") + (F.col("_o") <= F.col("_short")).cast("int")).cast("long").alias("quota"))


def stratified_split(df: DataFrame, key: str, target: str, train_size: int, seed=0) -> DataFrame:
    """Split of exact size with class shares kept."""
    q = class_quotas(df, target, train_size).select(target, "quota")
    r = ranked(df, key, seed, by=[target])
    return (r.join(q, target)
            .withColumn("part", F.when(F.col("_rank") <= F.col("quota"), "train").otherwise("test")).drop("_rank", "_n", "quota"))


def block(rank: Column, n: Column, k: int) -> Column:
    """0-based number of the contiguous block of `rank` when n rows are cut into k blocks
    whose sizes differ by at most one, larger blocks first."""
    small, extra = F.floor(n / k), n % k
    edge = extra * (small + 1)
    r = rank - 1
    return F.when(r < edge, F.floor(r / (small + 1))).otherwise(extra + F.floor((r - edge) / F.greatest(small, F.lit(1)))).cast("int")


def k_folds(df: DataFrame, key: str, k: int, *, shuffle: bool = False, seed=0) -> DataFrame:
    """Column `fold` in 0..k-1."""
    r = ranked(df, key, seed, salt="fold", shuffle=shuffle)
    return r.withColumn("fold", block(F.col("_rank"), F.col("_n"), k)).drop("_rank", "_n")


def stratified_k_folds(df: DataFrame, key: str, target: str, k: int, *, shuffle: bool = False, seed=0) -> DataFrame:
    """Folds with class shares kept: fold i of the label-sorted table (classes in order of
    appearance) owns positions i, i + k, i + 2k, ...; each class fills its folds in blocks."""
    c = df.groupBy(target).agg(F.count("*").alias("_c"), F.min(key).alias("_first"))
    w = Window.partitionBy(F.lit(0)).orderBy("_first")  # one row per class
    c = c.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    # every fold owns floor(_c / k) rows of the class; the others go to the folds from _start % k on, past the last one to the first
    first, more = F.col("_start") % k, F.col("_c") % k
    over = first + more > k
    c = c.select(target, F.floor(F.col("_c") / k).alias("_few"), over.alias("_over"), F.when(over, first + more - k).otherwise(first).alias("_e1"),
                 F.when(over, first).otherwise(first + more).alias("_e2"))
    r = ranked(df, key, seed, salt="fold", by=[target], shuffle=shuffle)
    few, x, e1, e2 = F.col("_few"), F.col("_rank") - 1, F.col("_e1"), F.col("_e2")
    outer, inner = few + F.col("_over").cast("int"), few + (~F.col("_over")).cast("int")  # rows of a fold outside and inside [_e1, _e2)
    t1, t2 = e1 * outer, e1 * outer + (e2 - e1) * inner
    at = lambda y, size: F.floor(y / F.greatest(size, F.lit(1)))
    fold = F.when(x < t1, at(x, outer)).when(x < t2, e1 + at(x - t1, inner)).otherwise(e2 + at(x - t2, outer)).cast("int")
    return r.join(c, target).withColumn("fold", fold).drop("_rank", "_n", "_few", "_over", "_e1", "_e2")


def equal_chunks(df: DataFrame, key: str, chunk: int, target: str | None = None) -> DataFrame:
    """Cut the table, in key order, into floor(n / chunk) folds of exactly `chunk` rows; the rest goes.
    With a target of classes the rows that stay are dealt to the folds with class shares kept."""
    r = ranked(df, key, shuffle=False)
    if target is not None:
        folds = df.count() // chunk
        head = r.where(F.col("_rank") <= folds * chunk).drop("_rank", "_n")
        return stratified_k_folds(head, key, target, folds) if folds else head.withColumn("fold", F.lit(0))
    return (r.where(F.col("_rank") <= F.floor(F.col("_n") / chunk) * chunk)
            .withColumn("fold", F.floor((F.col("_rank") - 1) / chunk).cast("int")).drop("_rank", "_n"))


def partitions(df: DataFrame, key: str, m: int) -> DataFrame:
    """m contiguous blocks in key order, column `part` in 0..m-1."""
    r = ranked(df, key, shuffle=False)
    return r.withColumn("part", block(F.col("_rank"), F.col("_n"), m)).drop("_rank", "_n")


def sample_share(df: DataFrame, key: str, share: float, seed=0) -> DataFrame:
    """Exactly floor(n * share) rows."""
    r = ranked(df, key, seed, salt="sample")
    return r.where(F.col("_rank") <= F.floor(F.col("_n") * share)).drop("_rank", "_n")


def prefixes(df: DataFrame, key: str, sizes: Sequence[int], seed=0) -> DataFrame:
    """One shuffled sample read at several sizes: column `n_samples`, rows 1..n of the same order.

    Each row repeats once per size that contains it, so the work is bounded by the list.
    """
    r = ranked(df, key, seed, salt="prefix")
    wanted = F.filter(F.array(*[F.lit(int(s)) for s in sizes]), lambda s: s >= F.col("_rank"))
    return r.withColumn("n_samples", F.explode(wanted)).drop("_rank", "_n")


def _poisson_steps(top: int = 9) -> list[float]:
    """Distribution function of the Poisson law with mean 1."""
    term, total, steps = math.exp(-1.0), 0.0, []
    for i in range(top):
        total += term
        steps.append(total)
        term /= i + 1
    return steps


def poisson_weights(df: DataFrame, key: str, replicates: int = 100, seed=0) -> DataFrame:
    """One row per (row, replicate) with its Poisson(1) resampling weight `w`, zero included. Rows are dealt evenly to
    tasks, since each stands for many hashes. Tasks hash whole batches of keys and add all weights of a row to it as one
    array, which is taken apart afterwards."""
    steps = np.array([least_above(s) for s in _poisson_steps()], np.uint64)
    tails = [b"|%d" % r for r in range(1, replicates + 1)]

    def weigh(batches):
        for batch in batches:
            head = batch.column("_head")
            heads, sizes = head.to_pylist(), pc.binary_length(head).to_numpy()
            weights = np.zeros((batch.num_rows, replicates), np.int8)
            for at in (np.flatnonzero(sizes == size) for size in np.unique(sizes)):
                for some in np.array_split(at, -(-len(at) // PIECE)):
                    texts, several = Heads([heads[i] for i in some]), max(1, AT_ONCE // len(some))
                    for first in range(0, replicates, several):
                        weights[some, first : first + several] = texts.reached(tails[first : first + several], steps).T
            each = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * replicates, pa.int32()), pa.array(weights.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], each], names=[*batch.schema.names[:-1], "_weights"])

    out = df.repartition(range_count(df.sparkSession)).withColumn("_head", digest_text(seed, "boot", key).cast("binary"))
    out = out.mapInArrow(weigh, T.StructType([*df.schema.fields, T.StructField("_weights", T.ArrayType(T.ByteType(), False), False)]))
    out = out.select(*df.columns, F.posexplode("_weights").alias("replicate", "w"))
    return out.withColumns({"replicate": F.col("replicate") + 1, "w": F.col("w").cast("int")})


PIECE, AT_ONCE = 8_000, 32_000  # texts and hashes at once: their arrays stay in a core's cache


def poisson_sums(df: DataFrame, key: str, by: Sequence[str], replicates: int = 100, seed=0) -> DataFrame:
    """(replicate, by..., w): summed weights of `poisson_weights`, without those of zero. Rows are dealt to tasks by their
    key, since each stands for many hashes and the files may come in few large pieces, and put in its order, so that a key
    of many rows is hashed once. Tasks hash whole batches of rows and add up the weights of equal `by` values, so a table
    is not written out once for each replicate."""
    steps = np.array([least_above(s) for s in _poisson_steps()], np.uint64)
    by = list(by)

    def batch_sums(batches):
        for several in batched(batches, 16):  # larger arrays, fewer calls
            batch = pa.Table.from_batches(several).combine_chunks()
            if not batch.num_rows:
                continue
            batch = batch.to_batches()[0]
            code = np.zeros(batch.num_rows, np.int64)
            for c in by:
                coded = batch.column(c).dictionary_encode(null_encoding="encode")
                code = code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            _, first, group = np.unique(code, return_index=True, return_inverse=True)
            coded = batch.column("_head").dictionary_encode()
            heads, text = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            sizes = np.array([len(h) for h in heads])
            pieces = [p for size in np.unique(sizes) for at in [np.flatnonzero(sizes == size)] for p in np.array_split(at, -(-len(at) // PIECE))]
            piece, place = np.empty((2, len(heads)), np.int64)  # of each text: its piece and its place there
            for i, texts in enumerate(pieces):
                piece[texts], place[texts] = i, np.arange(len(texts))
            rows = np.lexsort((group, piece[text]))  # rows of a group together in each piece
            parts = []
            for texts, of in zip(pieces, np.split(rows, np.cumsum(np.bincount(piece[text]))[:-1]), strict=True):
                starts = np.flatnonzero(np.diff(group[of], prepend=-1))
                parts.append((Heads([heads[i] for i in texts]), place[text[of]], starts, group[of][starts]))
            several = max(min(AT_ONCE // max(map(len, pieces)), 20 * AT_ONCE // batch.num_rows), 1)
            for numbers in batched(range(1, replicates + 1), several):  # not all: there may be as many groups as rows
                sums = np.zeros((len(numbers), len(first)), np.int64)
                tails = [b"|%d" % r for r in numbers]
                for texts, of, starts, groups in parts:
                    weights = np.take(texts.reached(tails, steps), of, axis=1)
                    sums[:, groups] += np.add.reduceat(weights, starts, axis=1, dtype=np.int64)
                r, g = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(r + numbers[0], pa.int32()), *[batch.column(c).take(pa.array(first[g])) for c in by], pa.array(sums[r, g])], names=["replicate", *by, "w"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    rows = df.select(*dict.fromkeys([key, *by])).repartition(range_count(df.sparkSession), key).sortWithinPartitions(key).select(digest_text(seed, "boot", key).cast("binary").alias("_head"), *by)
    return rows.mapInArrow(batch_sums, f"replicate int, {kinds}, w long").groupBy("replicate", *by).agg(F.sum("w").alias("w"))


def bootstrap_weights(df: DataFrame, key: str, replicates: int = 100, seed=0) -> DataFrame:
    """One row per (row, replicate) with a positive Poisson(1) resampling weight `w`."""
    return poisson_weights(df, key, replicates, seed).where(F.col("w") > 0)
