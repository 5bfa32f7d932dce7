"""Bounded samples of labelled rows: which of them, not what they hold, is decided by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.rng import u01


def labelled(docs: DataFrame, labels: DataFrame, label: str, value: int | None, most: int, *, id_col: str, train: Column, seed: int) -> tuple[DataFrame, int]:
    """Up to `most` training rows (id, text) whose label is `value`, or of any documents if value is None, and how many there are.

    The share is most / count by a keyed hash of the id; rows with a null id or label are left out. Only ids
    travel to the join, at most `most` of them.
    """
    pool = docs.select(F.col(id_col).alias("id")) if value is None else labels.where(F.col(label) == value).select(F.col(id_col).alias("id"))
    pool = pool.where(train & F.col("id").isNotNull())
    n = pool.count()
    picked = pool.where(u01(seed, "sample", "id") < most / max(1, n)).distinct().orderBy(F.xxhash64("id"), "id").limit(most).withColumnRenamed("id", "_picked")
    rows = docs.join(F.broadcast(picked), docs[id_col] == F.col("_picked"))  # at most `most` ids
    return rows.select(F.col("_picked").alias("id"), *[docs[c] for c in docs.columns if c != id_col]), n
