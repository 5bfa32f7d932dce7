"""Tail probabilities as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t with whole degrees of freedom, by the finite
    trigonometric series of its distribution function."""
    theta = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    c2 = F.cos(theta) * F.cos(theta)
    odd = dof % 2 == 1
    steps = F.when(odd, F.floor((dof - 3) / 2)).otherwise(F.floor((dof - 2) / 2))
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))

    def add(acc, i):
        ratio = F.when(odd, (2.0 * i) / (2.0 * i + 1.0)).otherwise((2.0 * i - 1.0) / (2.0 * i))
        term = acc["term"] * ratio * c2
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    start = F.struct(first.alias("sum"), first.alias("term"))
    series = F.when(steps >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, add)["sum"]).otherwise(first)
    inside = (F.when(odd & (dof == 1), theta * 2 / math.pi)
              .when(odd, (theta + F.sin(theta) * series) * 2 / math.pi)
              .otherwise(F.sin(theta) * series))
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), 1.0 - inside))


def _chi2_upper(x: float, dof: int) -> float:
    if not x > 0:
        return 1.0
    half = x / 2
    if dof % 2 == 0:
        term, total = math.exp(-half), math.exp(-half)
        for i in range(1, dof // 2):
            term *= half / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (dof - 1) // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square law; runs on one row per tested column."""
    return pd.Series([_chi2_upper(s, int(d)) if d > 0 else 1.0 for s, d in zip(stat, dof)])
