"""Privacy budget: what has been spent, and what is left."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BudgetError(ValueError):
    """The spend would exceed the budget."""


def composed(eps_sum: float, eps_exp: float, eps_sq: float, slack: float) -> float:
    """Least of the plain sum and the two advanced composition bounds."""
    if slack <= 0:
        return eps_sum
    return min(eps_sum, eps_exp + math.sqrt(2 * eps_sq * math.log(1 / slack)),
               eps_exp + math.sqrt(2 * eps_sq * math.log(math.e + math.sqrt(eps_sq) / slack)))


def composition(spends: DataFrame, slack: float = 0.0, epsilon: str = "epsilon", delta: str = "delta") -> DataFrame:
    """One row (epsilon, delta): composed cost of a table of spends, by one aggregate."""
    e, d = F.col(epsilon), F.col(delta)
    row = spends.agg(F.sum(e).alias("s"), F.sum((1 - F.exp(-e)) * e / (1 + F.exp(-e))).alias("x"), F.sum(e * e).alias("q"),
                     F.sum(F.log1p(-d)).alias("l"))
    best = F.col("s")
    if slack > 0:
        best = F.least(best, F.col("x") + F.sqrt(2 * F.col("q") * math.log(1 / slack)),
                       F.col("x") + F.sqrt(2 * F.col("q") * F.log(math.e + F.sqrt("q") / slack)))
    return row.select(best.alias("epsilon"), (1 - (1 - slack) * F.exp("l")).alias("delta"))


class Ledger:
    """Spends of (epsilon, delta) under one budget. Groups of disjoint rows share one spend."""

    def __init__(self, epsilon: float = math.inf, delta: float = 1.0, slack: float = 0.0):
        if epsilon <= 0 and delta <= 0:
            raise ValueError("empty budget")
        if not 0 <= slack <= delta:
            raise ValueError("slack must lie in [0, delta]")
        self.epsilon, self.delta, self.slack = epsilon, delta, slack
        self.spent: list[tuple[float, float]] = []

    def total(self, extra: tuple[tuple[float, float], ...] = ()) -> tuple[float, float]:
        rows = [*self.spent, *extra]
        s = sum(e for e, _ in rows)
        x = sum((1 - math.exp(-e)) * e / (1 + math.exp(-e)) for e, _ in rows) if not math.isinf(s) else s
        keep = 1 - self.slack
        for _, d in rows:
            keep *= 1 - d
        return composed(s, x, sum(e * e for e, _ in rows), self.slack), 1 - keep

    def check(self, epsilon: float, delta: float = 0.0) -> None:
        if epsilon < 0 or not 0 <= delta <= 1:
            raise ValueError("bad spend")
        e, d = self.total(((epsilon, delta),))
        if (e > self.epsilon * (1 + 1e-12) and not math.isinf(self.epsilon)) or d > self.delta + 1e-15:
            raise BudgetError(f"({epsilon}, {delta}) exceeds what is left: {self.remaining()}")

    def spend(self, epsilon: float, delta: float = 0.0) -> "Ledger":
        self.check(epsilon, delta)
        self.spent.append((epsilon, delta))
        return self

    def remaining(self, uses: int = 1) -> tuple[float, float]:
        """Largest equal spend that can still be made `uses` times."""
        _, d0 = self.total()
        delta = max(0.0, 1 - ((1 - self.delta) / (1 - d0)) ** (1 / uses)) if d0 < 1 else 0.0
        if math.isinf(self.epsilon):
            return math.inf, delta
        lo, hi = 0.0, self.epsilon
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self.total(((mid, 0.0),) * uses)[0] <= self.epsilon else (lo, mid)
        return lo, delta

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.spent, "epsilon double, delta double")


def spend(ledger: Ledger | None, epsilon: float, delta: float = 0.0) -> None:
    if ledger is not None:
        ledger.spend(epsilon, delta)

