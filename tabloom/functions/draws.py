"""Weighted draws by equi-joins.

A discrete law becomes intervals of (0, 1); every interval is listed under the grid cells
it covers, so a draw joins on the cell and filters on the interval. No range or cross join
is needed. The grid of a group follows the number of its levels, so a cell meets a bounded
number of them, and a level with much mass is spread over many cells and so over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tabloom.functions.ordering import running_totals
from tabloom.functions.tables import materialise

#: Grids have 2 ** GRIDS[0] cells, or the first of the others with at least as many cells as the group has levels.
GRIDS = (6, 10, 14, 18, 22)
#: Weights that are not whole go to multiples of this share of their group's total, so that intervals meet without gaps.
UNIT = 2.0**-50


def whole_weights(weights: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """Weights as positive whole numbers in the column _q; whole ones stay as they are."""
    if isinstance(weights.schema[weight].dataType, IntegralType):
        return weights.withColumn("_q", F.col(weight).cast("long"))
    if not by:
        total = weights.agg(F.sum(weight)).scalar()
        return weights.withColumn("_q", F.greatest(F.round(F.col(weight) / total / UNIT).cast("long"), F.lit(1)))
    totals = weights.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.sum(weight).alias("_total"))
    on = [weights[c].eqNullSafe(totals[f"_by_{c}"]) for c in by]
    return weights.join(totals, on).withColumn("_q", F.greatest(F.round(F.col(weight) / F.col("_total") / UNIT).cast("long"), F.lit(1)))


def interval_table(weights: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """(by..., value, _lo, _hi, _bits, _cell); weights must be one row per (by, value).

    Running totals go over ranges of (by, value), so neither a table without groups nor a group with most of
    the levels is ordered by one task. A group has 2 ** _bits cells, and at most two rows for each of its levels
    and cells together.
    """
    rows = whole_weights(weights.where(F.col(weight) > 0), by, weight)
    rows = materialise(rows.select(*by, value, "_q"))
    t = running_totals(rows, [value], {"_s": F.col("_q"), "_k": F.lit(1).cast("long")}, by=by, totals={"_s": "_t", "_k": "_levels"})
    bits = F.lit(GRIDS[-1])
    for b in reversed(GRIDS[:-1]):
        bits = F.when(F.col("_levels") <= 2**b, b).otherwise(bits)
    t = t.select(*by, value, ((F.col("_s") - F.col("_q")) / F.col("_t")).alias("_lo"), (F.col("_s") / F.col("_t")).alias("_hi"), bits.alias("_bits"))
    cells = F.pow(F.lit(2.0), "_bits")
    covered = F.sequence(F.floor(F.col("_lo") * cells).cast("long"), F.least(F.floor(F.col("_hi") * cells), cells - 1).cast("long"))
    return t.select("*", F.explode(covered).alias("_cell"))


def draw(rows: DataFrame, table: DataFrame, by: Sequence[str], value: str, u: Column, out: str) -> DataFrame:
    """Add `out`: one level per row drawn from its group's law; rows of a group without a law go.

    Without groups a row takes the cell of the law's only grid. With groups it is listed once for each of the
    grids (five at most) that the law has, and only the one of its group matches.
    """
    t = table.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(value).alias("_drawn"), "_lo", "_hi", F.col("_bits").alias("_bits2"), F.col("_cell").alias("_cell2"))
    rows = rows.withColumn("_u", u)
    if by:
        grids = sorted(r["_bits"] for r in table.select("_bits").distinct().collect())  # five at most
        rows = rows.withColumn("_bits", F.explode(F.array(*map(F.lit, grids))) if len(grids) > 1 else F.lit(grids[0] if grids else GRIDS[0]))
    else:
        rows = rows.withColumn("_bits", table.agg(F.max("_bits")).scalar())
    rows = rows.withColumn("_cell", F.floor(F.col("_u") * F.pow(F.lit(2.0), "_bits")).cast("long"))
    on = (rows["_cell"] == t["_cell2"]) & (rows["_bits"] == t["_bits2"]) & (rows["_u"] >= t["_lo"]) & (rows["_u"] < t["_hi"])
    for c in by:
        on = on & (rows[c] == t[f"_by_{c}"])
    return rows.join(t, on).withColumn(out, F.col("_drawn")).drop("_u", "_bits", "_cell", "_bits2", "_cell2", "_lo", "_hi", "_drawn", *[f"_by_{c}" for c in by])


def exponential_select(cands: DataFrame, by: Sequence[str], candidate: str, utility: Column, epsilon: float, sensitivity: float, u: Column, *,
                       monotonic: bool = False, measure: Column | None = None) -> DataFrame:
    """One candidate per group by the exponential mechanism, as the largest of utility plus Gumbel noise."""
    score = utility * (epsilon / (sensitivity * (1 if monotonic else 2)))
    if measure is not None:
        score = F.when(measure > 0, score + F.log(measure))
    rows = cands.withColumn("_score", score - F.log(-F.log(u)))
    return rows.groupBy(*by).agg(F.max_by(candidate, "_score").alias(candidate))


def permute_and_flip(cands: DataFrame, by: Sequence[str], candidate: str, utility: Column, epsilon: float, sensitivity: float, u: Column, *,
                     monotonic: bool = False) -> DataFrame:
    """Permute-and-flip selection, which has the law of the largest utility plus exponential noise."""
    rows = cands.withColumn("_score", utility * (epsilon / (sensitivity * (1 if monotonic else 2))) - F.log(u))
    return rows.groupBy(*by).agg(F.max_by(candidate, "_score").alias(candidate))


def category_transitions(utilities: DataFrame, epsilon: float) -> DataFrame:
    """(value, out, p): law of the released category from pairwise distances (value, out, utility).

    The exponent is halved unless every category has the same normalising constant.
    """
    top = utilities.agg(F.max("utility")).scalar()
    full = F.exp(-epsilon * F.col("utility") / F.col("_m"))
    u = utilities.withColumn("_m", top).withColumn("_w", full)
    norm = u.groupBy("value").agg(F.sum("_w").alias("_n"))
    even = norm.agg((F.max("_n") - F.min("_n") < 1e-9 * F.max("_n"))).scalar()
    u = u.withColumn("_w", F.when(even, F.col("_w")).otherwise(F.sqrt("_w")))
    norm = u.groupBy("value").agg(F.sum("_w").alias("_n"))
    return u.join(norm, "value").select("value", "out", (F.col("_w") / F.col("_n")).alias("p"))


def hierarchy_utilities(levels: DataFrame, value: str, path: Sequence[str]) -> DataFrame:
    """Distance of two categories in a tree given by level columns from the root down: the depth
    minus the number of shared leading levels, 0 for a category and itself.

    The pairs are the mechanism's own table over the leaves of the hierarchy.
    """
    depth = len(path) + 1
    a = levels.select(F.lit(1).alias("j"), F.col(value).alias("value"), *[F.col(p).alias(f"a_{p}") for p in path])
    b = levels.select(F.lit(1).alias("j"), F.col(value).alias("out"), *[F.col(p).alias(f"b_{p}") for p in path])
    shared, same = F.lit(0), F.lit(True)
    for p in path:
        same = same & (F.col(f"a_{p}") == F.col(f"b_{p}"))
        shared = shared + same.cast("int")
    pairs = a.join(b, "j")
    return pairs.select("value", "out", F.when(F.col("value") == F.col("out"), 0).otherwise(depth - shared).cast("double").alias("utility"))
