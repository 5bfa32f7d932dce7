"""Normal distribution function and its inverse as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximations of the normal law.
CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
INV_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
INV_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
INV_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """Error below 1e-7."""
    t = 1.0 / (1.0 + 0.2316419 * F.abs(x))
    upper = 0.3989422804014327 * F.exp(-x * x / 2) * t * _poly(tuple(reversed(CDF)), t)
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """Relative error below 2e-9."""
    q = p - 0.5
    r = q * q
    mid = _poly(INV_A, r) * q / (_poly(INV_B, r) * r + 1.0)
    tail = lambda v: _poly(INV_C, v) / (_poly(INV_D, v) * v + 1.0)
    low, high = F.sqrt(-2.0 * F.log(p)), F.sqrt(-2.0 * F.log(1.0 - p))
    return F.when(p < 0.02425, tail(low)).when(p > 0.97575, -tail(high)).otherwise(mid)
