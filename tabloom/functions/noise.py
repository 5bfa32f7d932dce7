"""Differentially private noise as column expressions.

Each mechanism maps uniforms on (0, 1) through an inverse distribution function, so noise
is drawn inside Spark without per-value Python. `u` columns come from `rng.u01`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _check(epsilon: float, delta: float = 0.0):
    if epsilon < 0 or not 0 <= delta <= 1 or (epsilon == 0 and delta == 0):
        raise ValueError("epsilon must not be negative, delta must lie in [0, 1], and one must be positive")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def laplace_scale(epsilon: float, sensitivity, delta: float = 0.0):
    _check(epsilon, delta)
    return sensitivity / (epsilon - math.log(1 - delta)) if not math.isinf(epsilon) else sensitivity * 0.0


def laplace_draw(u: Column, scale) -> Column:
    return -F.signum(u - 0.5) * F.log(1 - 2 * F.abs(u - 0.5)) * scale


def laplace(value: Column, u: Column, epsilon: float, sensitivity, delta: float = 0.0) -> Column:
    return value + laplace_draw(u, laplace_scale(epsilon, sensitivity, delta))


def clamp(x: Column, lower, upper) -> Column:
    return F.when(x.isNotNull(), F.greatest(_col(lower), F.least(_col(upper), x)))


def fold(x: Column, lower, upper) -> Column:
    """Reflect at the bounds until inside."""
    lo, w = _col(lower), _col(upper) - _col(lower)
    y = F.pmod(x - lo, 2 * w)
    return lo + F.least(y, 2 * w - y)


def laplace_truncated(value: Column, u: Column, epsilon: float, sensitivity, lower, upper, delta: float = 0.0) -> Column:
    return clamp(laplace(value, u, epsilon, sensitivity, delta), lower, upper)


def laplace_folded(value: Column, u: Column, epsilon: float, sensitivity, lower, upper, delta: float = 0.0) -> Column:
    return fold(laplace(value, u, epsilon, sensitivity, delta), lower, upper)


def _laplace_between(u: Column, centre: Column, scale: Column, lower, upper) -> Column:
    """Laplace law around `centre` conditioned on [lower, upper]."""
    cdf = lambda x: F.when(x < centre, 0.5 * F.exp((x - centre) / scale)).otherwise(1 - 0.5 * F.exp((centre - x) / scale))
    a, b = cdf(_col(lower)), cdf(_col(upper))
    p = a + u * (b - a)
    return F.when(p < 0.5, centre + scale * F.log(2 * p)).otherwise(centre - scale * F.log(2 * (1 - p)))


def _newton_rate(rate, s, w, target: float, exp, log, larger):
    """One Newton step for the rate 1 / b in s rate + ln c(rate) = target.

    c = A / B compares the normalising constants of two laws whose centres lie one sensitivity s apart, one of
    them at an end of a domain of width w: A = 2 - e^(-s rate) - e^(-(w - s) rate), B = 1 - e^(-w rate). The left
    side rises from 0 at rate 0; a step never leaves less than a quarter of the rate.
    """
    near, far, whole = exp(-rate * s), exp(-rate * (w - s)), exp(-rate * w)
    a, b = 2 - near - far, 1 - whole
    value = rate * s + log(a / b) - target
    slope = s + (s * near + (w - s) * far) / a - w * whole / b
    return larger(rate / 4, rate - value / slope)


def bounded_domain_scale(epsilon: float, sensitivity, width, delta: float = 0.0, steps: int = 60) -> Column:
    """Smallest scale b of a Laplace law cut to a domain of `width` that is (epsilon, delta)-private."""
    target = epsilon - math.log1p(-delta)
    if not isinstance(sensitivity, Column) and not isinstance(width, Column):
        s, w = float(sensitivity), float(width)
        rate = target / (2 * s)
        for _ in range(steps):
            rate = _newton_rate(rate, s, w, target, math.exp, math.log, max)
        return F.lit(1 / rate)
    s, w = _col(sensitivity), _col(width)
    rate = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), target / (2 * s), lambda r, _: _newton_rate(r, s, w, target, F.exp, F.log, F.greatest))
    return 1 / rate


def laplace_bounded_domain(value: Column, u: Column, epsilon: float, sensitivity, lower, upper, delta: float = 0.0, scale: Column | None = None) -> Column:
    """Laplace law around the value restricted to [lower, upper]."""
    v = clamp(value, lower, upper)
    if math.isinf(epsilon):
        return v
    plain = not isinstance(lower, Column) and not isinstance(upper, Column)
    width = float(upper) - float(lower) if plain else _col(upper) - _col(lower)
    b = scale if scale is not None else bounded_domain_scale(epsilon, sensitivity, width, delta)
    return _laplace_between(u, v, b, lower, upper)


def bounded_noise_limit(epsilon: float, delta: float, sensitivity: float) -> tuple[float, float]:
    """(scale, largest noise) of the bounded-noise mechanism."""
    _check(epsilon, delta)
    if not 0 < delta < 0.5:
        raise ValueError("delta must lie in (0, 0.5)")
    scale = sensitivity / epsilon
    return scale, scale * math.log(1 + (math.exp(epsilon) - 1) / (2 * delta))


def laplace_bounded_noise(value: Column, u: Column, epsilon: float, delta: float, sensitivity: float) -> Column:
    scale, top = bounded_noise_limit(epsilon, delta, sensitivity)
    return value + _laplace_between(u, F.lit(0.0), F.lit(scale), -top, top)


def geometric(value: Column, u: Column, epsilon: float, sensitivity=1) -> Column:
    """Two-sided geometric noise on whole numbers, which has k with probability (1 - q) / (1 + q) q^|k|, q = exp(-epsilon / sensitivity).

    The draw is the u-quantile. Below zero the distribution function is q^|k| / (1 + q); from zero on it falls short
    of one by q^(k + 1) / (1 + q).
    """
    _check(epsilon)
    if math.isinf(epsilon):
        return value.cast("long")
    decay = F.lit(float(epsilon)) / _col(sensitivity)
    q = F.exp(-decay)
    left, right = u * (1 + q), (1 - u) * (1 + q)
    quantile = F.when(left <= q, -F.floor(-F.log(left) / decay)).otherwise(F.ceil(-F.log(right) / decay) - 1)
    return (value + quantile).cast("long")


def geometric_truncated(value: Column, u: Column, epsilon: float, lower, upper, sensitivity=1) -> Column:
    return clamp(geometric(value, u, epsilon, sensitivity).cast("double"), lower, upper).cast("long")


def geometric_folded(value: Column, u: Column, epsilon: float, lower, upper, sensitivity=1) -> Column:
    return fold(geometric(value, u, epsilon, sensitivity).cast("double"), lower, upper).cast("long")


def gaussian_scale(epsilon: float, delta: float, sensitivity: float) -> float:
    if not 0 < epsilon <= 1 or not 0 < delta < 1:
        raise ValueError("the classic calibration needs epsilon in (0, 1] and delta in (0, 1)")
    return math.sqrt(2 * math.log(1.25 / delta)) * sensitivity / epsilon


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def gaussian_analytic_scale(epsilon: float, delta: float, sensitivity: float) -> float:
    """Smallest deviation whose exact privacy loss meets (epsilon, delta)."""

    def leak(s):
        a, b = sensitivity / (2 * s), epsilon * s / sensitivity
        return _phi(a - b) - math.exp(epsilon) * _phi(-a - b)

    lo, hi = 1e-9 * sensitivity, sensitivity
    while leak(hi) > delta:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if leak(mid) > delta else (lo, mid)
    return hi


def gaussian(value: Column, u1: Column, u2: Column, scale: float) -> Column:
    return value + scale * F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)


def gaussian_discrete_scale(epsilon: float, delta: float, sensitivity: int = 1) -> float:
    def leak(s):
        top = int(math.ceil(12 * s + epsilon * s * s / sensitivity + sensitivity)) + 1
        weight = {x: math.exp(-x * x / (2 * s * s)) for x in range(-top, top + 1)}
        cut, total = epsilon * s * s / sensitivity, sum(weight.values())
        return (sum(w for x, w in weight.items() if x > cut - sensitivity / 2)
                - math.exp(epsilon) * sum(w for x, w in weight.items() if x > cut + sensitivity / 2)) / total

    lo, hi = 1e-3, 1.0
    while leak(hi) > delta:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if leak(mid) > delta else (lo, mid)
    return hi


def discrete_table(scale: float) -> tuple[int, list[float]]:
    """(largest value, cumulative law) of the discrete Gaussian over +-12 deviations."""
    top = int(math.ceil(12 * scale))
    w = [math.exp(-x * x / (2 * scale * scale)) for x in range(-top, top + 1)]
    total, run, out = sum(w), 0.0, []
    for x in w:
        run += x
        out.append(run / total)
    return top, out


def gaussian_discrete(value: Column, u: Column, scale: float) -> Column:
    top, cum = discrete_table(scale)
    steps = F.array(*[F.lit(c) for c in cum[:-1]])
    return (value + F.size(F.filter(steps, lambda c: c < u)) - top).cast("long")


def staircase(value: Column, u: tuple[Column, Column, Column, Column], epsilon: float, sensitivity: float, gamma: float | None = None) -> Column:
    _check(epsilon)
    g = gamma if gamma is not None else 1 / (1 + math.exp(epsilon / 2))
    b = math.exp(-epsilon)
    sign = F.when(u[0] < 0.5, -1.0).otherwise(1.0)
    step = F.floor(F.log(u[1]) / math.log(b))
    inner = u[3] < g / (g + (1 - g) * b)
    spread = F.when(inner, step + g * u[2]).otherwise(step + g + (1 - g) * u[2])
    return value + sign * spread * sensitivity


def uniform(value: Column, u: Column, delta: float, sensitivity: float) -> Column:
    if not 0 < delta <= 0.5:
        raise ValueError("delta must lie in (0, 0.5]")
    return value + (u - 0.5) * (sensitivity / delta)


def binary(value: Column, u: Column, epsilon: float, value0, value1) -> Column:
    """Keep the label with probability e^eps / (1 + e^eps), else flip it."""
    other = F.when(value == value0, F.lit(value1)).when(value == value1, F.lit(value0))
    return F.when(u < 1 / (1 + math.exp(-epsilon)), value).otherwise(other)


def rounded(value: Column) -> Column:
    """Round a noisy number to a whole one."""
    return F.rint(value).cast("long")


def as_text(value: Column) -> Column:
    return value.cast("long").cast("string")


# --- expected error -----------------------------------------------------------------

def laplace_variance(scale) -> Column:
    return 2 * _col(scale) * _col(scale)


def truncated_bias(value: Column, scale, lower, upper) -> Column:
    b = _col(scale)
    return b / 2 * (F.exp((_col(lower) - value) / b) - F.exp((value - _col(upper)) / b))


def truncated_variance(value: Column, scale, lower, upper) -> Column:
    """Second moment about the value minus the squared bias."""
    b, lo, hi = _col(scale), value - _col(lower), _col(upper) - value
    second = 2 * b * b - b * (b + lo) * F.exp(-lo / b) - b * (b + hi) * F.exp(-hi / b)
    bias = truncated_bias(value, scale, lower, upper)
    return second - bias * bias


def geometric_variance(epsilon: float, sensitivity: float = 1.0) -> float:
    q = math.exp(-epsilon / sensitivity)
    return 2 * q / (1 - q) ** 2


def uniform_variance(delta: float, sensitivity: float) -> float:
    return (sensitivity / delta) ** 2 / 12
