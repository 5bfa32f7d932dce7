"""Reproducible randomness as column expressions.

A uniform is a keyed hash of (seed, salt, row key), so it does not depend on how
the rows are partitioned and a recomputed task draws the same numbers again.
`seed=None` takes a secret from the operating system; use it for released private
values, where a guessable seed would undo the protection.
"""

from __future__ import annotations

import math
import secrets
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2**52)


def secret_seed() -> str:
    return secrets.token_hex(16)


def digest_text(seed, salt, *keys) -> Column:
    """What u01 hashes."""
    if seed is None:
        seed = secret_seed()
    cols = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), *[c.cast("string") for c in cols])


def least_above(x: float) -> int:
    """Smallest m with (m + 0.5) / 2 ** 52 > x, 0 <= x < 1."""
    return max(math.floor(Fraction(x) * 2**52 - Fraction(1, 2)) + 1, 0)


def above(digest: Column, x: float) -> Column:
    """Whether the uniform of u01 with this md5 text is above x, 0 <= x < 1: hex digits of one length order as their numbers."""
    return digest >= F.lit(f"{least_above(x):013x}")


def u01(seed, salt, *keys) -> Column:
    """Uniform on (0, 1) with 52 random bits."""
    digest = F.md5(digest_text(seed, salt, *keys))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(TWO_52)


def pick(u: Column, n: Column) -> Column:
    """1-based uniform choice out of n."""
    return F.least(F.floor(u * n) + 1, n.cast("long"))


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal by the Box-Muller formula."""
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def exponential(u: Column) -> Column:
    return -F.log(u)
