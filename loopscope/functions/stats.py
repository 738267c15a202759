"""Closed-form statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
#: Distribution function of Poisson(1) at 0, 1, ..., 7.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval in percent; 0, 0 without observations."""
    n, p = n.cast("double"), F.try_divide(successes.cast("double"), n.cast("double"))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    some = lambda c: F.when(n > 0, 100.0 * c).otherwise(0.0)
    return some(F.greatest(mid - half, F.lit(0.0))), some(F.least(mid + half, F.lit(1.0)))


def significance(lo: Column, hi: Column) -> Column:
    """Whether an interval leaves out 0."""
    return F.when((lo > 0) | (hi < 0), "yes").otherwise("no")


def kappa(agree: Column, yes_a: Column, yes_b: Column, n: Column) -> Column:
    """Cohen's kappa of two yes/no annotators from counts; 1 when chance alone agrees always."""
    n = n.cast("double")
    po, pe = agree / n, (yes_a / n) * (yes_b / n) + (1 - yes_a / n) * (1 - yes_b / n)
    return F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))


def keyed_order(*keys: Column) -> Column:
    """A hash that other engines have as well, to draw at random and yet reproducibly."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))


def poisson_weight(*keys: Column) -> Column:
    """How often a bootstrap replicate draws a value: Poisson(1), from 28 bits of a keyed hash."""
    u = (F.conv(F.substring(keyed_order(*keys), 1, 7), 16, 10).cast("long") + 0.5) / float(1 << 28)
    return sum((u > F.lit(round(c, 12))).cast("int") for c in POISSON)
