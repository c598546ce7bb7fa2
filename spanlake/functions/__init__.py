"""Column functions that Spark does not have."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc(x: Column) -> Column:
    """Towards zero, as a number."""
    return F.signum(x) * F.floor(F.abs(x))


def csch(x: Column) -> Column:
    return 1 / F.sinh(x)


def sech(x: Column) -> Column:
    return 1 / F.cosh(x)


def coth(x: Column) -> Column:
    return 1 / F.tanh(x)


def acot(x: Column) -> Column:
    return F.atan(1 / x)


def acsc(x: Column) -> Column:
    return F.asin(1 / x)


def asec(x: Column) -> Column:
    return F.acos(1 / x)


def acoth(x: Column) -> Column:
    return F.atanh(1 / x)


def acsch(x: Column) -> Column:
    return F.asinh(1 / x)


def asech(x: Column) -> Column:
    return F.acosh(1 / x)


def isinf(x: Column) -> Column:
    return F.abs(x) == F.lit(math.inf)


def erf(x: Column) -> Column:
    """Error function by its alternating series where that converges fast, and 1 - erfc by a continued fraction beyond."""
    z = F.abs(x)
    term, total = z, z
    for n in range(1, 40):
        term = term * (-z * z) / n
        total = total + term / (2 * n + 1)
    tail = F.lit(0.0)
    for k in range(40, 0, -1):
        tail = F.lit(k / 2.0) / (z + tail)
    far = 1 - F.exp(-z * z) / ((z + tail) * math.sqrt(math.pi))
    return F.signum(x) * F.when(z < 2.5, total * (2 / math.sqrt(math.pi))).otherwise(far)


def erfc(x: Column) -> Column:
    return 1 - erf(x)


def _lifted(x: Column) -> Column:
    """x moved up by whole steps to 8 at least."""
    return x + F.greatest(F.lit(0.0), F.ceil(8 - x).cast("double"))


def lgamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: the recurrence up to 8, then Stirling's series."""
    low, y = F.lit(0.0), _lifted(x)
    for i in range(8):
        low = low + F.when(x + i < 8, F.log(x + i)).otherwise(0.0)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - low


def lbeta(x: Column, y: Column) -> Column:
    """ln of the beta function for positive numbers."""
    return lgamma(x) + lgamma(y) - lgamma(x + y)


def digamma(x: Column) -> Column:
    """Derivative of lgamma for x > 0: the recurrence up to 8, then its series."""
    low, y = F.lit(0.0), _lifted(x)
    for i in range(8):
        low = low + F.when(x + i < 8, 1 / (x + i)).otherwise(0.0)
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - low


def gamma(x: Column) -> Column:
    return F.exp(lgamma(x))


def polar(re: Column, im: Column) -> Column:
    """Modulus and phase."""
    return F.struct(F.hypot(re, im).alias("modulus"), F.atan2(im, re).alias("phase"))


def rect(modulus: Column, phase: Column) -> Column:
    return F.struct((modulus * F.cos(phase)).alias("re"), (modulus * F.sin(phase)).alias("im"))
