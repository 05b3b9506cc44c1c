"""Scalar column expressions. Everything stays in the JVM; there is no Python UDF in this module."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: ColumnLike, den: ColumnLike, empty: float | None = 0.0) -> Column:
    """num/den as a double; a zero denominator gives ``empty`` (0.0 by convention, None for NULL)."""
    value = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def rounded(c: ColumnLike, digits: int = 9) -> Column:
    """Rounding for report columns. A thousandth of the last digit is added first, so that values which lie exactly
    half-way (means over 2^k rows do) are not decided by the order in which a sum was taken; adding 0.0 turns a
    negative zero into zero."""
    return F.round(col(c).cast("double") + F.lit(1.37 * 10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def snapped(c: ColumnLike, digits: int) -> Column:
    """Nearest multiple of 10^-digits in plain double arithmetic. For rows: F.round goes through a decimal object."""
    scale = F.lit(10.0 ** digits)
    return F.floor(col(c) * scale + F.lit(0.5)) / scale


def half_even(c: ColumnLike, digits: int) -> Column:
    return F.bround(col(c).cast("double"), digits) + F.lit(0.0)


def clip(c: ColumnLike, low: float, high: float) -> Column:
    return F.greatest(F.least(col(c), F.lit(high)), F.lit(low))


def ramp(c: ColumnLike, start: float, width: float) -> Column:
    """0 up to ``start``, then linear to 1 over ``width``."""
    return clip((col(c) - F.lit(start)) / F.lit(width), 0.0, 1.0)


def logit(p: ColumnLike, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(x: ColumnLike) -> Column:
    """exp is only ever taken of a non-positive number, so no input overflows."""
    e = F.exp(-F.abs(col(x)))
    return F.when(col(x) >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def softplus(x: ColumnLike) -> Column:
    return F.log1p(F.exp(-F.abs(col(x)))) + F.greatest(col(x), F.lit(0.0))


def softmax(*logits: Column) -> list[Column]:
    top = F.greatest(*logits)
    exps = [F.exp(z - top) for z in logits]
    total = reduce(lambda a, b: a + b, exps)
    return [e / total for e in exps]


def is_positive(p: ColumnLike, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """Decision at a threshold; nearly every study uses >=, the compression study uses >."""
    return col(p) >= F.lit(threshold) if inclusive else col(p) > F.lit(threshold)


def confidence(p: ColumnLike) -> Column:
    return F.greatest(col(p), F.lit(1.0) - col(p))


def uniform_hash(*parts: ColumnLike) -> Column:
    """Uniform in [0, 1) from the parts joined by ':'; the same on every run, engine and partitioning."""
    text = F.concat_ws(":", *[col(p).cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


# Rational approximation of the normal tail (numerator and denominator, highest power first).
_TAIL_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
             296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_tail(z: ColumnLike) -> Column:
    """P(Z > |z|) of the standard normal, to double precision."""
    x = F.abs(col(z).cast("double"))
    density = F.exp(-x * x / F.lit(2.0))
    near = density * _horner(_TAIL_NUM, x) / _horner(_TAIL_DEN, x)
    fraction = reduce(lambda acc, k: x + F.lit(float(k)) / acc, (4, 3, 2, 1), x + F.lit(0.65))
    far = density / fraction / F.lit(2.506628274631)
    return F.when(x < F.lit(7.07106781186547), near).otherwise(far)


def two_sided_p(z: ColumnLike) -> Column:
    return F.least(F.lit(1.0), F.lit(2.0) * normal_tail(z))


def chi2_1df_p(stat: ColumnLike) -> Column:
    """Tail of chi-square with one degree of freedom: the square of a standard normal."""
    return two_sided_p(F.sqrt(col(stat)))
