"""The regularised incomplete beta function and the p-value of a correlation, as Columns.

The continued fraction is evaluated from the front by Lentz's method in ``STEPS`` half steps, inside one
``aggregate`` over a literal sequence: no Python function, and an expression of constant size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 400
#: Below this argument the ratio of gamma functions is moved up by its recurrence.
LEAST_ARGUMENT, SHIFTS = 12.0, 12


def log_gamma_half_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for a > 0: recurrence up to a large argument, then the asymptotic series."""
    lifted = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFTS - 1)), F.lit(0.0), lambda s, k: s + F.log((a + k) / (a + k + F.lit(0.5))))
    small = a < F.lit(LEAST_ARGUMENT)
    x = F.when(small, a + F.lit(float(SHIFTS))).otherwise(a)
    # coefficients of the series in 1/x
    series = F.log(x) / 2 - 1 / (8 * x) + 1 / (192 * F.pow(x, F.lit(3))) - 1 / (640 * F.pow(x, F.lit(5)))
    return series + F.when(small, lifted).otherwise(F.lit(0.0))


def _fraction(x: Column, a: Column, b: Column) -> Column:
    one = F.lit(1.0)
    d = one / (one - (a + b) * x / (a + one))
    start = F.struct(one.alias("c"), d.alias("d"), d.alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = F.floor((k + 1) / 2).cast("double")
        num = F.when(k % 2 == 1, m * (b - m) * x / ((a - one + 2 * m) * (a + 2 * m))).otherwise(
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + one + 2 * m)))
        c, d = one + num / s["c"], one / (one + num * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of Pearson's (or the point-biserial) ``r`` of ``n`` pairs: with ``n - 2`` degrees of freedom it is
    the incomplete beta function at ``1 - r^2`` with parameters ``(n - 2) / 2`` and ``1/2``.

    Null for a null ``r`` or fewer than three pairs; 0 for ``|r| = 1``, 1 for ``r = 0``.
    """
    a, b = (n.cast("double") - 2) / 2, F.lit(0.5)
    y = r * r
    x = F.lit(1.0) - y
    front = F.exp(a * F.log1p(-y) + F.log(y) / 2 + log_gamma_half_step(a) - F.lit(math.log(math.pi) / 2))
    near = x < (a + 1) / (a + b + 2)
    p = F.when(near, front * _fraction(x, a, b) / a).otherwise(F.lit(1.0) - front * _fraction(y, b, a) / b)
    return F.when(r.isNull() | (n < 3), F.lit(None)).when(y >= 1, F.lit(0.0)).when(y <= 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
