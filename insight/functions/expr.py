"""Scalar expressions with the reference's pandas semantics.

Each helper returns a Column built from ``pyspark.sql.functions`` so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(col: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """``Series.clip``: bound a value, keeping nulls null.

    NaN is mapped to null first; Spark's ``least``/``greatest`` would turn
    null into ``lo`` and NaN into ``hi``.
    """
    x = _c(col)
    x = F.when(~F.isnan(x), x)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(lo))
    if hi is not None:
        y = F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)


def round_half_even(col: Column | str, digits: int = 0) -> Column:
    """pandas/numpy ``round``: ``rint(x * 10^d) / 10^d`` on the binary value.

    This is what ``Series.round`` computes (half to even on the scaled
    double), e.g. 2.25 -> 2.2, 2.35 -> 2.4, 8.65 -> 8.6 at one digit.
    """
    scale = float(10 ** digits)
    return F.rint(_c(col).cast("double") * F.lit(scale)) / F.lit(scale)


def money(col: Column | str, scale: int = 2) -> Column:
    """A money value as an exact decimal (sums stay exact and order-free)."""
    return _c(col).cast(f"decimal(18,{scale})")


def money_sum(col: Column | str, scale: int = 2) -> Column:
    """Exact sum of a money column, returned as double.

    Double sums depend on the order rows arrive in; a decimal sum does not,
    so results repeat across runs, partitionings and engines.
    """
    return F.sum(money(col, scale)).cast("double")


def guarded_ratio(num: Column | str, den: Column | str, default: float | None = 0.0) -> Column:
    """``a / b if b > 0 else default`` (X11); never divides by zero."""
    n, d = _c(num), _c(den)
    out = F.when(d > 0, n.cast("double") / d.cast("double"))
    return out.otherwise(F.lit(default)) if default is not None else out


def pct_true(pred: Column) -> Column:
    """``(pred).mean() * 100`` as an aggregate: exact counts, one division.

    Null over zero rows (ANSI mode would otherwise raise on the division).
    """
    n = F.count(F.lit(1))
    return F.when(n > 0, F.count_if(pred).cast("double") / n * F.lit(100.0))


def band(col: Column | str, thresholds: Sequence[tuple[float, str]], default: str) -> Column:
    """Ordered case mapping (X9): first ``x >= t`` wins, else ``default``."""
    x = _c(col)
    expr = None
    for t, label in thresholds:
        expr = F.when(x >= F.lit(t), F.lit(label)) if expr is None else expr.when(x >= F.lit(t), F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def interval_bins(col: Column | str, edges: Sequence[float], labels: Sequence[str] | None = None,
                  include_lowest: bool = False, ordinal: bool = False) -> Column:
    """``pandas.cut`` with right-closed, left-open bins.

    A value at the lowest edge, below it, above the top edge, null or NaN gets
    null (the reference's score-0 rows have no tier).  ``include_lowest=True``
    closes the first bin on the left.  With ``ordinal=True`` the 1-based bin
    number is returned instead of the label.
    """
    if len(edges) < 2:
        raise ValueError("need at least two edges")
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError("labels must have len(edges) - 1 entries")
    x = _c(col)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = F.lit(edges[i]), F.lit(edges[i + 1])
        cond = ((x >= lo) if (i == 0 and include_lowest) else (x > lo)) & (x <= hi)
        val = F.lit(i + 1) if ordinal or labels is None else F.lit(labels[i])
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def rule_score(weights: Mapping[str, float], bias: float = 0.0, scale: float = 1.0) -> Column:
    """Logistic rule score (X12): ``1 / (1 + exp(-(sum w_i x_i + bias) * scale))``."""
    z = F.lit(float(bias))
    for name, w in weights.items():
        z = z + F.lit(float(w)) * F.col(name).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z * F.lit(float(scale))))


def comes_after(row: Sequence[Column], bound: Sequence[Column], ascending: Sequence[bool]) -> Column:
    """Lexicographic "row sorts strictly after bound" for mixed directions.

    Used to place rows against order statistics without sorting them.
    Inputs are assumed non-null.
    """
    expr = None
    for r, b, asc in reversed(list(zip(row, bound, ascending))):
        gt = (r > b) if asc else (r < b)
        expr = gt if expr is None else (gt | ((r == b) & expr))
    return expr
