"""Logistic regression by Newton steps, and its compiled form.

A step is one aggregate of fixed size over the training rows, whatever their number: the gradient and the
weighted Gram matrix.  The driver solves a system as wide as the feature list.  The fitted model is a Column
and an SQL text, so scoring is a projection that stays inside the scan's stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Newton steps at most; they end earlier once no coefficient moves by ``TOLERANCE``.
STEPS, TOLERANCE = 10, 1e-10


@dataclass(frozen=True)
class LinearScore:
    """Coefficients of a linear model with a logistic link."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            out = out + F.lit(b) * F.col(c).cast("double")
        return out

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def sql(self) -> str:
        """The probability as SQL text over the feature columns."""
        terms = " + ".join([repr(self.intercept), *[f"{b!r} * {c}" for c, b in zip(self.features, self.coefficients)]])
        return f"1.0 / (1.0 + exp(-({terms})))"


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None, c: float = 1.0) -> LinearScore:
    """Minimise ``0.5 |w|^2 + c * sum(weight * log loss)``, the intercept free of the penalty.

    Rows with a null feature, label or weight take no part.  ``c`` is scikit-learn's inverse regularisation.
    """
    xs = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    m = len(xs)
    s, y = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(label).cast("double")
    known = train.dropna(subset=[*features, label, *([weight] if weight else [])])
    penalty = np.diag([0.0, *[1.0 / c] * len(features)])
    w = np.zeros(m)
    for _ in range(STEPS):
        p = LinearScore(tuple(features), tuple(map(float, w[1:])), float(w[0])).probability()
        moved = known.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], (s * (p - y)).alias("g"), (s * p * (1.0 - p)).alias("h"))
        sums = moved.agg(*[F.sum(F.col("g") * F.col(f"x{i}")) for i in range(m)],
                         *[F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(m) for j in range(i, m)]).first()
        if sums[0] is None:
            break
        gradient = np.array(sums[:m], dtype=float) + penalty @ w
        gram = np.zeros((m, m))
        gram[np.triu_indices(m)] = sums[m:]
        gram = gram + np.triu(gram, 1).T + penalty
        step = np.linalg.lstsq(gram, gradient, rcond=None)[0]
        w = w - step
        if np.abs(step).max() < TOLERANCE:
            break
    return LinearScore(tuple(features), tuple(map(float, w[1:])), float(w[0]))
