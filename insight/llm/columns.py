"""Tables of any column names: an operator works on numbered copies and gives the caller's names back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{column}`")


def boxed(df: DataFrame, **needed: str) -> DataFrame:
    """The columns of ``df`` as ``in0_``, ``in1_``, ..., and copies of some under the names that an operator uses."""
    return df.select(*[named(c).alias(f"in{k}_") for k, c in enumerate(df.columns)], *[named(c).alias(n) for n, c in needed.items()])


def unboxed(out: DataFrame, columns: list[str], *new: str) -> DataFrame:
    """The caller's ``columns`` under their names and the columns ``new``, which replace columns of the same name."""
    gone = {n.lower() for n in new}
    return out.select(*[F.col(f"in{k}_").alias(c) for k, c in enumerate(columns) if c.lower() not in gone], *new)
