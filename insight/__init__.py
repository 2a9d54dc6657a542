"""insight: customer, operations and risk analytics as Spark DataFrame operators.

Every operator takes DataFrame(s) plus column names and returns a lazy
DataFrame; nothing is collected on the driver except values whose size is
bounded by a parameter (bin edges, model coefficients, feature names).

Sub-packages
------------
sources    table readers (explicit schemas) and result writers
functions  Column -> Column expressions (clipping, bands, time parts, rounding)
operators  DataFrame -> DataFrame analyses (cleaning, ranking, RFM, rates,
           scorecards, sampling, models, metrics)
plans      the query catalogue bound to the driver tables, plus oracle SQL
"""

from insight.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
