"""Table sources (S1) and result sinks."""

from insight.sources.tables import TABLE_SCHEMAS, cast_or_reject, load, load_checked, read_table  # noqa: F401
from insight.sources.sinks import write_table, write_projection, kpi_table, publish, read_published  # noqa: F401
