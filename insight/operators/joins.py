"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insight.session import materialize

# Measured bytes above which a group-statistic frame is joined by shuffle instead of broadcast.
BROADCAST_MAX_BYTES = 32 << 20


def _row_bytes(df: DataFrame):
    """Bytes of a row: variable-length values by their text, the rest at 16."""
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + F.lit(16) for c in df.columns), F.lit(0))


def hint_if_small(stored: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, int]:
    """A stored frame with a broadcast hint if its measured size allows one, and its number of rows.

    Beyond ``max_bytes`` the frame is returned unhinted and joins by shuffle,
    where AQE's skew-join handling applies.
    """
    rows, size = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(stored)), F.lit(0))).first()
    limit = BROADCAST_MAX_BYTES if max_bytes is None else max_bytes
    return (F.broadcast(stored) if size <= limit else stored), rows


def broadcast_if_small(small: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast ``small`` only when it is proven small.

    The frame (an aggregate result) is written once to the cluster's
    checkpoint folder, which cuts its lineage so the aggregate is not
    recomputed, and then measured (``hint_if_small``).
    """
    return hint_if_small(materialize(small), max_bytes)[0]


def join_group_stat(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left",
                    max_bytes: int | None = None) -> DataFrame:
    """Join a per-group statistic frame back to the rows."""
    return df.join(broadcast_if_small(stats, max_bytes), on=keys, how=how)
