"""Weighted entity scorecards with value-quantile tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insight.functions.expr import clip, pct_true, round_half_even
from insight.operators.ranking import quantile_tiers

# Fixed values that must equal the reference: the delivery scorecard formula
# (rating out of 5 weighted 40; delivery time term (90 - minutes) / 80 clipped
# to [0, 1] weighted 30; share not cancelled weighted 30), rounded to 2 digits,
# and the three tier names from low to high.
RATING_SCALE = 5.0
WEIGHT_RATING, WEIGHT_SPEED, WEIGHT_RELIABILITY = 40.0, 30.0, 30.0
SPEED_CEILING_MIN, SPEED_SPAN_MIN = 90.0, 80.0
SCORE_DIGITS = 2
TIER_LABELS = ["Underperforming", "Average", "Top Performer"]


def delivery_score(avg_rating: Column, avg_minutes: Column, cancel_rate_pct: Column) -> Column:
    """The reference's restaurant performance score, unrounded."""
    speed = clip((F.lit(SPEED_CEILING_MIN) - avg_minutes) / F.lit(SPEED_SPAN_MIN), 0.0, 1.0)
    return ((avg_rating / F.lit(RATING_SCALE)) * F.lit(WEIGHT_RATING)
            + speed * F.lit(WEIGHT_SPEED)
            + (F.lit(1.0) - cancel_rate_pct / F.lit(100.0)) * F.lit(WEIGHT_RELIABILITY))


def scorecard(df: DataFrame, entity: str, aggs: Mapping[str, Column], score: Column,
              labels: Sequence[str] = TIER_LABELS, digits: int = SCORE_DIGITS,
              score_col: str = "performance_score", tier_col: str = "tier") -> DataFrame:
    """Per-entity aggregates, a rounded composite score and quantile tiers.

    One grouped aggregate (partial + final), a projection, then
    ``quantile_tiers`` (exact interpolated edges, right-closed bins).
    """
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(*[c.alias(n) for n, c in aggs.items()])
    per = per.withColumn(score_col, round_half_even(score, digits))
    return quantile_tiers(per, score_col, q=len(labels), labels=labels, out=tier_col)


def delivery_scorecard(df: DataFrame, entity: str, order_id: str, rating: str, minutes: str,
                       value: str, cancelled: Column) -> DataFrame:
    """Restaurant scorecard of the reference: orders, rating, minutes, revenue, cancel rate."""
    aggs = {
        "total_orders": F.count(F.col(order_id)),
        "avg_rating": F.avg(F.col(rating)),
        "avg_del_time": F.avg(F.col(minutes)),
        "total_revenue": F.sum(F.col(value).cast("decimal(18,2)")).cast("double"),
        "cancel_rate": pct_true(cancelled),
    }
    score = delivery_score(F.col("avg_rating"), F.col("avg_del_time"), F.col("cancel_rate"))
    return scorecard(df, entity, aggs, score)


def tier_summary(sc: DataFrame, tier_col: str = "tier", score_col: str = "performance_score",
                 labels: Sequence[str] = TIER_LABELS, digits: int = 6) -> DataFrame:
    """Entities and mean score per tier, low to high."""
    g = sc.where(F.col(tier_col).isNotNull()).groupBy(tier_col).agg(
        F.count(F.lit(1)).alias("entities"),
        round_half_even(F.avg(score_col), digits).alias("avg_score"),
        F.min(score_col).alias("min_score"), F.max(score_col).alias("max_score"))
    order = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(tier_col)).cast("int")
    return g.withColumn("tier_order", order).orderBy("tier_order")
