"""RFM customer segmentation.

One aggregate per customer (recency, frequency, monetary), three exact rank
quintiles (``rank_bins``: only narrow (value, id) pairs are range-shuffled),
then a score and a segment.  Revenue per customer is *not* aggregated a
second time and merged back: ``monetary`` already holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.functions.expr import band, money, money_sum, pct_true, round_half_even
from insight.functions.timeparts import whole_days_between
from insight.operators.ranking import rank_bins_multi

# Fixed values that must equal the reference: segment thresholds on the
# R+F+M score (first match wins), the fallback segment, and the display order.
SEGMENT_THRESHOLDS = [(13, "Champions"), (10, "Loyal Customers"), (7, "Potential Loyalists"), (4, "At Risk")]
SEGMENT_DEFAULT = "Churned"
SEGMENT_ORDER = ["Champions", "Loyal Customers", "Potential Loyalists", "At Risk", "Churned"]


def snapshot_after_last(df: DataFrame, date: str, days: int = 1):
    """``df[date].max() + timedelta(days=1)`` as a scalar subquery Column."""
    return df.select(F.timestamp_add("DAY", F.lit(days), F.max(date))).scalar()


def rfm(df: DataFrame, customer: str, order_id: str, date: str, value: str,
        q: int = 5, out_customer: str = "customer_id", money_scale: int | None = 2,
        num_partitions: int | None = None) -> DataFrame:
    """RFM table, one row per customer (A4).

    recency  = whole days from the customer's last order to snapshot
               (global last order + 1 day), R ranks it descending;
    frequency = order count, monetary = value sum (exact decimal when
               ``money_scale`` is set), both ranked ascending;
    ties in every rank by customer id ascending (F6).
    """
    df = df.where(F.col(customer).isNotNull())  # a null key is no customer, as in pandas' groupby
    snap = snapshot_after_last(df, date)
    mon = money_sum(value, money_scale) if money_scale is not None else F.sum(value)
    per = df.groupBy(F.col(customer).alias(out_customer)).agg(
        F.max(date).alias("_last"),
        F.count(order_id).alias("frequency"),
        mon.alias("monetary"),
    )
    per = per.select(out_customer, whole_days_between(F.col("_last"), snap).alias("recency"),
                     "frequency", "monetary")
    per = rank_bins_multi(per, [("recency", False, "r_score"), ("frequency", True, "f_score"),
                                ("monetary", True, "m_score")], q, out_customer,
                          num_partitions=num_partitions)
    score = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return per.withColumn("rfm_score", score).withColumn(
        "segment", band("rfm_score", SEGMENT_THRESHOLDS, SEGMENT_DEFAULT))


def label_frame(df: DataFrame, name: str, labels: Sequence[str], ordinal: str) -> DataFrame:
    """A fixed label list with its display ordinal (a frame bounded by the list)."""
    schema = T.StructType([T.StructField(name, T.StringType(), False),
                           T.StructField(ordinal, T.IntegerType(), False)])
    return df.sparkSession.createDataFrame([(v, i + 1) for i, v in enumerate(labels)], schema)


def align_to(df: DataFrame, key: str, labels: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """``set_index(key).reindex(labels)`` (J3): every label once, in order; missing -> nulls."""
    lf = label_frame(df, key, labels, ordinal)
    return F.broadcast(lf).join(df, on=key, how="left")


def segment_summary(rfm_df: DataFrame, segment: str = "segment", customer: str = "customer_id",
                    revenue: str = "monetary", labels: Sequence[str] = SEGMENT_ORDER) -> DataFrame:
    """Customers, revenue and shares per segment in display order.

    ``avg_revenue_per_customer`` is total revenue / customers: the reference's
    "Avg_Order_Val" column is this per-customer mean (F8).
    """
    g = rfm_df.groupBy(segment).agg(
        F.count(customer).alias("customers"),
        F.sum(money(revenue)).alias("_rev"),
    )
    # totals over the grouped frame (one row per segment, bounded by the
    # label list): no second pass over the customer table
    whole = Window.partitionBy()
    tot_rev = F.sum("_rev").over(whole)
    tot_cust = F.sum("customers").over(whole)
    g = g.select(
        segment, "customers",
        F.col("_rev").cast("double").alias("total_revenue"),
        (F.col("_rev").cast("double") / F.col("customers")).alias("avg_revenue_per_customer"),
        round_half_even(F.col("_rev").cast("double") / tot_rev.cast("double") * F.lit(100.0), 1).alias("revenue_pct"),
        round_half_even(F.col("customers").cast("double") / tot_cust * F.lit(100.0), 1).alias("customer_pct"),
    )
    return align_to(g, segment, labels, ordinal="segment_order").orderBy("segment_order")


def first_touch(df: DataFrame, key: str, attr: str, order_by: str, out_key: str | None = None,
                out_attr: str | None = None) -> DataFrame:
    """Attribute of each key's first row in table order.

    ``min_by`` runs as a partial + final aggregate, so a key holding a third
    of all rows is reduced map-side before the shuffle.
    """
    return df.groupBy(F.col(key).alias(out_key or key)).agg(
        F.min_by(F.col(attr), F.col(order_by)).alias(out_attr or attr))


def churn_by_channel(rfm_df: DataFrame, channels: DataFrame, key: str = "customer_id",
                     channel: str = "channel", segment: str = "segment",
                     churned: str = SEGMENT_DEFAULT) -> DataFrame:
    """Percent of each channel's customers in the churned segment.

    Adds the unweighted mean of the channel rates and an above-mean flag.
    Both inputs are keyed by customer; the join is sort-merge on co-partitioned
    aggregates (or broadcast when AQE sees a small side).
    """
    j = rfm_df.select(key, segment).join(channels.select(key, channel), on=key, how="inner")
    rates = j.groupBy(channel).agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col(segment) == churned).alias("churned"),
        pct_true(F.col(segment) == churned).alias("churn_rate_pct"),
    )
    # one row per channel: the mean over the grouped frame needs no second pass
    mean_rate = F.avg("churn_rate_pct").over(Window.partitionBy())
    return rates.withColumn("mean_rate_pct", round_half_even(mean_rate, 6)).withColumn(
        "above_mean", F.col("churn_rate_pct") > mean_rate)
