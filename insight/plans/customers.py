"""Customer analyses on ``orders`` / ``customer``: RFM, churn, KPIs, trends.

Binding: customer ``o_custkey``, order ``o_orderkey``, date ``o_orderdate``,
value ``o_totalprice``; the order priority plays the acquisition channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.functions.expr import clip, money_sum, pct_true
from insight.functions.timeparts import day_index, day_name, is_weekend, month_label, month_start
from insight.operators import rfm as R
from insight.operators.summarise import kpi_long, ordered_flag
from insight.plans.registry import query
from insight.sources.tables import read_table


# Fixed values that must equal the reference: the days emphasised in the
# weekday demand frame (Friday to Sunday, although the weekend is Saturday
# and Sunday).
EMPHASIS_DAYS = ["Friday", "Saturday", "Sunday"]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders")


def _rfm(spark: SparkSession, sf: str) -> DataFrame:
    return R.rfm(_orders(spark, sf), "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


# Shared oracle CTE: the RFM table with plain (single-node) window ranks.
RFM_SQL = """
per AS (
  SELECT o_custkey AS customer_id,
         datesub('day', max(o_orderdate), (SELECT max(o_orderdate) + INTERVAL 1 DAY FROM orders)) AS recency,
         count(o_orderkey) AS frequency,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS monetary
  FROM orders GROUP BY o_custkey),
ranked AS (
  SELECT *, count(*) OVER () AS n,
         row_number() OVER (ORDER BY recency DESC, customer_id) AS rr,
         row_number() OVER (ORDER BY frequency, customer_id) AS fr,
         row_number() OVER (ORDER BY monetary, customer_id) AS mr
  FROM per),
binned AS (
  SELECT customer_id, recency, frequency, monetary,
         CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((rr - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS r_score,
         CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((fr - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS f_score,
         CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((mr - 1) * 5 + n - 2) // (n - 1)) END AS INTEGER) AS m_score
  FROM ranked),
rfm AS (
  SELECT *, r_score + f_score + m_score AS rfm_score,
         CASE WHEN r_score + f_score + m_score >= 13 THEN 'Champions'
              WHEN r_score + f_score + m_score >= 10 THEN 'Loyal Customers'
              WHEN r_score + f_score + m_score >= 7 THEN 'Potential Loyalists'
              WHEN r_score + f_score + m_score >= 4 THEN 'At Risk'
              ELSE 'Churned' END AS segment
  FROM binned)
"""


@query("rfm_customers", f"WITH {RFM_SQL} SELECT * FROM rfm")
def rfm_customers(spark: SparkSession, sf: str) -> DataFrame:
    return _rfm(spark, sf)


@query("rfm_segment_summary", f"""
WITH {RFM_SQL},
seg AS (SELECT segment, count(customer_id) AS customers,
               sum(CAST(monetary AS DECIMAL(18,2))) AS rev FROM rfm GROUP BY segment),
tot AS (SELECT sum(CAST(monetary AS DECIMAL(18,2))) AS rev, count(customer_id) AS cust FROM rfm),
labels(segment, segment_order) AS (VALUES ('Champions', 1), ('Loyal Customers', 2),
       ('Potential Loyalists', 3), ('At Risk', 4), ('Churned', 5))
SELECT l.segment, l.segment_order, s.customers,
       CAST(s.rev AS DOUBLE) AS total_revenue,
       CAST(s.rev AS DOUBLE) / s.customers AS avg_revenue_per_customer,
       round_even(CAST(s.rev AS DOUBLE) / CAST(t.rev AS DOUBLE) * 100.0 * 10.0, 0) / 10.0 AS revenue_pct,
       round_even(CAST(s.customers AS DOUBLE) / t.cust * 100.0 * 10.0, 0) / 10.0 AS customer_pct
FROM labels l LEFT JOIN seg s ON l.segment = s.segment CROSS JOIN tot t
""")
def rfm_segment_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.segment_summary(_rfm(spark, sf))


@query("first_touch_priority", """
SELECT o_custkey AS customer_id, arg_min(o_orderpriority, o_orderkey) AS channel
FROM orders GROUP BY o_custkey
""")
def first_touch_priority(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_touch(_orders(spark, sf), "o_custkey", "o_orderpriority", "o_orderkey",
                         out_key="customer_id", out_attr="channel")


@query("churn_by_channel", f"""
WITH {RFM_SQL},
ch AS (SELECT o_custkey AS customer_id, arg_min(o_orderpriority, o_orderkey) AS channel
       FROM orders GROUP BY o_custkey),
rates AS (
  SELECT channel, count(*) AS customers, CAST(count_if(segment = 'Churned') AS BIGINT) AS churned,
         CAST(count_if(segment = 'Churned') AS DOUBLE) / count(*) * 100.0 AS churn_rate_pct
  FROM rfm JOIN ch USING (customer_id) GROUP BY channel)
SELECT *, round_even(avg(churn_rate_pct) OVER () * 1e6, 0) / 1e6 AS mean_rate_pct,
       churn_rate_pct > avg(churn_rate_pct) OVER () AS above_mean
FROM rates
""")
def churn_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    rfm_df = R.rfm(o, "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    ch = R.first_touch(o, "o_custkey", "o_orderpriority", "o_orderkey", out_key="customer_id",
                       out_attr="channel")
    return R.churn_by_channel(rfm_df, ch).orderBy(F.col("churn_rate_pct").desc(), "channel")


@query("rfm_join_revenue", f"""
WITH {RFM_SQL},
rev AS (SELECT o_custkey AS customer_id,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
        FROM orders GROUP BY o_custkey)
SELECT customer_id, segment, monetary, total_revenue FROM rfm JOIN rev USING (customer_id)
""")
def rfm_join_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """The reference's shape (J1): revenue aggregated again and merged.

    Kept to show it equals ``monetary``; both sides are hash-partitioned by
    customer, so the join adds no exchange of its own.
    """
    o = _orders(spark, sf)
    rfm_df = R.rfm(o, "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    rev = o.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        money_sum("o_totalprice").alias("total_revenue"))
    return rfm_df.select("customer_id", "segment", "monetary").join(rev, "customer_id", "inner")


@query("order_kpis", """
WITH per AS (SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey),
k AS (
  SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
         CAST(count(*) AS DOUBLE) AS total_orders,
         CAST(count(DISTINCT o_custkey) AS DOUBLE) AS unique_customers,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_order_value,
         CAST(count_if(o_orderstatus = 'F') AS DOUBLE) / count(*) * 100.0 AS fulfilled_pct,
         CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE)
           / CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * 100.0 AS urgent_high_revenue_pct
  FROM orders),
r AS (SELECT CAST(count_if(n > 1) AS DOUBLE) / count(*) * 100.0 AS repeat_customer_pct FROM per)
SELECT 'revenue' AS section, 'total_revenue' AS metric, total_revenue AS value FROM k
UNION ALL SELECT 'volume', 'total_orders', total_orders FROM k
UNION ALL SELECT 'volume', 'unique_customers', unique_customers FROM k
UNION ALL SELECT 'revenue', 'avg_order_value', avg_order_value FROM k
UNION ALL SELECT 'loyalty', 'repeat_customer_pct', repeat_customer_pct FROM r
UNION ALL SELECT 'status', 'fulfilled_pct', fulfilled_pct FROM k
UNION ALL SELECT 'revenue', 'urgent_high_revenue_pct', urgent_high_revenue_pct FROM k
""")
def order_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """KPI block as a long table (A8, A9, A10, A7, S5): one pass per grain."""
    o = _orders(spark, sf)
    rev = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    sub = F.sum(F.when(urgent, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double")
    main = kpi_long(o, [
        ("revenue", "total_revenue", rev),
        ("volume", "total_orders", F.count(F.lit(1))),
        ("volume", "unique_customers", F.count_distinct("o_custkey")),
        ("revenue", "avg_order_value", rev / F.count(F.lit(1))),
        ("status", "fulfilled_pct", pct_true(F.col("o_orderstatus") == "F")),
        ("revenue", "urgent_high_revenue_pct", sub / rev * F.lit(100.0)),
    ])
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    repeat = kpi_long(per, [("loyalty", "repeat_customer_pct", pct_true(F.col("n") > 1))])
    return main.unionByName(repeat)


@query("monthly_revenue", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       strftime(o_orderdate, '%b %Y') AS month_label,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       count(*) AS orders
FROM orders GROUP BY 1, 2 ORDER BY 1
""")
def monthly_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue per month, ordered."""
    o = _orders(spark, sf)
    return (o.groupBy(month_start("o_orderdate").alias("month"),
                      month_label("o_orderdate").alias("month_label"))
            .agg(money_sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("orders"))
            .orderBy("month"))


@query("weekday_demand", """
SELECT dayname(o_orderdate) AS day_of_week, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_index,
       count(*) AS orders, isodow(o_orderdate) >= 6 AS is_weekend,
       dayname(o_orderdate) IN ('Friday', 'Saturday', 'Sunday') AS highlight
FROM orders GROUP BY 1, 2, 4, 5 ORDER BY day_index
""")
def weekday_demand(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per weekday in Monday-first order, weekend and emphasis flags."""
    o = _orders(spark, sf)
    g = o.groupBy(day_name("o_orderdate").alias("day_of_week"),
                  day_index("o_orderdate").alias("day_index"),
                  is_weekend("o_orderdate").alias("is_weekend")).agg(F.count(F.lit(1)).alias("orders"))
    return ordered_flag(g, "day_of_week", EMPHASIS_DAYS, "highlight").orderBy("day_index")


@query("clip_order_value", """
SELECT o_orderkey AS order_id, v AS order_value,
       CASE WHEN v IS NOT NULL THEN least(greatest(v, 50000.0), 400000.0) END AS order_value_clipped
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v FROM orders)
""")
def clip_order_value(spark: SparkSession, sf: str) -> DataFrame:
    """Clip to [50,000, 400,000] with nulls kept (C5); pending orders carry no value."""
    o = _orders(spark, sf)
    v = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("order_id"), v.alias("order_value")).withColumn(
        "order_value_clipped", clip("order_value", 50000.0, 400000.0))


@query("channel_churn_ratio", f"""
WITH {RFM_SQL},
ch AS (SELECT o_custkey AS customer_id, arg_min(o_orderpriority, o_orderkey) AS channel
       FROM orders GROUP BY o_custkey),
r AS (SELECT CAST(count_if(channel = '1-URGENT' AND segment = 'Churned') AS DOUBLE)
               / count_if(channel = '1-URGENT') * 100.0 AS a,
             CAST(count_if(channel = '5-LOW' AND segment = 'Churned') AS DOUBLE)
               / count_if(channel = '5-LOW') * 100.0 AS b
      FROM rfm JOIN ch USING (customer_id))
SELECT a AS urgent_churn_pct, b AS low_churn_pct, CASE WHEN b > 0 THEN a / b ELSE 0.0 END AS multiplier FROM r
""")
def channel_churn_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Churn rate of one channel over another's, guarded (A11 two-group ratio, X11)."""
    from insight.functions.expr import guarded_ratio

    o = _orders(spark, sf)
    rfm_df = R.rfm(o, "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    ch = R.first_touch(o, "o_custkey", "o_orderpriority", "o_orderkey", out_key="customer_id",
                       out_attr="channel")
    j = rfm_df.select("customer_id", "segment").join(ch, "customer_id", "inner")
    churned = F.col("segment") == R.SEGMENT_DEFAULT

    def rate(name):
        inch = F.col("channel") == name
        n = F.count_if(inch)
        return F.when(n > 0, F.count_if(inch & churned).cast("double") / n * F.lit(100.0))

    one = j.agg(rate("1-URGENT").alias("urgent_churn_pct"), rate("5-LOW").alias("low_churn_pct"))
    return one.withColumn("multiplier", guarded_ratio("urgent_churn_pct", "low_churn_pct", 0.0))
