"""Account analyses: lapse label, balance quartiles, cohort lift, rule score.

Binding: an account is a ``customer``; its order history gives recency,
frequency and monetary value; "lapsed" (the attrition-style label) is
recency at or above its 84th percentile; ``c_acctbal`` plays income and
``c_mktsegment`` the department.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.functions.expr import interval_bins, money, round_half_even, rule_score
from insight.functions.timeparts import whole_days_between
from insight.operators.ranking import label_top_share, rank_bins
from insight.operators.rfm import snapshot_after_last
from insight.operators.summarise import lift, mean_rate, pivot_agg, with_group_mean
from insight.plans.registry import query
from insight.sources.tables import read_table

# Fixed values that must equal the reference: income quartile names and
# band names (both from 4 rank bins), the attrition-style risk tier edges
# (right-closed, first bin open at 0) and tier names, and the 84th percentile
# that defines the positive label.
QUARTILE_LABELS = ["Q1 (Low)", "Q2", "Q3", "Q4 (High)"]
BAND_LABELS = ["Low", "Mid-Low", "Mid-High", "High"]
RISK_EDGES = [0.0, 0.30, 0.60, 1.0]
RISK_LABELS = ["Low Risk", "Medium Risk", "High Risk"]
LABEL_PERCENTILE = 84
# pivot column names for the bands
BAND_COLUMNS = ["low", "mid_low", "mid_high", "high"]


def order_history(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: recency (days to snapshot), frequency, monetary (exact)."""
    o = read_table(spark, sf, "orders")
    snap = snapshot_after_last(o, "o_orderdate")
    per = o.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.max("o_orderdate").alias("_last"), F.count("o_orderkey").alias("frequency"),
        F.sum(money("o_totalprice")).cast("double").alias("monetary"))
    return per.select("customer_id", whole_days_between("_last", snap).alias("recency"),
                      "frequency", "monetary")


def lapsed(spark: SparkSession, sf: str) -> DataFrame:
    return label_top_share(order_history(spark, sf), "recency", LABEL_PERCENTILE, out="lapsed")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with order history and the lapse label (inner: customers with orders)."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return c.join(lapsed(spark, sf), c.c_custkey == F.col("customer_id"), "inner").drop("customer_id")


HIST_SQL = """
hist AS (
  SELECT o_custkey AS customer_id,
         datesub('day', max(o_orderdate), (SELECT max(o_orderdate) + INTERVAL 1 DAY FROM orders)) AS recency,
         count(o_orderkey) AS frequency,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS monetary
  FROM orders GROUP BY o_custkey),
lap AS (
  SELECT *, CASE WHEN recency >= (SELECT quantile_cont(CAST(recency AS DOUBLE), 0.84) FROM hist) THEN 1 ELSE 0 END AS lapsed
  FROM hist),
acc AS (SELECT c.c_custkey, c.c_acctbal, c.c_mktsegment, lap.* EXCLUDE (customer_id)
        FROM customer c JOIN lap ON c.c_custkey = lap.customer_id),
binned AS (
  SELECT *, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ((r - 1) * 4 + n - 2) // (n - 1)) END AS INTEGER) AS qbin
  FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM acc))
"""


@query("lapsed_customer_label", f"WITH {HIST_SQL} SELECT customer_id, recency, lapsed FROM lap")
def lapsed_customer_label(spark: SparkSession, sf: str) -> DataFrame:
    """1 when recency is at or above its 84th percentile, else 0."""
    return lapsed(spark, sf).select("customer_id", "recency", "lapsed")


@query("balance_quartiles", f"""
WITH {HIST_SQL}
SELECT (['Q1 (Low)', 'Q2', 'Q3', 'Q4 (High)'])[qbin] AS quartile, count(*) AS customers,
       CAST(sum(lapsed) AS DOUBLE) / count(lapsed) * 100.0 AS lapsed_rate_pct
FROM binned GROUP BY qbin ORDER BY quartile
""")
def balance_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """Lapse rate by balance rank quartile, ties by customer key (B2, A2)."""
    a = rank_bins(accounts(spark, sf), "c_acctbal", 4, "c_custkey", labels=QUARTILE_LABELS,
                  out="quartile")
    return mean_rate(a, ["quartile"], "lapsed", out="lapsed_rate_pct",
                     count_col="customers").orderBy("quartile")


@query("segment_by_quartile_matrix", f"""
WITH {HIST_SQL}
SELECT c_mktsegment, """ + ", ".join(
    f"CAST(sum(CASE WHEN qbin = {i + 1} THEN lapsed END) AS DOUBLE) / count(CASE WHEN qbin = {i + 1} THEN lapsed END) * 100.0 AS {n}"
    for i, n in enumerate(BAND_COLUMNS)) + """
FROM binned GROUP BY c_mktsegment
""")
def segment_by_quartile_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Segment x balance band mean lapse rate, empty cells null."""
    a = rank_bins(accounts(spark, sf), "c_acctbal", 4, "c_custkey", labels=BAND_LABELS, out="band")
    rate = F.sum("lapsed").cast("double") / F.count("lapsed") * F.lit(100.0)
    return pivot_agg(a, ["c_mktsegment"], "band", BAND_LABELS, rate, names=BAND_COLUMNS)


COHORT = "(c_mktsegment = 'BUILDING') AND (c_acctbal <= 2500.0) AND (frequency < 10)"


@query("cohort_lift", f"""
WITH {HIST_SQL}
SELECT CAST(count_if({COHORT}) AS BIGINT) AS cohort_size, count(lapsed) AS population,
       CASE WHEN count_if({COHORT}) > 0
            THEN CAST(sum(CASE WHEN {COHORT} THEN lapsed END) AS DOUBLE) / count_if({COHORT}) * 100.0 END AS cohort_rate_pct,
       CAST(sum(lapsed) AS DOUBLE) / count(lapsed) * 100.0 AS baseline_rate_pct,
       CASE WHEN CAST(sum(lapsed) AS DOUBLE) / count(lapsed) * 100.0 > 0
            THEN (CAST(sum(CASE WHEN {COHORT} THEN lapsed END) AS DOUBLE) / count_if({COHORT}) * 100.0)
                 / (CAST(sum(lapsed) AS DOUBLE) / count(lapsed) * 100.0) ELSE 0.0 END AS lift
FROM acc
""")
def cohort_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Lapse rate of a compound-predicate cohort against the baseline."""
    pred = ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") <= 2500.0)
            & (F.col("frequency") < 10))
    return lift(accounts(spark, sf), pred, "lapsed")


@query("subset_share", f"""
WITH {HIST_SQL}
SELECT CAST(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN CAST(monetary AS DECIMAL(18,2)) END) AS DOUBLE)
         / CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) * 100.0 AS segment_set_revenue_pct,
       CAST(count_if(c_mktsegment IN ('BUILDING', 'MACHINERY')) AS DOUBLE) / count(*) * 100.0 AS segment_set_customer_pct
FROM acc
""")
def subset_share(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue and customer share of a named segment set."""
    a = accounts(spark, sf)
    inset = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    m = money("monetary")
    return a.agg(
        (F.sum(F.when(inset, m)).cast("double") / F.sum(m).cast("double") * F.lit(100.0)).alias("segment_set_revenue_pct"),
        (F.count_if(inset).cast("double") / F.count(F.lit(1)) * F.lit(100.0)).alias("segment_set_customer_pct"))


# Rule weights for the account risk score (a logistic rule like the
# reference's data generator: weighted sum, scaled, squashed).
RULE_WEIGHTS = {"recency": 0.004, "frequency": -0.08, "acctbal_k": -0.05}
RULE_BIAS, RULE_SCALE = 0.2, 0.5


@query("rule_score", f"""
WITH {HIST_SQL},
s AS (SELECT c_custkey AS customer_id,
             round_even(1.0 / (1.0 + exp(-((((0.2 + 0.004 * CAST(recency AS DOUBLE)) + -0.08 * CAST(frequency AS DOUBLE))
                                            + -0.05 * (c_acctbal / 1000.0)) * 0.5))) * 1e6, 0) / 1e6 AS risk_score
      FROM acc)
SELECT customer_id, risk_score,
       CASE WHEN risk_score > 0.0 AND risk_score <= 0.3 THEN 'Low Risk'
            WHEN risk_score > 0.3 AND risk_score <= 0.6 THEN 'Medium Risk'
            WHEN risk_score > 0.6 AND risk_score <= 1.0 THEN 'High Risk' END AS risk_tier
FROM s
""")
def rule_score_query(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic rule score per account and right-closed risk tiers."""
    a = accounts(spark, sf).withColumn("acctbal_k", F.col("c_acctbal") / F.lit(1000.0))
    s = a.select(F.col("c_custkey").alias("customer_id"),
                 round_half_even(rule_score(RULE_WEIGHTS, RULE_BIAS, RULE_SCALE), 6).alias("risk_score"))
    return s.withColumn("risk_tier", interval_bins("risk_score", RISK_EDGES, RISK_LABELS))


@query("lapse_by_segment", f"""
WITH {HIST_SQL},
r AS (SELECT c_mktsegment, count(*) AS customers,
             CAST(sum(lapsed) AS DOUBLE) / count(lapsed) * 100.0 AS lapsed_rate_pct
      FROM acc GROUP BY c_mktsegment)
SELECT *, round_even(avg(lapsed_rate_pct) OVER () * 1e6, 0) / 1e6 AS mean_rate,
       lapsed_rate_pct > avg(lapsed_rate_pct) OVER () AS above_mean
FROM r ORDER BY lapsed_rate_pct DESC, c_mktsegment
""")
def lapse_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Lapse rate per segment, highest first, against the mean of the rates."""
    r = mean_rate(accounts(spark, sf), ["c_mktsegment"], "lapsed", out="lapsed_rate_pct",
                  count_col="customers")
    return with_group_mean(r, "lapsed_rate_pct").orderBy(F.col("lapsed_rate_pct").desc(), "c_mktsegment")
