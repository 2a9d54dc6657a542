"""Report queries: the demand forecast on the cleaned deliveries, exact ranks and AUC of order values,
flags and shares of the account report.

The forecast's oracle solves the normal equations in SQL: covariances in one aggregate, then one common table
expression per elimination step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.functions.expr import clip, guarded_ratio, interval_bins, money_sum, round_half_even, rule_score
from insight.operators import metrics as M
from insight.operators import models as ML
from insight.operators import sampling as D
from insight.operators.ranking import global_rank
from insight.operators.summarise import mean_rate, ordered_flag, top_k_flag
from insight.plans.accounts import HIST_SQL, RISK_EDGES, RISK_LABELS, RULE_BIAS, RULE_SCALE, RULE_WEIGHTS, accounts
from insight.plans.documents import SEED
from insight.plans.operations import ZONE_SQL, clean_deliveries
from insight.plans.registry import query
from insight.session import materialize
from insight.sources.sinks import kpi_table
from insight.sources.tables import read_table

FORECAST_FEATURES = ["hour_f", "weekend_f", "avg_value", "avg_del_time"]
# Fixed values that must equal the reference: the clip of order values on the
# cleaned table, and the rate above which a level is highlighted.
VALUE_EDGES = (80.0, 3000.0)
HIGHLIGHT_RATE = 20.0
# The balance below which the account report states the risk ratio.
LOW_BALANCE = 1000.0


def solve_sql(source: str, n: int, out: str = "ols") -> str:
    """CTEs that solve the symmetric n x n system in ``source`` (columns ``a{i}_{j}``, right side ``a{i}_{n}``): ``out``
    has the solution as ``b{i}``."""
    steps, before = [], source
    for k in range(n):
        cells = [f"a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}"
                 for i in range(n) for j in range(n + 1)]
        steps.append(f"{out}_step{k} AS MATERIALIZED (SELECT {', '.join(cells)} FROM {before})")
        before = f"{out}_step{k}"
    steps.append(f"{out} AS (SELECT {', '.join(f'a{i}_{n} / a{i}_{i} AS b{i}' for i in range(n))} FROM {before})")
    return ",\n".join(steps)


_COLUMNS = [*FORECAST_FEATURES, "order_count_f"]
FORECAST_SQL = f"""
WITH {ZONE_SQL},
first AS (SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, user_id, event_type, value) AS rn
            FROM dl) WHERE rn = 1),
med AS (SELECT zone, quantile_cont(delivery_min, 0.5) AS m FROM first WHERE delivery_min IS NOT NULL GROUP BY zone),
cells AS (
  SELECT f.zone, hour, is_weekend, count(event_id) AS order_count,
         CAST(sum(CAST(least(greatest(value, {VALUE_EDGES[0]}), {VALUE_EDGES[1]}) AS DECIMAL(18,2))) AS DOUBLE) / count(event_id) AS avg_value,
         avg(coalesce(CAST(delivery_min AS DOUBLE), med.m)) AS avg_del_time
  FROM first f LEFT JOIN med ON f.zone = med.zone GROUP BY f.zone, hour, is_weekend),
keyed AS (SELECT *, concat_ws('|', zone, CAST(hour AS VARCHAR), CAST(is_weekend AS VARCHAR)) AS cell,
                 CAST(hour AS DOUBLE) AS hour_f, CAST(is_weekend AS INTEGER)::DOUBLE AS weekend_f,
                 CAST(order_count AS DOUBLE) AS order_count_f FROM cells),
parts AS (SELECT *, row_number() OVER (ORDER BY md5(cell || ':{SEED}'), cell) <= ceil(count(*) OVER () * 0.2) AS is_test FROM keyed),
cov AS (SELECT {', '.join(f'covar_pop({a}, {b}) AS a{i}_{j}' for i, a in enumerate(FORECAST_FEATURES) for j, b in enumerate(_COLUMNS))}
        FROM parts WHERE NOT is_test),
means AS (SELECT {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(_COLUMNS))} FROM parts WHERE NOT is_test),
{solve_sql('cov', len(FORECAST_FEATURES))},
scored AS (SELECT zone, hour, is_weekend, order_count, is_test,
                  m{len(FORECAST_FEATURES)} + {' + '.join(f'b{i} * ({c} - m{i})' for i, c in enumerate(FORECAST_FEATURES))} AS prediction
           FROM parts, ols, means)
"""


def demand_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Demand cells (zone, hour, weekend) of the cleaned deliveries, an 80/20 split and the OLS prediction of each."""
    d = clean_deliveries(spark, sf).withColumn("value", clip("value", *VALUE_EDGES))
    g = d.groupBy("zone", "hour", "is_weekend").agg(
        F.count("event_id").alias("order_count"), money_sum("value").alias("_rev"),
        F.avg("delivery_min").alias("avg_del_time"))
    cell = F.concat_ws("|", "zone", F.col("hour").cast("string"), F.col("is_weekend").cast("string"))
    f = g.select("zone", "hour", "is_weekend", "order_count", "avg_del_time", cell.alias("cell"),
                 (F.col("_rev") / F.col("order_count")).alias("avg_value"), F.col("hour").cast("double").alias("hour_f"),
                 F.col("is_weekend").cast("double").alias("weekend_f"), F.col("order_count").cast("double").alias("order_count_f"))
    f = materialize(D.split(materialize(f), "cell", 0.2, SEED))
    return ML.score(ML.fit_linear(f.where(~F.col("is_test")), FORECAST_FEATURES, "order_count_f"), f)


@query("forecast_linear", FORECAST_SQL + """
SELECT zone, hour, is_weekend, order_count, is_test, round_even(prediction * 1e6, 0) / 1e6 AS prediction FROM scored
""")
def forecast_linear(spark: SparkSession, sf: str) -> DataFrame:
    """OLS demand forecast per (zone, hour, weekend) on an 80/20 split (M2, M4, M10); every cell is kept."""
    return demand_forecast(spark, sf).select("zone", "hour", "is_weekend", "order_count", "is_test",
                                             round_half_even("prediction", 6).alias("prediction"))


@query("forecast_fit_metrics", FORECAST_SQL + """,
y AS (SELECT CAST(order_count AS DOUBLE) AS y, prediction AS p FROM scored WHERE is_test),
m AS (SELECT 1.0 - sum((y - p) * (y - p)) / sum((y - (SELECT avg(y) FROM y)) * (y - (SELECT avg(y) FROM y))) AS r2,
             avg(abs(y - p)) AS mae, count(*) AS n, least(min(y), min(p)) AS lo, greatest(max(y), max(p)) AS hi FROM y)
SELECT round_even(r2 * 1e6, 0) / 1e6 AS r2, round_even(mae * 1e6, 0) / 1e6 AS mae, n,
       round_even(lo * 1e6, 0) / 1e6 AS lo, round_even(hi * 1e6, 0) / 1e6 AS hi FROM m
""")
def forecast_fit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """R2, MAE and plot bounds of the fitted forecast on its test cells."""
    return M.regression_metrics(demand_forecast(spark, sf).where("is_test"), "order_count", "prediction")


@query("global_rank_orders", """
SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
""")
def global_rank_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Unique rank of all orders by value, highest first, on rows with further columns."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return global_rank(o, "o_totalprice", "o_orderkey", ascending=False)


@query("auc_orders", """
WITH o AS (SELECT o_totalprice AS score, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label FROM orders),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM o),
s AS (SELECT sum(CASE WHEN label = 1 THEN ar END) AS rp, CAST(count_if(label = 1) AS BIGINT) AS p,
             CAST(count_if(label <> 1) AS BIGINT) AS n FROM r)
SELECT CASE WHEN p > 0 AND n > 0 THEN (2 * rp - p * (p + 1)) / (2.0 * p * n) END AS auc, p AS positives, n AS negatives FROM s
""")
def auc_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Exact AUC of the order value for urgency: nearly as many scores as rows."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    o = read_table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.when(urgent, 1).otherwise(0).alias("label"))
    return M.auc_exact(o, "label", "o_totalprice")


@query("segment_flags", f"""
WITH {HIST_SQL},
r AS (SELECT c_mktsegment, CAST(sum(lapsed) AS DOUBLE) / count(lapsed) * 100.0 AS lapsed_rate_pct FROM acc
      WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)
SELECT *, lapsed_rate_pct > {HIGHLIGHT_RATE} AS high_rate, lapsed_rate_pct = max(lapsed_rate_pct) OVER () AS equals_top,
       row_number() OVER (ORDER BY lapsed_rate_pct DESC, c_mktsegment) <= 2 AS top_two, c_mktsegment IN ('BUILDING') AS named
FROM r
""")
def segment_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Highlights of the lapse rates per segment: above a rate, equal to the top, the first two, a named segment."""
    r = materialize(mean_rate(accounts(spark, sf), ["c_mktsegment"], "lapsed", out="lapsed_rate_pct").drop("n"))
    r = r.withColumn("high_rate", F.col("lapsed_rate_pct") > HIGHLIGHT_RATE)
    r = r.withColumn("equals_top", F.col("lapsed_rate_pct") == r.select(F.max("lapsed_rate_pct")).scalar())
    return ordered_flag(top_k_flag(r, "lapsed_rate_pct", "c_mktsegment", 2, "top_two"), "c_mktsegment", ["BUILDING"], "named")


@query("low_balance_ratio", f"""
WITH {HIST_SQL}
SELECT CAST(sum(CASE WHEN c_acctbal < {LOW_BALANCE} THEN lapsed END) AS DOUBLE) / count(CASE WHEN c_acctbal < {LOW_BALANCE} THEN lapsed END) AS below_rate,
       CAST(sum(lapsed) AS DOUBLE) / count(lapsed) AS overall_rate,
       (CAST(sum(CASE WHEN c_acctbal < {LOW_BALANCE} THEN lapsed END) AS DOUBLE) / count(CASE WHEN c_acctbal < {LOW_BALANCE} THEN lapsed END))
         / (CAST(sum(lapsed) AS DOUBLE) / count(lapsed)) AS ratio
FROM acc
""")
def low_balance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """How much likelier accounts below a balance are to lapse than all accounts."""
    low = F.when(F.col("c_acctbal") < LOW_BALANCE, F.col("lapsed"))
    one = accounts(spark, sf).agg((F.sum(low).cast("double") / F.count(low)).alias("below_rate"),
                                  (F.sum("lapsed").cast("double") / F.count("lapsed")).alias("overall_rate"))
    return one.withColumn("ratio", guarded_ratio("below_rate", "overall_rate", None))


# Market segments in sorted order (fixed values of the table); the first is the dropped level.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot_segments", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS segment_{s.lower()}" for s in SEGMENTS[1:]) + " FROM customer")
def one_hot_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Indicator columns of the segment, first level dropped; an unknown or null level has none set (M2)."""
    c = read_table(spark, sf, "customer")
    return c.select("c_custkey", *[F.when(F.col("c_mktsegment") == s, 1.0).otherwise(0.0).alias(f"segment_{s.lower()}") for s in SEGMENTS[1:]])


_TIER = "CAST(count_if(score > {0} AND score <= {1}) AS DOUBLE)"


@query("account_kpis", f"""
WITH {HIST_SQL},
s AS (SELECT *, round_even(1.0 / (1.0 + exp(-((((0.2 + 0.004 * CAST(recency AS DOUBLE)) + -0.08 * CAST(frequency AS DOUBLE))
                                              + -0.05 * (c_acctbal / 1000.0)) * 0.5))) * 1e6, 0) / 1e6 AS score FROM acc),
k AS (SELECT CAST(count(*) AS DOUBLE) AS accounts, CAST(sum(lapsed) AS DOUBLE) AS lapsed,
             CAST(sum(lapsed) AS DOUBLE) / count(lapsed) * 100.0 AS rate, CAST(count(DISTINCT c_mktsegment) AS DOUBLE) AS segments,
             {', '.join(_TIER.format(lo, hi) + f' AS t{i}' for i, (lo, hi) in enumerate(zip(RISK_EDGES, RISK_EDGES[1:])))} FROM s)
SELECT 'population' AS section, 'accounts' AS metric, accounts AS value FROM k
UNION ALL SELECT 'population', 'segments', segments FROM k
UNION ALL SELECT 'label', 'lapsed', lapsed FROM k
UNION ALL SELECT 'label', 'lapsed_rate_pct', rate FROM k
""" + "".join(f"UNION ALL SELECT 'tiers', '{t}', t{i} FROM k\n" for i, t in enumerate(RISK_LABELS)))
def account_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of the account report: label count and rate, segments, accounts per risk tier."""
    a = accounts(spark, sf).withColumn("acctbal_k", F.col("c_acctbal") / F.lit(1000.0))
    a = a.withColumn("tier", interval_bins(round_half_even(rule_score(RULE_WEIGHTS, RULE_BIAS, RULE_SCALE), 6), RISK_EDGES, RISK_LABELS))
    return kpi_table(a, [
        ("population", "accounts", F.count(F.lit(1))),
        ("population", "segments", F.count_distinct("c_mktsegment")),
        ("label", "lapsed", F.sum("lapsed")),
        ("label", "lapsed_rate_pct", F.sum("lapsed").cast("double") / F.count("lapsed") * F.lit(100.0)),
        *[("tiers", t, F.count_if(F.col("tier") == t)) for t in RISK_LABELS],
    ])
