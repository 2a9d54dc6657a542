"""Operations analyses on ``events``: demand by time and zone, error rates,
entity scorecards and the zone-hour demand table.

Binding: an event is an order; ``ts`` its time, ``value`` its value, type
``error`` a cancellation; the zone is the customer's nation (``user_id =
c_custkey``); delivery minutes are ``props.k`` clipped to 10..90 (none for
errors); the rating is ``1 + event_id % 5``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.functions.expr import clip, guarded_ratio, money_sum
from insight.functions.timeparts import hour_of_day, in_hour_window, is_weekend
from insight.operators import scorecard as S
from insight.operators.summarise import arg_max, pivot_agg, rate_by
from insight.operators.sketches import distinct_cells, estimated, union_cells
from insight.plans.registry import query
from insight.session import materialize
from insight.sources.tables import read_table

HOURS = list(range(24))
HOUR_NAMES = [f"h{h:02d}" for h in HOURS]

# Fixed values that must equal the reference: the peak window is hours 19 to
# 22 inclusive; the weekend/weekday ratio is scaled by 7/5 as published, and
# by 5/2 for the per-day reading.
PEAK_FIRST_HOUR, PEAK_LAST_HOUR = 19, 22
RATIO_REFERENCE = (7.0, 5.0)
RATIO_PER_DAY = (5.0, 2.0)


def unzoned_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with hour, weekend flag, delivery minutes and rating; reads ``events`` alone."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return read_table(spark, sf, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        hour_of_day("ts").alias("hour"), is_weekend("ts").alias("is_weekend"),
        F.when(F.col("event_type") != "error", clip(k, 10, 90)).alias("delivery_min"),
        (F.lit(1) + F.col("event_id") % 5).cast("int").alias("rating"),
    )


def delivery_events(spark: SparkSession, sf: str) -> DataFrame:
    """``unzoned_events`` with the zone: the nation of the customer, none if unknown.

    Customers get their zone before they meet the events, so the events are
    joined once; how is left to the planner and AQE.
    """
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("zone"))
    zones = c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "zone")
    e = unzoned_events(spark, sf)
    return e.join(zones, e.user_id == zones.c_custkey, "left").drop("c_custkey")


@query("weekend_ratio", """
WITH c AS (SELECT count_if(isodow(ts) >= 6) AS w, count_if(isodow(ts) < 6) AS d FROM events)
SELECT CAST(w AS BIGINT) AS weekend_events, CAST(d AS BIGINT) AS weekday_events,
       CASE WHEN d > 0 THEN CAST(w AS DOUBLE) / d * 7.0 / 5.0 END AS ratio_reference,
       CASE WHEN d > 0 THEN CAST(w AS DOUBLE) / d * 5.0 / 2.0 END AS ratio_per_day
FROM c
""")
def weekend_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Weekend against weekday volume (A12), both normalisations.

    ``ratio_reference`` multiplies by 7/5 as the reference does (F9);
    ``ratio_per_day`` uses the per-day factor 5/2.
    """
    e = read_table(spark, sf, "events")
    c = e.agg(F.count_if(is_weekend("ts")).alias("weekend_events"),
              F.count_if(~is_weekend("ts")).alias("weekday_events"))
    r = guarded_ratio("weekend_events", "weekday_events", None)
    return c.select("*", (r * F.lit(RATIO_REFERENCE[0]) / F.lit(RATIO_REFERENCE[1])).alias("ratio_reference"),
                    (r * F.lit(RATIO_PER_DAY[0]) / F.lit(RATIO_PER_DAY[1])).alias("ratio_per_day"))


HOURLY_SQL = """
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_value,
       hour(ts) BETWEEN 19 AND 22 AS is_peak
FROM events GROUP BY hour(ts)
"""


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    g = e.groupBy(hour_of_day("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), money_sum("value").alias("_rev"))
    return g.select("hour", "events", (F.col("_rev") / F.col("events")).alias("avg_value"),
                    in_hour_window("hour", PEAK_FIRST_HOUR, PEAK_LAST_HOUR).alias("is_peak"))


@query("hourly_demand", HOURLY_SQL + " ORDER BY hour")
def hourly_demand(spark: SparkSession, sf: str) -> DataFrame:
    """Events and mean value per hour of day, with the peak-window flag."""
    return _hourly(spark, sf).orderBy("hour")


@query("peak_hour", f"SELECT hour, events FROM ({HOURLY_SQL}) ORDER BY events DESC, hour LIMIT 1")
def peak_hour(spark: SparkSession, sf: str) -> DataFrame:
    """The busiest hour, ties to the earliest hour."""
    return arg_max(_hourly(spark, sf).select("hour", "events"), "events", "hour")


ZONE_SQL = """
dl AS (
  SELECT e.*, n.n_name AS zone, CAST(hour(e.ts) AS INTEGER) AS hour, isodow(e.ts) >= 6 AS is_weekend,
         CASE WHEN e.event_type = 'error' THEN NULL
              ELSE least(greatest(CAST(json_extract_string(e.props, '$.k') AS INTEGER), 10), 90) END AS delivery_min,
         CAST(1 + e.event_id % 5 AS INTEGER) AS rating
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
"""


@query("zone_hour_matrix", f"WITH {ZONE_SQL} SELECT zone, " + ", ".join(
    f"CAST(count_if(hour = {h}) AS BIGINT) AS {n}" for h, n in zip(HOURS, HOUR_NAMES)) + " FROM dl GROUP BY zone")
def zone_hour_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Zone x hour event counts, missing cells 0."""
    d = delivery_events(spark, sf)
    return pivot_agg(d, ["zone"], "hour", HOURS, F.count(F.lit(1)), names=HOUR_NAMES, fill=0)


# an estimate may differ from the exact count by three standard errors of the sketch
SKETCH_BOUND = 0.05


@query("distinct_users_rollup", f"""
WITH {ZONE_SQL}
SELECT CAST(grouping(zone, hour) AS BIGINT) AS level, zone, hour, count(*) AS events, count(DISTINCT user_id) AS users, TRUE AS estimate_within_bound
FROM dl GROUP BY ROLLUP (zone, hour)
""")
def distinct_users_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users by zone and hour, zone, and in all: exact, and from sketches stored per cell.

    ``level`` is 0 for cells, 1 for zones, 3 for the total; ``estimate_within_bound`` says that the estimate lies
    within 5 % of the exact count."""
    d = delivery_events(spark, sf).select("zone", "hour", "user_id")
    cells = materialize(distinct_cells(d, ["zone", "hour"], "user_id"))
    levels = [(0, ["zone", "hour"]), (1, ["zone"]), (3, [])]
    parts = [estimated(union_cells(cells, keys)).select(
        F.lit(level).cast("long").alias("level"), *[F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in (("zone", "string"), ("hour", "int"))],
        F.col("rows").alias("events"), "distinct_estimate") for level, keys in levels]
    estimates = reduce(DataFrame.unionByName, parts)
    exact = d.distinct().rollup("zone", "hour").agg(F.grouping_id().alias("level"), F.count_distinct("user_id").alias("users"))
    off = F.abs(F.col("distinct_estimate") - F.col("users")) <= F.lit(SKETCH_BOUND) * F.col("users")
    same = (exact.level == estimates.level) & exact.zone.eqNullSafe(estimates.zone) & exact.hour.eqNullSafe(estimates.hour)
    return estimates.join(exact, same).select(estimates.level, estimates.zone, estimates.hour, "events", "users", off.alias("estimate_within_bound"))


ERROR_SQL = f"""
WITH {ZONE_SQL}
SELECT zone, count(*) AS events, CAST(count_if(event_type = 'error') AS BIGINT) AS errors,
       CAST(count_if(event_type = 'error') AS DOUBLE) / count(*) * 100.0 AS error_rate_pct
FROM dl GROUP BY zone
"""


def _error_rates(spark: SparkSession, sf: str) -> DataFrame:
    d = delivery_events(spark, sf)
    return rate_by(d, ["zone"], F.col("event_type") == "error", out="error_rate_pct",
                   count_col="events", hits_col="errors")


@query("error_rate_by_zone", ERROR_SQL + " ORDER BY error_rate_pct DESC, zone")
def error_rate_by_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Cancellation (error) rate per zone, highest first."""
    return _error_rates(spark, sf).orderBy(F.col("error_rate_pct").desc(), "zone")


@query("worst_zone", f"SELECT * FROM ({ERROR_SQL}) ORDER BY error_rate_pct DESC, zone LIMIT 1")
def worst_zone(spark: SparkSession, sf: str) -> DataFrame:
    """The zone with the highest error rate (T5)."""
    return _error_rates(spark, sf).orderBy(F.col("error_rate_pct").desc(), "zone").limit(1)


SCORECARD_SQL = f"""
WITH {ZONE_SQL},
per AS (
  SELECT user_id, count(event_id) AS total_orders, avg(rating) AS avg_rating,
         avg(delivery_min) AS avg_del_time,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
         CAST(count_if(event_type = 'error') AS DOUBLE) / count(*) * 100.0 AS cancel_rate
  FROM dl GROUP BY user_id),
scored AS (
  SELECT *, round_even(((avg_rating / 5.0) * 40.0
            + (CASE WHEN (90.0 - avg_del_time) / 80.0 IS NOT NULL
                    THEN least(greatest((90.0 - avg_del_time) / 80.0, 0.0), 1.0) END) * 30.0
            + (1.0 - cancel_rate / 100.0) * 30.0) * 100.0, 0) / 100.0 AS performance_score
  FROM per),
edges AS (SELECT quantile_cont(performance_score, [1.0/3, 2.0/3]) AS e FROM scored),
tiered AS (
  SELECT scored.*, CASE WHEN performance_score IS NULL THEN NULL
    ELSE (['Underperforming', 'Average', 'Top Performer'])[1 + CAST(performance_score > e[1] AS INTEGER)
                                                           + CAST(performance_score > e[2] AS INTEGER)] END AS tier
  FROM scored, edges)
"""


def _scorecard(spark: SparkSession, sf: str) -> DataFrame:
    d = unzoned_events(spark, sf)  # the score needs no zone: aggregated per user straight from the scan
    return S.delivery_scorecard(d, "user_id", "event_id", "rating", "delivery_min", "value",
                                F.col("event_type") == "error")


@query("entity_scorecard", SCORECARD_SQL + " SELECT * FROM tiered")
def entity_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Per-user delivery scorecard with three value-quantile tiers."""
    return _scorecard(spark, sf)


@query("scorecard_tiers", SCORECARD_SQL + """
SELECT tier, count(*) AS entities, round_even(avg(performance_score) * 1e6, 0) / 1e6 AS avg_score,
       min(performance_score) AS min_score, max(performance_score) AS max_score,
       CAST(list_position(['Underperforming', 'Average', 'Top Performer'], tier) AS INTEGER) AS tier_order
FROM tiered WHERE tier IS NOT NULL GROUP BY tier ORDER BY tier_order
""")
def scorecard_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Entities and mean score per tier."""
    return S.tier_summary(_scorecard(spark, sf))


FEATURES_SQL = f"""
WITH {ZONE_SQL}
SELECT zone, hour, is_weekend, count(event_id) AS order_count,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_value,
       avg(delivery_min) AS avg_del_time
FROM dl GROUP BY zone, hour, is_weekend
"""


def zone_hour_table(spark: SparkSession, sf: str) -> DataFrame:
    d = delivery_events(spark, sf)
    g = d.groupBy("zone", "hour", "is_weekend").agg(
        F.count("event_id").alias("order_count"), money_sum("value").alias("_rev"),
        F.avg("delivery_min").alias("avg_del_time"))
    return g.select("zone", "hour", "is_weekend", "order_count",
                    (F.col("_rev") / F.col("order_count")).alias("avg_value"), "avg_del_time")


@query("zone_hour_features", FEATURES_SQL)
def zone_hour_features(spark: SparkSession, sf: str) -> DataFrame:
    """Demand per (zone, hour, weekend) with mean value and delivery time (A1)."""
    return zone_hour_table(spark, sf)


@query("forecast_metrics", f"""
WITH f AS ({FEATURES_SQL}),
p AS (SELECT *, avg(order_count) OVER (PARTITION BY zone) AS prediction FROM f),
m AS (SELECT 1.0 - sum((order_count - prediction) * (order_count - prediction))
                 / sum((order_count - (SELECT avg(order_count) FROM p)) * (order_count - (SELECT avg(order_count) FROM p))) AS r2,
             avg(abs(order_count - prediction)) AS mae, count(*) AS n,
             least(min(order_count), min(prediction)) AS lo, greatest(max(order_count), max(prediction)) AS hi
      FROM p)
SELECT round_even(r2 * 1e6, 0) / 1e6 AS r2, round_even(mae * 1e6, 0) / 1e6 AS mae, n,
       round_even(lo * 1e6, 0) / 1e6 AS lo, round_even(hi * 1e6, 0) / 1e6 AS hi FROM m
""")
def forecast_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """R2, MAE and common plot bounds of a zone-mean forecast."""
    from insight.operators.metrics import regression_metrics

    f = zone_hour_table(spark, sf)
    zone_mean = f.groupBy("zone").agg(F.avg("order_count").alias("prediction"))
    p = f.join(zone_mean, "zone", "inner")
    return regression_metrics(p, "order_count", "prediction")


@query("delivery_kpis", f"""
WITH {ZONE_SQL},
k AS (
  SELECT CAST(count(*) AS DOUBLE) AS total_orders,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_order_value,
         avg(delivery_min) AS avg_delivery_min,
         avg(rating) AS avg_rating,
         CAST(count_if(event_type = 'error') AS DOUBLE) / count(*) * 100.0 AS cancelled_pct,
         CAST(count(DISTINCT zone) AS DOUBLE) AS zones,
         CAST(count(DISTINCT user_id) AS DOUBLE) AS entities
  FROM dl)
SELECT 'volume' AS section, 'total_orders' AS metric, total_orders AS value FROM k
UNION ALL SELECT 'revenue', 'total_revenue', total_revenue FROM k
UNION ALL SELECT 'revenue', 'avg_order_value', avg_order_value FROM k
UNION ALL SELECT 'service', 'avg_delivery_min', avg_delivery_min FROM k
UNION ALL SELECT 'service', 'avg_rating', avg_rating FROM k
UNION ALL SELECT 'service', 'cancelled_pct', cancelled_pct FROM k
UNION ALL SELECT 'coverage', 'zones', zones FROM k
UNION ALL SELECT 'coverage', 'entities', entities FROM k
""")
def delivery_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """Delivery report numbers as one aggregate pass, long form."""
    from insight.functions.expr import pct_true
    from insight.sources.sinks import kpi_table

    d = delivery_events(spark, sf)
    rev = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return kpi_table(d, [
        ("volume", "total_orders", F.count(F.lit(1))),
        ("revenue", "total_revenue", rev),
        ("revenue", "avg_order_value", rev / F.count(F.lit(1))),
        ("service", "avg_delivery_min", F.avg("delivery_min")),
        ("service", "avg_rating", F.avg("rating")),
        ("service", "cancelled_pct", pct_true(F.col("event_type") == "error")),
        ("coverage", "zones", F.count_distinct("zone")),
        ("coverage", "entities", F.count_distinct("user_id")),
    ])


@query("clean_deliveries", f"""
WITH {ZONE_SQL},
first AS (SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, user_id, event_type, value) AS rn
            FROM dl) WHERE rn = 1),
med AS (SELECT zone, quantile_cont(delivery_min, 0.5) AS m FROM first WHERE delivery_min IS NOT NULL GROUP BY zone)
SELECT event_id, f.zone, ts, value, coalesce(CAST(delivery_min AS DOUBLE), med.m) AS delivery_min,
       rating, hour, dayname(ts) AS day_of_week, CAST(date_trunc('month', ts) AS DATE) AS month,
       is_weekend, hour BETWEEN {PEAK_FIRST_HOUR} AND {PEAK_LAST_HOUR} AS is_peak
FROM first f LEFT JOIN med ON f.zone = med.zone
""")
def clean_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned delivery table (C2, C4, C9, X1-X6): keep-first per event, zone-median
    minutes, time features added in place; the table a cleaned-table sink (S2) writes."""
    from insight.functions.timeparts import day_name, month_start
    from insight.operators.clean import dedupe, impute_median

    d = delivery_events(spark, sf).select("event_id", "zone", "ts", "user_id", "event_type", "value",
                                          "delivery_min", "rating", "hour", "is_weekend")
    d = dedupe(d, ["event_id"], ["ts", "user_id", "event_type", "value"])
    d = impute_median(d, "delivery_min", by=["zone"])
    return d.withColumns({
        "day_of_week": day_name("ts"),
        "month": month_start("ts"),
        "is_peak": in_hour_window("hour", PEAK_FIRST_HOUR, PEAK_LAST_HOUR),
    }).select("event_id", "zone", "ts", "value", "delivery_min", "rating", "hour", "day_of_week",
              "month", "is_weekend", "is_peak")
