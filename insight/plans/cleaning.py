"""Profiling and cleaning queries on ``lineitem``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.operators import clean as C
from insight.plans.operations import delivery_events, unzoned_events
from insight.plans.registry import query
from insight.sources.tables import read_table

LINE_KEYS = ["l_orderkey", "l_linenumber"]
# lineitem has natural duplicate keys; the other columns give the keep-first order
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]

NULL_CELLS_SQL = "CAST(" + " + ".join(f"count_if({c} IS NULL)" for c in LINE_KEYS + LINE_ORDER) + " AS BIGINT)"


def _lineitem_with_copies(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.unionByName(li)  # C6: appended copies, as the reference injects them


@query("quality_profile", f"""
WITH raw AS (SELECT * FROM lineitem),
clean AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus, l_shipdate) AS rn FROM raw) WHERE rn = 1)
SELECT 'raw' AS stage, count(*) AS rows, CAST(11 AS BIGINT) AS columns, {NULL_CELLS_SQL} AS null_cells,
       count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_keys FROM raw
UNION ALL
SELECT 'clean', count(*), CAST(11 AS BIGINT), {NULL_CELLS_SQL},
       count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM clean
""")
def quality_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Row, null and duplicate-key profile before and after keep-first cleaning."""
    li = read_table(spark, sf, "lineitem")
    return C.profile(li, LINE_KEYS, "raw").unionByName(
        C.profile(C.dedupe(li, LINE_KEYS, LINE_ORDER), LINE_KEYS, "clean"))


@query("dedupe_lineitem", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
             l_returnflag, l_linestatus, l_shipdate) AS rn
  FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)) WHERE rn = 1
""")
def dedupe_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Keep the first row per (order, line) after appending copies."""
    return C.dedupe(_lineitem_with_copies(spark, sf), LINE_KEYS, LINE_ORDER)


DELIVERY_SQL = """
dl AS (
  SELECT e.event_id, n.n_name AS zone,
         CASE WHEN e.event_type = 'error' THEN NULL
              ELSE least(greatest(CAST(json_extract_string(e.props, '$.k') AS INTEGER), 10), 90) END AS delivery_min
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
"""


@query("impute_global", f"""
WITH {DELIVERY_SQL}
SELECT event_id, CAST(delivery_min AS DOUBLE) AS delivery_min,
       coalesce(CAST(delivery_min AS DOUBLE), (SELECT quantile_cont(delivery_min, 0.5) FROM dl)) AS delivery_min_filled
FROM dl
""")
def impute_global(spark: SparkSession, sf: str) -> DataFrame:
    """Fill missing delivery minutes with the global median."""
    d = unzoned_events(spark, sf).select("event_id", F.col("delivery_min").cast("double"))
    return C.impute_median(d, "delivery_min", out="delivery_min_filled")


@query("impute_by_group", f"""
WITH {DELIVERY_SQL},
med AS (SELECT zone, quantile_cont(delivery_min, 0.5) AS m FROM dl WHERE delivery_min IS NOT NULL GROUP BY zone)
SELECT event_id, dl.zone, CAST(delivery_min AS DOUBLE) AS delivery_min,
       coalesce(CAST(delivery_min AS DOUBLE), med.m) AS delivery_min_filled
FROM dl LEFT JOIN med ON dl.zone = med.zone
""")
def impute_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """Fill missing delivery minutes with the zone median."""
    d = delivery_events(spark, sf).select("event_id", "zone", F.col("delivery_min").cast("double"))
    return C.impute_median(d, "delivery_min", by=["zone"], out="delivery_min_filled")


def _describe_sql(table: str, col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    r = lambda e: f"round_even(({e}) * 100.0, 0) / 100.0"
    return (f"SELECT '{col}' AS column_name, CAST(count({x}) AS DOUBLE) AS count, {r(f'avg({x})')} AS mean, "
            f"{r(f'stddev_samp({x})')} AS std, {r(f'min({x})')} AS min, "
            f"{r(f'quantile_cont({x}, 0.25)')} AS p25, {r(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{r(f'quantile_cont({x}, 0.75)')} AS p75, {r(f'max({x})')} AS max FROM {table}")


@query("describe_orders", " UNION ALL ".join([
    _describe_sql("orders", "o_totalprice"),
    _describe_sql("lineitem", "l_quantity"),
    _describe_sql("lineitem", "l_extendedprice"),
    _describe_sql("lineitem", "l_discount"),
]))
def describe_orders(spark: SparkSession, sf: str) -> DataFrame:
    """``describe().round(2)`` of order value and line measures."""
    o = read_table(spark, sf, "orders")
    li = read_table(spark, sf, "lineitem")
    return C.describe(o, ["o_totalprice"]).unionByName(
        C.describe(li, ["l_quantity", "l_extendedprice", "l_discount"]))
