"""Sales analyses over the line-item star: revenue by category and nation.

Binding: category = ``p_type``, city = the ordering customer's nation,
revenue = exact net line revenue ``l_extendedprice * (1 - l_discount)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insight.functions.expr import round_half_even
from insight.operators.summarise import rates_long, top_k
from insight.plans.registry import query
from insight.sources.tables import read_table

# The part-type domain of the driver tables (pivot columns are fixed up front,
# which also keeps unseen types as zero columns).
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def net_revenue(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """Exact decimal net revenue of a line (summing it is order-free)."""
    return F.col(price).cast("decimal(18,2)") * (F.lit(1) - F.col(discount).cast("decimal(4,2)"))


REV_SQL = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def _lines_with_type(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice",
                                                  "l_discount", "l_returnflag")
    p = read_table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey, "inner")


@query("category_revenue", f"""
WITH g AS (SELECT p_type AS category, CAST(sum({REV_SQL}) AS DOUBLE) AS revenue, count(*) AS lines
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)
SELECT *, row_number() OVER (ORDER BY revenue DESC, category) <= 3 AS top3 FROM g ORDER BY revenue
""")
def category_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Net revenue per category, ascending, with the top-3 flag.

    Lines are summed per part before they meet ``part``: the partial sums
    collapse a hot part map-side, and one row per part is joined.
    """
    per_part = read_table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum(net_revenue()).alias("rev"), F.count(F.lit(1)).alias("n"))
    p = read_table(spark, sf, "part").select("p_partkey", "p_type")
    g = per_part.join(p, per_part.l_partkey == p.p_partkey, "inner").groupBy(F.col("p_type").alias("category")).agg(
        F.sum("rev").cast("double").alias("revenue"), F.sum("n").alias("lines"))
    # one row per category (the part-type domain): rank the grouped frame
    rank = F.row_number().over(Window.orderBy(F.col("revenue").desc(), "category"))
    return g.withColumn("top3", rank <= 3).orderBy("revenue")


@query("nation_category_matrix", f"""
SELECT n_name AS nation, """ + ", ".join(
    f"coalesce(CAST(sum(CASE WHEN p_type = '{c}' THEN {REV_SQL} END) AS DOUBLE), 0.0) AS {c}"
    for c in CATEGORIES) + """
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name
""")
def nation_category_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Nation x category net revenue, missing cells 0.

    Lines collapse to one row of category sums per order, partly before
    their only shuffle; the layout by order key also serves the join with
    ``orders``.  The sums of orders then collapse per customer before
    ``customer`` is joined, so a hot customer is no single task's.
    """
    lt = _lines_with_type(spark, sf)
    per_order = lt.groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("p_type") == c, net_revenue())).alias(c) for c in CATEGORIES])
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_customer = per_order.join(o, per_order.l_orderkey == o.o_orderkey, "inner").groupBy("o_custkey").agg(
        *[F.sum(c).alias(c) for c in CATEGORIES])
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    homes = c.join(n, c.c_nationkey == n.n_nationkey, "inner").select("c_custkey", "nation")
    j = per_customer.join(homes, per_customer.o_custkey == homes.c_custkey, "inner")
    return j.groupBy("nation").agg(
        *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in CATEGORIES])


@query("top_categories", f"""
SELECT p_brand AS brand, CAST(sum({REV_SQL}) AS DOUBLE) AS revenue, count(*) AS lines
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'
GROUP BY p_brand ORDER BY revenue DESC, brand LIMIT 5
""")
def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Top-5 brands by net revenue of returned lines."""
    lt = _lines_with_type(spark, sf).where(F.col("l_returnflag") == "R")
    g = lt.groupBy(F.col("p_brand").alias("brand")).agg(
        F.sum(net_revenue()).cast("double").alias("revenue"), F.count(F.lit(1)).alias("lines"))
    return top_k(g, [F.col("revenue").desc(), F.col("brand").asc()], 5)


def _scale_sql(name: str, expr: str) -> str:
    return (f"SELECT '{name}' AS scale, CAST({expr} AS BIGINT) AS level, count(*) AS n, "
            f"CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100.0 AS rate_pct "
            f"FROM lineitem GROUP BY 1, 2")


@query("satisfaction_rates", " UNION ALL ".join([
    _scale_sql("line_number", "l_linenumber"),
    _scale_sql("discount_pct", "round_even(l_discount * 100.0, 0)"),
    _scale_sql("tax_pct", "round_even(l_tax * 100.0, 0)"),
]))
def satisfaction_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Return rate by each level of three ordinal scales, one long frame (A2 x 3)."""
    li = read_table(spark, sf, "lineitem")
    d = li.select(
        F.col("l_linenumber").alias("line_number"),
        round_half_even(F.col("l_discount") * F.lit(100.0), 0).alias("discount_pct"),
        round_half_even(F.col("l_tax") * F.lit(100.0), 0).alias("tax_pct"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"))
    return rates_long(d, ["line_number", "discount_pct", "tax_pct"], "returned")
