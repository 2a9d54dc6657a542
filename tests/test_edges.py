"""Edge frames from FIXTURES.md section 3: ties, zero baselines, unseen levels, empty input."""

from pyspark.sql import functions as F

from insight.operators.metrics import auc_exact, classification_report
from insight.operators.ranking import quantile_tiers, rank_bins
from insight.operators.rfm import align_to, rfm
from insight.operators.summarise import arg_max, lift, pivot_agg


def test_arg_max_tie_goes_to_smallest_key(spark):
    df = spark.createDataFrame([(20, 5), (19, 7), (21, 7)], "hour int, events long")
    r = arg_max(df, "events", "hour").first()
    assert (r["hour"], r["events"]) == (19, 7)


def test_zero_baseline(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "c int, y int")
    r = lift(df, F.col("c") == 1, "y").first()
    assert r["baseline_rate_pct"] == 0.0 and r["cohort_rate_pct"] == 0.0 and r["lift"] == 0.0
    rep = {x["class"]: x for x in classification_report(
        spark.createDataFrame([(0, 0), (0, 1)], "y int, p int"), "y", "p").collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0 and rep["1"]["support"] == 0
    assert auc_exact(spark.createDataFrame([(0, 0.3), (0, 0.6)], "y int, s double"), "y", "s").first()["auc"] is None


def test_unseen_and_null_levels(spark):
    df = spark.createDataFrame([("a", "Low"), ("a", None), ("b", "High")], "g string, t string")
    p = pivot_agg(df, ["g"], "t", ["Low", "Medium", "High"], F.count(F.lit(1)), fill=0)
    got = {r["g"]: (r["Low"], r["Medium"], r["High"]) for r in p.collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 0, 1)}  # null level dropped, unseen level kept as 0
    s = spark.createDataFrame([("Champions", 3)], "segment string, n long")
    al = align_to(s, "segment", ["Champions", "Churned"], "o").orderBy("o").collect()
    assert [(r["segment"], r["n"]) for r in al] == [("Champions", 3), ("Churned", None)]


def test_empty_inputs_keep_schema(spark):
    empty = spark.createDataFrame([], "order_id long, customer_id long, order_date timestamp_ntz, order_value double")
    out = rfm(empty, "customer_id", "order_id", "order_date", "order_value")
    assert out.count() == 0 and "segment" in out.columns
    e2 = spark.createDataFrame([], "id long, v double")
    assert rank_bins(e2, "v", 5, "id", out="b").count() == 0
    assert quantile_tiers(e2, "v", q=3, out="t").count() == 0


def test_all_equal_values_bins(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "id long, v double")
    got = [r["b"] for r in rank_bins(df, "v", 5, "id", out="b").orderBy("id").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]  # ties broken by row order, as pandas
