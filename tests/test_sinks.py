"""Sinks (S2-S4) round trip and the long KPI table."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from insight.sources import kpi_table, load, load_checked, publish, read_published, write_projection, write_table
from insight.sources.tables import TABLE_SCHEMAS, read_table

from tablepaths import SF001


def test_read_table_uses_declared_schema(spark):
    o = read_table(spark, SF001, "orders")
    assert o.schema == TABLE_SCHEMAS["orders"]
    plan = o.select("o_custkey").where(F.col("o_totalprice") > 1000)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderdate" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_csv_and_parquet_round_trip(spark, tmp_out):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "id long, s string, x double")
    for fmt in ("csv", "parquet"):
        path = os.path.join(tmp_out, fmt)
        write_table(df, path, fmt=fmt)
        back = load(spark, path, df.schema, fmt=fmt)
        assert sorted(map(tuple, back.collect()), key=lambda t: t[0]) == [(1, "a", None), (2, "b", 1.5)]
    proj = os.path.join(tmp_out, "proj")
    write_projection(df, ["id", "x"], proj)
    assert load(spark, proj).columns == ["id", "x"]


def test_kpi_table_long_form(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0)], "c long, v double")
    k = kpi_table(df, [("revenue", "total", F.sum("v")), ("volume", "customers", F.count_distinct("c"))])
    got = {(r.section, r.metric): r.value for r in k.collect()}
    assert got == {("revenue", "total"): 60.0, ("volume", "customers"): 2.0}


def _csv_text(folder):
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    lines = [open(os.path.join(folder, f)).read().splitlines() for f in parts]
    return lines[0][:1] + [x for part in lines for x in part[1:]]


def test_csv_in_the_dialect_of_pandas(spark, tmp_out):
    rows = [(1, True, 16343301.34, dt.date(2023, 1, 31), 'a "b", c'), (2, False, 33.0, None, "x"), (3, None, 0.00012, dt.date(2023, 12, 1), None),
            (4, True, 1e-7, None, "y"), (5, True, 1.5e17, None, "y"), (6, False, 9.31, None, "z"), (7, True, None, None, "z"), (8, True, -12345678.5, None, "z")]
    df = spark.createDataFrame(rows, "id long, flag boolean, x double, month date, s string").coalesce(1)
    path = os.path.join(tmp_out, "csv")
    write_table(df, path, fmt="csv", months=["month"])
    pdf = pd.DataFrame(rows, columns=["id", "flag", "x", "month", "s"])
    pdf["month"] = pdf["month"].map(lambda d: f"{d:%Y-%m}" if d else None)
    assert _csv_text(path) == pdf.to_csv(index=False).splitlines()
    back = load(spark, path, spark.createDataFrame([], "id long, flag boolean, x double, month string, s string").schema, fmt="csv")
    assert [(r.id, r.flag, r.x, r.s) for r in back.orderBy("id").collect()] == [(r[0], r[1], r[2], r[4]) for r in rows]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_failed_write_leaves_the_published_table(spark, tmp_out, fmt):
    path = os.path.join(tmp_out, "table")
    first = spark.createDataFrame([(1, 0.5, True), (2, None, False)], "id long, x double, ok boolean")
    with pytest.raises(FileNotFoundError):
        read_published(spark, path)
    assert publish(first, path, fmt=fmt) == 1
    broken = spark.range(20).select("id", F.when(F.col("id") < 19, F.lit(1.0)).otherwise(F.raise_error(F.lit("lost")).cast("double")).alias("x"), F.lit(True).alias("ok"))
    with pytest.raises(Exception, match="lost"):
        publish(broken, path, fmt=fmt)
    assert sorted(map(tuple, read_published(spark, path).collect())) == [(1, 0.5, True), (2, None, False)]
    # a table may be replaced by what is read from it
    assert publish(read_published(spark, path).where("id = 2"), path, fmt=fmt) == 2
    assert [tuple(r) for r in read_published(spark, path).collect()] == [(2, None, False)]
    assert read_published(spark, path, version=1).count() == 2
    assert read_published(spark, path).dtypes == first.dtypes


def test_fields_that_fail_their_cast_are_rejected(spark, tmp_out):
    path = os.path.join(tmp_out, "in.csv")
    with open(path, "w") as f:
        f.write("id,day,value\n1,2023-01-05,10.5\n2,2023-13-05,7\n3,05.01.2023,abc\n4,,1\n,2023-02-01,2\n6,2023-02-30,\n7,2023-03-01,3,extra\n")
    schema = spark.createDataFrame([], "id long, day timestamp_ntz, value double").schema
    good, rejects = load_checked(spark, path, schema, formats={"day": "yyyy-MM-dd"}, required=["id"])
    assert good.schema == schema
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, dt.datetime(2023, 1, 5), 10.5), (4, None, 1.0)]
    got = {(r.column, r.value, r.reason) for r in rejects.collect()}
    assert got == {("day", "2023-13-05", "not a timestamp_ntz"), ("day", "05.01.2023", "not a timestamp_ntz"), ("value", "abc", "not a double"),
                   ("id", None, "missing"), ("day", "2023-02-30", "not a timestamp_ntz"), ("_malformed", "7,2023-03-01,3,extra", "malformed line")}
    counts = {(r.column, r.reason): r["count"] for r in rejects.groupBy("column", "reason").count().collect()}
    assert counts["day", "not a timestamp_ntz"] == 3
