"""P-values of correlations, distinct counts that add up, permutation importance."""

import math
import random

import pytest
from pyspark.sql import functions as F

from insight.functions.beta import correlation_p
from insight.operators.importance import permutation_importance, with_permuted
from insight.operators.sketches import LG_K, distinct_cells, estimated, union_cells
from insight.operators.trees import fit_tree


def student_tail(t, df):
    """Two-sided tail of Student's t by Simpson's rule over the density's angle form: t = sqrt(df) tan(u)."""
    low, high, n = math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 20_000
    h = (high - low) / n
    at = [math.cos(low + k * h) ** (df - 1) if df > 1 else 1.0 for k in range(n + 1)]
    whole = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * whole * h / 3 * (at[0] + at[-1] + 4 * sum(at[1:-1:2]) + 2 * sum(at[2:-1:2]))


def test_correlation_p_against_the_integral(spark):
    cases = [(r, n) for n in (3, 4, 5, 12, 30, 500, 20_000) for r in (0.001, 0.01, 0.05, 0.2, -0.5, 0.9)]
    df = spark.createDataFrame(cases, "r double, n long")
    for row in df.select("r", "n", correlation_p(F.col("r"), F.col("n")).alias("p")).collect():
        want = student_tail(row.r * math.sqrt((row.n - 2) / (1 - row.r ** 2)), row.n - 2)
        assert row.p == pytest.approx(want, rel=1e-6, abs=1e-9), row
    # a very large table: the normal tail
    big = spark.createDataFrame([(2.5e-5, 10**10), (1e-5, 10**10)], "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert [r.p for r in big] == pytest.approx([math.erfc(2.5 / math.sqrt(2)), math.erfc(1 / math.sqrt(2))], rel=1e-4)
    edge = spark.createDataFrame([(1.0, 9), (0.0, 9), (None, 9), (0.5, 2)], "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert [r.p for r in edge] == [0.0, 1.0, None, None]


def test_distinct_counts_roll_up(spark):
    rows = spark.range(200_000).select((F.col("id") % 7).alias("zone"), (F.col("id") % 24).alias("hour"), F.when(F.col("id") % 10 > 0, F.col("id") % 30_011).alias("user"))
    cells = distinct_cells(rows, ["zone", "hour"], "user")
    bound = 4 * 1.04 / math.sqrt(2 ** LG_K)
    for keys in (["zone", "hour"], ["zone"], ["hour"], []):
        got = {tuple(r[k] for k in keys): (r["rows"], r.distinct_estimate) for r in estimated(union_cells(cells, keys)).collect()}
        want = {tuple(r[k] for k in keys): (r.n, r.users) for r in rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("users")).collect()}
        assert got.keys() == want.keys()
        for k, (n, users) in want.items():
            assert got[k][0] == n and abs(got[k][1] - users) <= bound * users
    assert estimated(union_cells(distinct_cells(rows.limit(0), ["zone", "hour"], "user"), ["zone"])).collect() == []


def test_permutation_importance(spark):
    draw = random.Random(5)
    rows = [(i, int(x > 0.5), x, draw.random()) for i, x in enumerate(draw.random() for _ in range(997))]
    df = spark.createDataFrame(rows, "id long, y int, useful double, idle double")
    moved = with_permuted(df, ["useful", "idle"], "y", "id", 3).collect()
    own = {r[0]: r for r in rows}
    assert sorted((r.id, r.y, r.useful, r.idle) for r in moved) == sorted(rows)
    for c, k in (("useful", 2), ("idle", 3)):
        assert sorted(r[f"permuted_{c}"] for r in moved) == sorted(r[k] for r in rows)
        assert not any(r[f"permuted_{c}"] == own[r.id][k] for r in moved)
    tree = fit_tree(df, ["useful", "idle"], "y", max_depth=2)
    got = {r.feature: r for r in permutation_importance(df, tree.probability, ["useful", "idle"], "y", "id", 3).collect()}
    right = {c: sum((r[f"permuted_{c}"] > 0.5 if c == "useful" else own[r.id][2] > 0.5) == (r.y == 1) for r in moved) for c in ("useful", "idle")}
    assert got["idle"].importance == 0 and got["idle"].hits == 997 == right["idle"]
    assert abs(got["useful"].hits_permuted - right["useful"]) <= 3 and 0.4 < got["useful"].importance < 0.6
