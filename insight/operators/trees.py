"""Exact decision trees: every midpoint is a candidate split (M8), and their compiled form.

A level is one pass.  Rows collapse to counts per (node, feature, value); running counts along the values give
the two sides of every split between neighbouring values, and each node keeps its best.  A feature with many
values does not meet in one task: values are dealt into ranges by bounds that are literals (quantiles of the
training rows, chosen once), counts run inside a range, and what lies before it comes from a frame of one row
per (node, feature, range).  Only a row per node reaches the driver.

Split points and counts do not depend on partitioning: counts are whole numbers, class weights are constants.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges per feature.
RANGES = 32
#: Least gain of a split, as a share of the node's weight.
LEAST_GAIN = 1e-9


@dataclass
class Tree:
    """Splits and class counts by node; node 1 is the root, node ``i`` has the children ``2i`` and ``2i + 1``."""

    features: tuple[str, ...]
    weights: tuple[float, float]
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    counts: dict[int, tuple[int, int]] = field(default_factory=dict)

    def _walk(self, leaf, node: int = 1) -> Column:
        if node not in self.splits:
            return leaf(node)
        f, at = self.splits[node]
        return F.when(F.col(self.features[f]).cast("double") <= F.lit(at), self._walk(leaf, 2 * node)).otherwise(self._walk(leaf, 2 * node + 1))

    def node(self) -> Column:
        """The leaf that a row falls into; a null feature goes right."""
        return self._walk(lambda n: F.lit(n))

    def _share(self, node: int) -> float:
        n0, n1 = self.counts.get(node, (0, 0))
        a, b = n0 * self.weights[0], n1 * self.weights[1]
        return b / (a + b) if a + b else 0.0

    def probability(self) -> Column:
        """The weighted share of the positive class in the row's leaf."""
        return self._walk(lambda n: F.lit(self._share(n)))

    def sql(self, node: int = 1) -> str:
        """The probability as SQL text over the feature columns."""
        if node not in self.splits:
            return repr(self._share(node))
        f, at = self.splits[node]
        return f"CASE WHEN {self.features[f]} <= {at!r} THEN {self.sql(2 * node)} ELSE {self.sql(2 * node + 1)} END"

    def importances(self) -> list[float]:
        """Share of each feature in the weighted loss of Gini impurity."""
        def loss(n):
            a, b = (c * w for c, w in zip(self.counts[n], self.weights))
            return a + b - (a * a + b * b) / (a + b) if a + b else 0.0

        out = [0.0] * len(self.features)
        for n, (f, _) in self.splits.items():
            out[f] += loss(n) - loss(2 * n) - loss(2 * n + 1)
        total = sum(out)
        return [x / total if total else 0.0 for x in out]


def impurity(l0: str, l1: str, t0: str, t1: str, w0: str, w1: str) -> str:
    """Weighted Gini impurity of both sides of a split, as SQL text."""
    a, b, c, d = f"({l0} * {w0})", f"({l1} * {w1})", f"(({t0} - {l0}) * {w0})", f"(({t1} - {l1}) * {w1})"
    side = lambda x, y: f"(({x} + {y}) - ({x} * {x} + {y} * {y}) / ({x} + {y}))"
    return f"({side(a, b)} + {side(c, d)})"


def _best(rows: DataFrame, tree: Tree, bounds: list[list[float]], totals: dict[int, tuple[int, int]]) -> dict[int, tuple[int, float, float]]:
    """Per node of ``rows`` (``node``, ``y``, features): feature, split point and impurity of its best split."""
    def cell(k: int, c: str) -> Column:
        value = F.col(c).cast("double")
        below = F.filter(F.array(*map(F.lit, bounds[k])), lambda b: b < value) if bounds[k] else F.array()
        return F.struct(F.lit(k).alias("f"), value.alias("v"), F.size(below).alias("r"))

    parts = [cell(k, c) for k, c in enumerate(tree.features)]
    cells = (rows.select("node", "y", F.explode(F.array(*parts)).alias("p")).select("node", "y", "p.*").where("v is not null")
             .groupBy("node", "f", "r", "v").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")))
    inside = Window.partitionBy("node", "f", "r").orderBy("v")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    runs = cells.select("*", F.sum("n0").over(running).alias("c0"), F.sum("n1").over(running).alias("c1"), F.lead("v").over(inside).alias("next"))
    across = Window.partitionBy("node", "f").orderBy("r")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    ranges = (cells.groupBy("node", "f", "r").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"), F.min("v").alias("low"))
              .select("node", "f", "r", F.coalesce(F.sum("s0").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("s1").over(before), F.lit(0)).alias("b1"),
                      F.lead("low").over(across).alias("following")))
    known = rows.sparkSession.createDataFrame([(n, *t) for n, t in totals.items()], "node int, t0 long, t1 long")  # a row per node
    w0, w1 = (f"{w!r}D" for w in tree.weights)
    splits = (runs.join(ranges, ["node", "f", "r"]).join(F.broadcast(known), "node")
              .select("node", "f", (F.col("b0") + F.col("c0")).alias("l0"), (F.col("b1") + F.col("c1")).alias("l1"), "t0", "t1",
                      ((F.col("v") + F.coalesce("next", "following")) / F.lit(2.0)).alias("at")).where("at is not null")
              .withColumn("loss", F.expr(impurity("l0", "l1", "t0", "t1", w0, w1))))
    found = splits.groupBy("node").agg(F.min(F.struct("loss", "f", "at")).alias("b")).select("node", "b.*").collect()  # a row per node
    return {r["node"]: (r["f"], r["at"], r["loss"]) for r in found}


def fit_tree(train: DataFrame, features: Sequence[str], label: str, balanced: bool = False, max_depth: int = 6) -> Tree:
    """The tree that greedy splitting by Gini impurity grows, best over all features and midpoints; ties go to the first
    feature, then to the lowest midpoint.  ``balanced`` weighs classes by ``n / (2 n_class)``."""
    base = train.select(*features, F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    n0, n1 = base.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    weights = ((n0 + n1) / (2.0 * n0), (n0 + n1) / (2.0 * n1)) if balanced and n0 and n1 else (1.0, 1.0)
    tree = Tree(tuple(features), weights)
    tree.counts[1] = (n0, n1)
    cuts = [k / RANGES for k in range(1, RANGES)]
    got = base.agg(*[F.percentile_approx(F.col(c).cast("double"), cuts, 1000) for c in features]).first()
    bounds = [sorted(set(b or [])) for b in got]
    frontier = [1] if n0 and n1 else []
    for _ in range(max_depth):
        if not frontier:
            break
        here = base.withColumn("node", tree.node()).where(F.col("node").isin(frontier))
        best = _best(here, tree, bounds, {n: tree.counts[n] for n in frontier})
        grown = []
        for n, (f, at, loss) in sorted(best.items()):
            a, b = (c * w for c, w in zip(tree.counts[n], weights))
            if loss < a + b - (a * a + b * b) / (a + b) - LEAST_GAIN * (a + b):
                tree.splits[n] = f, at
                grown += [2 * n, 2 * n + 1]
        if not grown:
            break
        sides = base.withColumn("node", tree.node()).where(F.col("node").isin(grown)).groupBy("node").agg(
            F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).collect()
        tree.counts |= {n: (0, 0) for n in grown} | {r["node"]: (r["n0"], r["n1"]) for r in sides}
        frontier = [n for n in grown if all(tree.counts[n])]
    return tree
