"""Model queries: risk models.  The logistic model and the tree have SQL oracles that fit them anew; the forest is
checked rows-only.

The risk pipeline follows the attrition analysis: stratified 80/20 split
first, balanced class weights fitted on the training rows, standardised
features for the logistic model, a depth-6 tree and a 200-tree depth-8
forest.  Scores on the whole table carry ``is_train`` (F11).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insight.functions.expr import round_half_even
from insight.operators import metrics as M
from insight.operators import models as ML
from insight.operators import newton, trees
from insight.operators import sampling as D
from insight.operators.importance import permutation_importance
from insight.operators.summarise import pivot_agg
from insight.operators.trees import impurity
from insight.plans.documents import DOCS_SQL, FEATURES, SEED, labelled_docs, report_sql
from insight.plans.accounts import RISK_EDGES, RISK_LABELS
from insight.plans.registry import query
from insight.plans.reports import solve_sql
from insight.session import materialize

# Model settings of the reference's attrition models.
TREE_DEPTH = 6
FOREST_TREES, FOREST_DEPTH = 200, 8


def risk_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with encoded categories, split flag, weights and z-scores."""
    # cut lineage once: every later pass reads the narrow features, not the texts
    d = materialize(labelled_docs(spark, sf))
    d = ML.label_encode_many(d, [("lang", "lang_code"), ("source", "source_code")])
    # the split's order statistics run once; weights and scaling read the result
    d = materialize(D.split(d, "doc_id", 0.2, SEED, stratify="quality"))
    d = D.balanced_weights(d, "quality", fit_on=d.where(~F.col("is_test")))
    d = ML.standardise(d, FEATURES, fit_on=~F.col("is_test"))
    return materialize(d.withColumn("label", F.col("quality").cast("double")))


Z_FEATURES = ["z_" + c for c in FEATURES]


def _fit(kind: str, train: DataFrame):
    if kind == "logistic":
        return newton.fit_logistic(train, Z_FEATURES, "label", weight="weight")
    if kind == "tree":
        return trees.fit_tree(train, FEATURES, "label", balanced=True, max_depth=TREE_DEPTH)
    return ML.fit_forest(train, FEATURES, "label", weight="weight", num_trees=FOREST_TREES,
                         max_depth=FOREST_DEPTH, seed=SEED)


def _score(model, df: DataFrame) -> DataFrame:
    """``probability_1`` and ``prediction``; compiled models are a projection."""
    if isinstance(model, (newton.LinearScore, trees.Tree)):
        return df.withColumn("probability_1", model.probability()).withColumn("prediction", (F.col("probability_1") > 0.5).cast("int"))
    return ML.score(model, df)


def _test_scores(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    d = risk_frame(spark, sf)
    model = _fit(kind, d.where(~F.col("is_test")))
    return _score(model, d.where(F.col("is_test"))).select(
        "doc_id", F.col("quality").alias("label"), round_half_even("probability_1", 6).alias("probability_1"), "prediction")


# Oracles: the frame, the logistic model by the same Newton steps, the tree level by level.
FRAME_SQL = f"""{DOCS_SQL},
enc AS (
  SELECT *, dense_rank() OVER (ORDER BY lang) - 1 AS lang_code, dense_rank() OVER (ORDER BY source) - 1 AS source_code,
         row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id)
           <= ceil(count(*) OVER (PARTITION BY quality) * 0.2) AS is_test FROM ld),
wt AS MATERIALIZED (SELECT count(*) / (2.0::DOUBLE * count_if(quality = 0)) AS w0, count(*) / (2.0::DOUBLE * count_if(quality = 1)) AS w1 FROM enc WHERE NOT is_test)"""


def newton_sql(steps: int) -> str:
    """CTEs up to ``logistic`` (one row of coefficients ``b0`` .. and the frame ``zs``)."""
    m = len(FEATURES) + 1
    xs = [f"x{i}" for i in range(m)]
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(FEATURES, 1))
    scaled = ", ".join(f"CASE WHEN s{i} > 0 THEN ({c} - m{i}) / s{i} ELSE {c} - m{i} END AS x{i}" for i, c in enumerate(FEATURES, 1))
    out = [f"st AS MATERIALIZED (SELECT {stats} FROM enc WHERE NOT is_test)",
           f"zs AS MATERIALIZED (SELECT doc_id, quality, is_test, CASE WHEN quality = 1 THEN w1 ELSE w0 END AS s, 1.0::DOUBLE AS x0, {scaled} FROM enc, st, wt)",
           f"at0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(m))})"]
    for k in range(steps):
        margin = " + ".join(f"b{i} * {x}" for i, x in enumerate(xs))
        out.append(f"e{k} AS MATERIALIZED (SELECT zs.*, a.*, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({margin}))) AS p FROM zs, at{k} a WHERE NOT is_test)")
        cells = [f"sum(s * p * (1 - p) * x{i} * x{j}) + {int(i == j and i > 0)} AS a{i}_{j}" for i in range(m) for j in range(m)]
        cells += [f"sum(s * (p - quality) * x{i}) + {f'any_value(b{i})' if i else 0} AS a{i}_{m}" for i in range(m)]
        out += [f"sys{k} AS MATERIALIZED (SELECT {', '.join(cells)} FROM e{k})", solve_sql(f"sys{k}", m, f"move{k}"),
                f"at{k + 1} AS MATERIALIZED (SELECT {', '.join(f'a.b{i} - d.b{i} AS b{i}' for i in range(m))} FROM at{k} a, move{k} d)"]
    margin = " + ".join(f"b{i} * {x}" for i, x in enumerate(xs))
    out.append(f"scored AS (SELECT doc_id, quality AS label, is_test, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({margin}))) AS p FROM zs, at{steps})")
    return ",\n".join(out)


def tree_sql(depth: int) -> str:
    """CTEs up to ``scored``: rows with the weighted share of the positive class in their leaf."""
    out = [f"rows0 AS MATERIALIZED (SELECT doc_id, quality AS y, is_test, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES)}, 1 AS node FROM enc)"]
    pairs = ", ".join(f"{{'f': {k}, 'v': {c}}}" for k, c in enumerate(FEATURES))
    value = "CASE b.f " + " ".join(f"WHEN {k} THEN r.{c}" for k, c in enumerate(FEATURES)) + " END"
    for d in range(depth):
        out += [
            f"tot{d} AS (SELECT node, count_if(y = 0) AS t0, count_if(y = 1) AS t1 FROM rows{d} WHERE NOT is_test GROUP BY node)",
            f"cell{d} AS (SELECT node, p.f AS f, p.v AS v, count_if(y = 0) AS n0, count_if(y = 1) AS n1 FROM (SELECT node, y, unnest([{pairs}]) AS p FROM rows{d} WHERE NOT is_test) GROUP BY ALL)",
            f"run{d} AS (SELECT node, f, v, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1, lead(v) OVER w AS nx FROM cell{d} WINDOW w AS (PARTITION BY node, f ORDER BY v))",
            f"cut{d} AS (SELECT r.node, f, (v + nx) / 2.0::DOUBLE AS edge, t0 * w0 AS a, t1 * w1 AS b, {impurity('l0', 'l1', 't0', 't1', 'w0', 'w1')} AS loss"
            f" FROM run{d} r JOIN tot{d} t ON t.node = r.node, wt WHERE nx IS NOT NULL AND t0 > 0 AND t1 > 0)",
            f"best{d} AS MATERIALIZED (SELECT node, f, edge FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY loss, f, edge) AS q FROM cut{d})"
            f" WHERE q = 1 AND loss < a + b - (a * a + b * b) / (a + b) - {trees.LEAST_GAIN!r}::DOUBLE * (a + b))",
            f"rows{d + 1} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN b.node IS NULL THEN r.node WHEN {value} <= b.edge THEN 2 * r.node ELSE 2 * r.node + 1 END AS node)"
            f" FROM rows{d} r LEFT JOIN best{d} b ON b.node = r.node)"]
    out.append(f"leaf AS (SELECT node, (count_if(y = 1) * any_value(w1)) / ((count_if(y = 0) * any_value(w0)) + (count_if(y = 1) * any_value(w1))) AS p"
               f" FROM rows{depth}, wt WHERE NOT is_test GROUP BY node)")
    out.append(f"scored AS (SELECT doc_id, y AS label, is_test, p FROM rows{depth} r JOIN leaf l ON l.node = r.node)")
    return ",\n".join(out)


LOGISTIC_SQL = f"WITH {FRAME_SQL},\n{newton_sql(newton.STEPS)}"
TREE_SQL = f"WITH {FRAME_SQL},\n{tree_sql(TREE_DEPTH)}"
SCORES_SQL = "\nSELECT doc_id, label, round_even(p * 1e6, 0) / 1e6 AS probability_1, CAST(p > 0.5 AS INTEGER) AS prediction FROM scored WHERE is_test"


@query("risk_logistic", LOGISTIC_SQL + SCORES_SQL)
def risk_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced L2 logistic regression on standardised features by Newton steps; test-row scores."""
    return _test_scores(spark, sf, "logistic")


@query("risk_tree", TREE_SQL + SCORES_SQL)
def risk_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced depth-6 decision tree over all midpoints; test-row scores."""
    return _test_scores(spark, sf, "tree")


@query("tree_risk_tiers", TREE_SQL + f"""
SELECT doc_id, label, round_even(p * 1e6, 0) / 1e6 AS risk_score, CASE {' '.join(
    f"WHEN p > {lo} AND p <= {hi} THEN '{lab}'" for lo, hi, lab in zip(RISK_EDGES[:-1], RISK_EDGES[1:], RISK_LABELS))} END AS risk_tier, NOT is_test AS is_train FROM scored
""")
def tree_risk_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The tree's score and right-closed tier of every row, with ``is_train``."""
    d = risk_frame(spark, sf)
    s = ML.risk_tiers(_score(_fit("tree", d.where(~F.col("is_test"))), d), "probability_1", RISK_EDGES, RISK_LABELS)
    return s.select("doc_id", F.col("quality").alias("label"), round_half_even("probability_1", 6).alias("risk_score"), "risk_tier", (~F.col("is_test")).alias("is_train"))


METRICS_SQL = """,
t AS (SELECT label, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS ar FROM scored WHERE is_test),
s AS (SELECT sum(CASE WHEN label = 1 THEN ar END) AS rp, CAST(count_if(label = 1) AS BIGINT) AS p1, CAST(count_if(label <> 1) AS BIGINT) AS n0,
             avg(CAST(label = CAST(p > 0.5 AS INTEGER) AS INTEGER)) AS acc FROM t)
SELECT round_even(acc * 1e6, 0) / 1e6 AS accuracy, round_even((2 * rp - p1 * (p1 + 1)) / (2.0 * p1 * n0) * 1e6, 0) / 1e6 AS auc FROM s
"""


def _metrics(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    d = risk_frame(spark, sf)
    s = _score(_fit(kind, d.where(~F.col("is_test"))), d.where(F.col("is_test")))
    auc = M.auc_exact(s, "quality", "probability_1").select("auc").scalar()
    return s.agg(round_half_even(M.accuracy(F.col("quality").cast("int"), F.col("prediction")), 6).alias("accuracy")).withColumn("auc", round_half_even(auc, 6))


@query("tree_metrics", TREE_SQL + METRICS_SQL)
def tree_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and exact AUC of the tree on the test rows."""
    return _metrics(spark, sf, "tree")


@query("tree_confusion", TREE_SQL + """
SELECT y.label, CAST(count_if(s.label = y.label AND p <= 0.5) AS BIGINT) AS pred_0, CAST(count_if(s.label = y.label AND p > 0.5) AS BIGINT) AS pred_1
FROM (VALUES (0), (1)) y(label), scored s WHERE is_test GROUP BY y.label
""")
def tree_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix of the tree's predictions on the test rows."""
    return M.confusion(_scored_test(risk_frame(spark, sf), "tree"), "quality", "prediction")


@query("tree_report", TREE_SQL + ",\nhs AS (SELECT label, CAST(p > 0.5 AS INTEGER) AS pred FROM scored WHERE is_test)," + report_sql("hs", "label", "pred"))
def tree_report(spark: SparkSession, sf: str) -> DataFrame:
    """Classification report of the tree's predictions on the test rows."""
    s = _scored_test(risk_frame(spark, sf), "tree").withColumn("quality", F.col("quality").cast("int"))
    return M.classification_report(s, "quality", "prediction")


@query("tree_roc", TREE_SQL + """,
c AS (SELECT p AS threshold, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM scored WHERE is_test GROUP BY p),
pts AS (SELECT threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM c WINDOW w AS (ORDER BY threshold DESC)
        UNION ALL SELECT NULL, 0, 0),
t AS (SELECT sum(pos) AS pos, sum(neg) AS neg FROM c)
SELECT round_even(threshold * 1e6, 0) / 1e6 AS threshold, tp, fp, CASE WHEN pos > 0 THEN tp / pos END AS tpr, CASE WHEN neg > 0 THEN fp / neg END AS fpr FROM pts, t
""")
def tree_roc(spark: SparkSession, sf: str) -> DataFrame:
    """ROC points of the tree's probabilities on the test rows."""
    points = M.roc_points(_scored_test(risk_frame(spark, sf), "tree"), "quality", "probability_1")
    return points.withColumn("threshold", round_half_even("threshold", 6))


TIER_COLUMNS = [t.lower().replace(" ", "_") for t in RISK_LABELS]


@query("tree_tiers_by_lang", TREE_SQL + "\nSELECT lang, " + ", ".join(
    f"CAST(count_if(p > {lo} AND p <= {hi}) AS BIGINT) AS {c}" for lo, hi, c in zip(RISK_EDGES[:-1], RISK_EDGES[1:], TIER_COLUMNS))
    + " FROM scored JOIN enc USING (doc_id) WHERE p > 0 AND lang IS NOT NULL GROUP BY lang")
def tree_tiers_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each language by tier of the tree's score; untiered rows dropped, unseen tiers 0."""
    d = risk_frame(spark, sf)
    s = ML.risk_tiers(_score(_fit("tree", d.where(~F.col("is_test"))), d), "probability_1", RISK_EDGES, RISK_LABELS)
    return pivot_agg(s, ["lang"], "risk_tier", RISK_LABELS, F.count(F.lit(1)), names=TIER_COLUMNS, fill=0)


def gains_sql(depth: int) -> str:
    """Loss of weighted Gini impurity by each split of the tree."""
    return "gains AS (" + " UNION ALL ".join(
        f"SELECT b.f, (c.a + c.b - (c.a * c.a + c.b * c.b) / (c.a + c.b)) - c.loss AS gain FROM best{d} b JOIN cut{d} c ON c.node = b.node AND c.f = b.f AND c.edge = b.edge"
        for d in range(depth)) + ")"


@query("tree_importance", TREE_SQL + ",\n" + gains_sql(TREE_DEPTH) + f""",
i AS (SELECT feature, round_even(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM gains) * 1e6, 0) / 1e6 AS importance
      FROM (VALUES {', '.join(f"({j}, '{c}')" for j, c in enumerate(FEATURES))}) v(f, feature) LEFT JOIN gains USING (f) GROUP BY feature)
SELECT feature, importance, CAST(row_number() OVER w AS INTEGER) AS rank, row_number() OVER w <= 3 AS highlight FROM i WINDOW w AS (ORDER BY importance DESC, feature)
""")
def tree_importance(spark: SparkSession, sf: str) -> DataFrame:
    """The tree's feature importances, sorted, with the top-3 highlight."""
    d = risk_frame(spark, sf)
    tree = _fit("tree", d.where(~F.col("is_test")))
    shares = spark.createDataFrame(list(zip(FEATURES, tree.importances())), "feature string, importance double")  # a row per feature
    ranked = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
    return shares.withColumn("importance", round_half_even("importance", 6)).withColumn("rank", ranked).withColumn("highlight", F.col("rank") <= 3)


def permuted_sql(depth: int) -> str:
    """Test rows once as they are (``f`` -1) and once per feature with its values dealt anew, walked down the tree."""
    m = len(FEATURES)
    cols = ", ".join(FEATURES)
    out = [f"tr AS MATERIALIZED (SELECT doc_id, y, {cols}, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id) - 1 AS k, count(*) OVER () AS n FROM rows0 WHERE is_test)"]
    parts = [f"SELECT -1 AS f, 1 AS node, y, {cols} FROM tr"]
    for j, c in enumerate(FEATURES):
        own = ", ".join(f"b.{x} AS {x}" if x == c else f"a.{x}" for x in FEATURES)
        parts.append(f"SELECT {j}, 1, a.y, {own} FROM tr a JOIN tr b ON b.k = (a.k + CAST(floor(a.n * {2 * j + 1} / {2.0 * m}) AS BIGINT) + 1) % a.n")
    out.append(f"px0 AS ({' UNION ALL '.join(parts)})")
    value = "CASE b.f " + " ".join(f"WHEN {k} THEN r.{c}" for k, c in enumerate(FEATURES)) + " END"
    for d in range(depth):
        out.append(f"px{d + 1} AS (SELECT r.* REPLACE (CASE WHEN b.node IS NULL THEN r.node WHEN {value} <= b.edge THEN 2 * r.node ELSE 2 * r.node + 1 END AS node)"
                   f" FROM px{d} r LEFT JOIN best{d} b ON b.node = r.node)")
    out.append(f"hit AS (SELECT f, count_if((p > 0.5) = (y = 1)) AS hits, count(*) AS n FROM px{depth} r JOIN leaf l ON l.node = r.node GROUP BY f)")
    return ",\n".join(out)


@query("tree_permutation_importance", TREE_SQL + ",\n" + permuted_sql(TREE_DEPTH) + f"""
SELECT CASE a.f {' '.join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(FEATURES))} END AS feature, CAST(b.hits AS BIGINT) AS hits, CAST(a.hits AS BIGINT) AS hits_permuted,
       round_even(CAST(b.hits - a.hits AS DOUBLE) / b.n * 1e6, 0) / 1e6 AS importance
FROM hit a, hit b WHERE a.f >= 0 AND b.f = -1
""")
def tree_permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of right predictions of the tree on the test rows when a feature's values are dealt anew."""
    d = risk_frame(spark, sf)
    tree = _fit("tree", d.where(~F.col("is_test")))
    found = permutation_importance(d.where(F.col("is_test")), tree.probability, FEATURES, "quality", "doc_id", SEED)
    return found.withColumn("importance", round_half_even("importance", 6))


@query("logistic_metrics", LOGISTIC_SQL + METRICS_SQL)
def logistic_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and exact AUC of the logistic model on the test rows."""
    return _metrics(spark, sf, "logistic")


@query("risk_forest")
def risk_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced 200-tree forest of depth 8; test-row scores."""
    return _test_scores(spark, sf, "forest")


@query("importance")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    """Forest feature importances, sorted, with the top-3 highlight."""
    d = risk_frame(spark, sf)
    imp = ML.feature_importance(_fit("forest", d.where(~F.col("is_test"))), FEATURES, spark)
    # one row per feature: the window is bounded by the feature count
    rank = F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature"))
    return imp.withColumn("rank", rank).withColumn("highlight", F.col("rank") <= 3)


@query("model_comparison")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and exact AUC per model on the test rows."""
    d = risk_frame(spark, sf)
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    rows = []
    for kind, name in (("logistic", "Logistic Regression"), ("tree", "Decision Tree"),
                       ("forest", "Random Forest")):
        s = _score(_fit(kind, train), test)
        auc = M.auc_exact(s, "quality", "probability_1").select("auc").scalar()
        rows.append(s.agg(F.lit(name).alias("model"), round_half_even(
            M.accuracy(F.col("quality").cast("int"), F.col("prediction")), 6).alias("accuracy"))
            .withColumn("auc", round_half_even(auc, 6)))
    return reduce(DataFrame.unionByName, rows)


@query("risk_scores")
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Forest risk score and right-closed tier for every row, with ``is_train``."""
    d = risk_frame(spark, sf)
    model = _fit("forest", d.where(~F.col("is_test")))
    s = ML.score(model, d).withColumn("is_train", ~F.col("is_test"))
    s = ML.risk_tiers(s, "probability_1", RISK_EDGES, RISK_LABELS)
    return s.select("doc_id", "lang", F.col("quality").alias("label"),
                    F.col("probability_1").alias("risk_score"), "risk_tier", "is_train")


# Model settings of the reference's dropout models.
OVERSAMPLED_TREES, OVERSAMPLED_DEPTH, PLAIN_LOGISTIC_MAX_ITER = 150, 10, 500


def oversampled_comparison(spark: SparkSession, sf: str, balance_first: bool = False) -> DataFrame:
    """Dropout-style pipeline: bootstrap the minority, forest (150, depth 10) and plain LR.

    By default the split comes first and only training rows are up-sampled,
    so no copy of a row sits on both sides (F10).  ``balance_first=True``
    reproduces the reference's order (up-sample, then split).
    """
    d = risk_frame(spark, sf).drop("weight", *Z_FEATURES, "is_test")
    if balance_first:
        # stored once: the up-sampled rows feed the split, the scaling and the fits
        d = materialize(D.oversample(d, "quality", "doc_id", SEED))
        d = d.withColumn("row_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("copy_id").cast("string")))
        d = D.split(d, "row_key", 0.2, SEED, stratify="quality")
        train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    else:
        d = D.split(d, "doc_id", 0.2, SEED, stratify="quality")
        train = materialize(D.oversample(d.where(~F.col("is_test")), "quality", "doc_id", SEED))
        test = d.where(F.col("is_test"))
    stats_from = F.col("_fit")
    both = train.withColumn("_fit", F.lit(True)).unionByName(test.withColumn("_fit", F.lit(False)), allowMissingColumns=True)
    both = materialize(ML.standardise(both, FEATURES, fit_on=stats_from))
    train, test = both.where(F.col("_fit")), both.where(~F.col("_fit"))
    models = [
        ("Random Forest", ML.fit_forest(train, FEATURES, "label", num_trees=OVERSAMPLED_TREES,
                                        max_depth=OVERSAMPLED_DEPTH, seed=SEED)),
        ("Logistic Regression", ML.fit_logistic(train, Z_FEATURES, "label", max_iter=PLAIN_LOGISTIC_MAX_ITER)),
    ]
    rows = []
    for name, model in models:
        s = ML.score(model, test)
        auc = M.auc_exact(s, "quality", "probability_1").select("auc").scalar()
        rows.append(s.agg(F.lit(name).alias("model"), round_half_even(
            M.accuracy(F.col("quality").cast("int"), F.col("prediction")), 6).alias("accuracy"))
            .withColumn("auc", round_half_even(auc, 6)))
    return reduce(DataFrame.unionByName, rows)


@query("risk_models_oversampled")
def risk_models_oversampled(spark: SparkSession, sf: str) -> DataFrame:
    """Forest and plain logistic model on split-then-up-sampled training rows."""
    return oversampled_comparison(spark, sf)


def _scored_test(d: DataFrame, kind: str) -> DataFrame:
    return _score(_fit(kind, d.where(~F.col("is_test"))), d.where(F.col("is_test")))


@query("model_roc")
def model_roc(spark: SparkSession, sf: str) -> DataFrame:
    """ROC points of each model's test-row probabilities, one long frame (M13, chart frame)."""
    d = risk_frame(spark, sf)
    parts = []
    for kind, name in (("logistic", "Logistic Regression"), ("tree", "Decision Tree"),
                       ("forest", "Random Forest")):
        pts = M.roc_points(_scored_test(d, kind), "quality", "probability_1")
        parts.append(pts.select(F.lit(name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query("forest_confusion")
def forest_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion matrix of the forest's test predictions."""
    return M.confusion(_scored_test(risk_frame(spark, sf), "forest"), "quality", "prediction")


@query("forest_report")
def forest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Classification report of the forest's test predictions."""
    s = _scored_test(risk_frame(spark, sf), "forest").withColumn("quality", F.col("quality").cast("int"))
    return M.classification_report(s, "quality", "prediction")


@query("risk_models_balance_first")
def risk_models_balance_first(spark: SparkSession, sf: str) -> DataFrame:
    """The reference's order: up-sample the whole table, then split (F10; scores inflated)."""
    return oversampled_comparison(spark, sf, balance_first=True)
