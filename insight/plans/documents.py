"""Risk-model analyses on labelled ``documents``.

Binding: an entity is a labelled document (``documents`` joined with
``labels``); the binary label is ``quality``; numeric features are the
character count, the line count (newlines over the whole text + 1) and the
toxic flag, plus encoded language and source; the rule score is
``n_chars / (n_chars + 5000)`` (monotone, uncapped).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.functions.expr import interval_bins
from insight.operators import metrics as M
from insight.operators import models as ML
from insight.operators import sampling as D
from insight.operators.rfm import align_to
from insight.functions.beta import STEPS
from insight.operators.summarise import label_correlation, pivot_agg
from insight.plans.registry import query
from insight.sources.tables import read_table

# Fixed values that must equal the reference: dropout-style risk tier edges
# (right-closed, first bin open at 0) and tier names.
TIER_EDGES = [0.0, 0.33, 0.66, 1.0]
TIER_LABELS = ["Low Risk", "Medium Risk", "High Risk"]
TIER_COLUMNS = ["low_risk", "medium_risk", "high_risk"]
LENGTH_EDGES = [0, 500, 1000, 2000, 5000, 10000, (1 << 63) - 1]  # the last band is open
LENGTH_LABELS = ["<500", "500-1k", "1k-2k", "2k-5k", "5k-10k", ">10k"]
FEATURES = ["n_chars", "n_lines", "toxic", "lang_code", "source_code"]
SEED = 42


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with numeric features; the whole text of each
    labelled document is scanned once for its line count (after the join, so
    unlabelled texts are not processed)."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    lab = read_table(spark, sf, "labels")
    lines = F.length("text") - F.length(F.regexp_replace("text", "\n", "")) + F.lit(1)
    return d.join(lab, "doc_id", "inner").select(
        "doc_id", "lang", "source", "n_chars", lines.cast("long").alias("n_lines"), "quality", "toxic")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled_docs(spark, sf)
    return d.withColumn("score", F.col("n_chars").cast("double") / (F.col("n_chars") + F.lit(5000.0)))


DOCS_SQL = """
ld AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS BIGINT) AS n_lines,
         l.quality, l.toxic, CAST(d.n_chars AS DOUBLE) / (d.n_chars + 5000.0) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""
TIER_SQL = """CASE WHEN score > 0.0 AND score <= 0.33 THEN 'Low Risk'
                   WHEN score > 0.33 AND score <= 0.66 THEN 'Medium Risk'
                   WHEN score > 0.66 AND score <= 1.0 THEN 'High Risk' END"""


@query("score_tiers", f"WITH {DOCS_SQL} SELECT doc_id, score, {TIER_SQL} AS risk_tier FROM ld")
def score_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Right-closed risk tiers on a score; score 0 would get none."""
    s = _scored(spark, sf)
    return s.select("doc_id", "score", interval_bins("score", TIER_EDGES, TIER_LABELS).alias("risk_tier"))


@query("tier_matrix", f"""
WITH {DOCS_SQL}, t AS (SELECT lang, {TIER_SQL} AS risk_tier FROM ld)
SELECT lang, CAST(count_if(risk_tier = 'Low Risk') AS BIGINT) AS low_risk,
       CAST(count_if(risk_tier = 'Medium Risk') AS BIGINT) AS medium_risk,
       CAST(count_if(risk_tier = 'High Risk') AS BIGINT) AS high_risk
FROM t WHERE risk_tier IS NOT NULL GROUP BY lang
""")
def tier_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Language x risk tier counts; untiered rows dropped, unseen tiers 0."""
    s = _scored(spark, sf).withColumn("risk_tier", interval_bins("score", TIER_EDGES, TIER_LABELS))
    return pivot_agg(s, ["lang"], "risk_tier", TIER_LABELS, F.count(F.lit(1)), names=TIER_COLUMNS, fill=0)


@query("length_band_rate", f"""
WITH {DOCS_SQL},
b AS (SELECT *, CASE """ + " ".join(
    f"WHEN n_chars > {lo} AND n_chars <= {hi} THEN '{lab}'"
    for lo, hi, lab in zip(LENGTH_EDGES[:-1], LENGTH_EDGES[1:], LENGTH_LABELS)) + """ END AS band FROM ld),
g AS (SELECT band, count(*) AS docs,
             CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 100.0 AS low_quality_rate_pct
      FROM b WHERE band IS NOT NULL GROUP BY band),
labels(band, band_order) AS (VALUES """ + ", ".join(
    f"('{lab}', {i + 1})" for i, lab in enumerate(LENGTH_LABELS)) + """)
SELECT l.band, l.band_order, g.docs, g.low_quality_rate_pct, l.band_order <= 3 AS below_threshold
FROM labels l LEFT JOIN g ON l.band = g.band
""")
def length_band_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Low-quality rate by length band, every band listed in order."""
    d = labelled_docs(spark, sf).withColumn("band", interval_bins("n_chars", LENGTH_EDGES, LENGTH_LABELS))
    g = d.where(F.col("band").isNotNull()).groupBy("band").agg(
        F.count(F.lit(1)).alias("docs"),
        (F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).cast("double") / F.count(F.lit(1))
         * F.lit(100.0)).alias("low_quality_rate_pct"))
    return align_to(g, "band", LENGTH_LABELS, ordinal="band_order").withColumn(
        "below_threshold", F.col("band_order") <= 3)


@query("label_correlation", f"""
WITH RECURSIVE {DOCS_SQL},
cr AS MATERIALIZED (
  SELECT 'n_chars' AS feature, corr(CAST(n_chars AS DOUBLE), CAST(quality AS DOUBLE)) AS r, count(*) AS n FROM ld
  UNION ALL SELECT 'n_lines', corr(CAST(n_lines AS DOUBLE), CAST(quality AS DOUBLE)), count(*) FROM ld
  UNION ALL SELECT 'toxic', corr(CAST(toxic AS DOUBLE), CAST(quality AS DOUBLE)), count(*) FROM ld),
ab AS (SELECT feature, r, (n - 2) / 2.0::DOUBLE AS a, 0.5::DOUBLE AS b, 1 - r * r < ((n - 2) / 2.0::DOUBLE + 1) / ((n - 2) / 2.0::DOUBLE + 2.5) AS near FROM cr),
arg AS (SELECT feature, near, CASE WHEN near THEN 1 - r * r ELSE r * r END AS x, CASE WHEN near THEN a ELSE b END AS a, CASE WHEN near THEN b ELSE a END AS b,
        exp(a * ln(1 - r * r) + b * ln(r * r) + lgamma(a + b) - lgamma(a) - lgamma(b)) AS front FROM ab),
cf AS (
  SELECT feature, near, x, a, b, front, 0 AS k, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM arg
  UNION ALL
  SELECT feature, near, x, a, b, front, k, 1 + t / c, 1 / (1 + t * d), h * (1 + t / c) / (1 + t * d) FROM (
    SELECT *, CASE WHEN k % 2 = 1 THEN m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)) ELSE -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m)) END AS t
    FROM (SELECT * REPLACE (k + 1 AS k), ((k + 2) // 2)::DOUBLE AS m FROM cf WHERE k < {STEPS}))),
pv AS (SELECT feature, CASE WHEN near THEN front * h / a ELSE 1 - front * h / a END AS p FROM cf WHERE k = {STEPS})
SELECT feature, round_even(abs(r) * 1e6, 0) / 1e6 AS abs_corr, round_even(least(1, greatest(0, p)) * 1e6, 0) / 1e6 AS p_value
FROM cr JOIN pv USING (feature) ORDER BY abs_corr DESC, feature
""")
def label_correlation_query(spark: SparkSession, sf: str) -> DataFrame:
    """|point-biserial r| of numeric features with the label and its p-value, sorted."""
    return label_correlation(labelled_docs(spark, sf), ["n_chars", "n_lines", "toxic"], "quality")


@query("encode_labels", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_code,
       source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source_code
FROM documents
""")
def encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Alphabetical integer codes for language and source (M1)."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    d = ML.label_encode_many(d, [("lang", "lang_code"), ("source", "source_code")])
    return d.select("doc_id", "lang", "lang_code", "source", "source_code")


SPLIT_SQL = """
SELECT doc_id, {strat}
       row_number() OVER ({part} ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id)
         <= ceil(count(*) OVER ({part}) * 0.2) AS is_test
FROM labels
"""


@query("split_random", SPLIT_SQL.format(strat="", part=""))
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic 80/20 split keyed by md5(id:seed)."""
    lab = read_table(spark, sf, "labels").select("doc_id")
    return D.split(lab, "doc_id", 0.2, SEED)


@query("split_stratified", SPLIT_SQL.format(strat="quality,", part="PARTITION BY quality"))
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    """The same split with ``ceil(0.2 n)`` test rows per label."""
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    return D.split(lab, "doc_id", 0.2, SEED, stratify="quality")


@query("oversample_minority", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
mino_label AS (SELECT quality FROM c ORDER BY n, quality LIMIT 1),
mino AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS r
         FROM labels WHERE quality = (SELECT quality FROM mino_label)),
sizes AS (SELECT (SELECT count(*) FROM mino) AS m,
                 (SELECT count(*) FROM labels WHERE quality <> (SELECT quality FROM mino_label)) AS n_maj),
draws AS (SELECT i, 1 + (('0x' || substr(md5(CAST(i AS VARCHAR) || ':42'), 1, 15))::BIGINT % m) AS r
          FROM (SELECT unnest(range(1, n_maj + 1)) AS i, m FROM sizes))
SELECT doc_id, quality, CAST(0 AS BIGINT) AS copy_id FROM labels WHERE quality <> (SELECT quality FROM mino_label)
UNION ALL
SELECT mino.doc_id, mino.quality, draws.i FROM draws JOIN mino ON draws.r = mino.r
""")
def oversample_minority(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap the minority label up to the majority size."""
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    return D.oversample(lab, "quality", "doc_id", SEED)


@query("class_weights", """
SELECT doc_id, quality,
       CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY quality)) AS weight
FROM labels
""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced class weight per row: n / (2 n_class) (M7)."""
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    return D.balanced_weights(lab, "quality").select("doc_id", "quality", "weight")


@query("standardise", f"""
WITH {DOCS_SQL},
sp AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id)
                      <= ceil(count(*) OVER (PARTITION BY quality) * 0.2) AS is_test FROM labels),
j AS (SELECT ld.*, sp.is_test FROM ld JOIN sp USING (doc_id)),
st AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(n_lines) AS m2, stddev_pop(n_lines) AS s2
       FROM j WHERE NOT is_test)
SELECT doc_id, is_test,
       round_even((CASE WHEN s1 > 0 THEN (CAST(n_chars AS DOUBLE) - m1) / s1 ELSE CAST(n_chars AS DOUBLE) - m1 END) * 1e6, 0) / 1e6 AS z_n_chars,
       round_even((CASE WHEN s2 > 0 THEN (CAST(n_lines AS DOUBLE) - m2) / s2 ELSE CAST(n_lines AS DOUBLE) - m2 END) * 1e6, 0) / 1e6 AS z_n_lines
FROM j, st
""")
def standardise_query(spark: SparkSession, sf: str) -> DataFrame:
    """z-scores with population std fitted on the training rows only (M3)."""
    from insight.functions.expr import round_half_even

    d = D.split(labelled_docs(spark, sf), "doc_id", 0.2, SEED, stratify="quality")
    z = ML.standardise(d, ["n_chars", "n_lines"], fit_on=~F.col("is_test"))
    return z.select("doc_id", "is_test", round_half_even("z_n_chars", 6).alias("z_n_chars"),
                    round_half_even("z_n_lines", 6).alias("z_n_lines"))


@query("auc_exact", f"""
WITH {DOCS_SQL},
r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM ld),
s AS (SELECT sum(CASE WHEN quality = 1 THEN ar END) AS rp, CAST(count_if(quality = 1) AS BIGINT) AS p,
             CAST(count_if(quality <> 1) AS BIGINT) AS n FROM r)
SELECT CASE WHEN p > 0 AND n > 0 THEN (2 * rp - p * (p + 1)) / (2.0 * p * n) END AS auc,
       p AS positives, n AS negatives FROM s
""")
def auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exact rank AUC of the length score for the quality label."""
    return M.auc_exact(_scored(spark, sf), "quality", "score")


@query("roc_points", f"""
WITH {DOCS_SQL},
c AS (SELECT score, count_if(quality = 1) AS pos, count_if(quality <> 1) AS neg FROM ld GROUP BY score),
cum AS (SELECT score AS threshold, sum(pos) OVER (ORDER BY score DESC) AS tp,
               sum(neg) OVER (ORDER BY score DESC) AS fp FROM c),
pts AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cum
        UNION ALL SELECT NULL, 0, 0),
t AS (SELECT count_if(quality = 1) AS p, count_if(quality <> 1) AS n FROM ld)
SELECT threshold, tp, fp, CASE WHEN p > 0 THEN tp / p END AS tpr, CASE WHEN n > 0 THEN fp / n END AS fpr
FROM pts, t
""")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    """ROC points per distinct score threshold plus the origin."""
    return M.roc_points(_scored(spark, sf), "quality", "score")


PRED_SQL = "CASE WHEN score >= 0.5 THEN 1 ELSE 0 END"


@query("confusion", f"""
WITH {DOCS_SQL}
SELECT quality AS label, CAST(count_if({PRED_SQL} = 0) AS BIGINT) AS pred_0,
       CAST(count_if({PRED_SQL} = 1) AS BIGINT) AS pred_1
FROM ld GROUP BY quality
""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Label x prediction counts at threshold 0.5."""
    s = _scored(spark, sf).withColumn("pred", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return M.confusion(s, "quality", "pred")


def report_sql(table: str, label: str, pred: str) -> str:
    """CTEs and final SELECT of a classification report over 0/1 columns of ``table``."""
    return f"""
c AS (SELECT count_if({label} = 0 AND {pred} = 0) AS c00, count_if({label} = 0 AND {pred} = 1) AS c01,
             count_if({label} = 1 AND {pred} = 0) AS c10, count_if({label} = 1 AND {pred} = 1) AS c11 FROM {table}),
k AS (
  SELECT '0' AS class, CASE WHEN c00 + c10 > 0 THEN c00 / (c00 + c10) ELSE 0.0 END AS precision,
         CASE WHEN c00 + c01 > 0 THEN c00 / (c00 + c01) ELSE 0.0 END AS recall, c00 + c01 AS support FROM c
  UNION ALL
  SELECT '1', CASE WHEN c11 + c01 > 0 THEN c11 / (c11 + c01) ELSE 0.0 END,
         CASE WHEN c11 + c10 > 0 THEN c11 / (c11 + c10) ELSE 0.0 END, c11 + c10 FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM k),
a AS (
  SELECT class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT class, round_even(precision * 1e6, 0) / 1e6 AS precision, round_even(recall * 1e6, 0) / 1e6 AS recall,
       round_even(f1 * 1e6, 0) / 1e6 AS f1, CAST(support AS BIGINT) AS support FROM a
"""


@query("classification_report", f"WITH {DOCS_SQL}," + report_sql("ld", "quality", PRED_SQL))
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per-class precision/recall/F1/support with macro and weighted averages."""
    s = _scored(spark, sf).withColumn("pred", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return M.classification_report(s, "quality", "pred")
