"""Catalog entries: evaluation (E1-E10, W7) over labelled scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import sampling as B
from ..sources import fixtures as fx
from .registry import query


def scored(spark, sf):
    s = fx.scores(spark, sf)
    return s.withColumn("pred", (F.col("p") >= 0.5).cast("int"))


CURVE_SQL = """
sc AS (SELECT p AS score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target <> 1) AS neg
       FROM scores WHERE p IS NOT NULL GROUP BY p),
cum AS (SELECT score, pos, neg,
               sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM sc),
curve AS (
  SELECT score AS threshold, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
         CASE WHEN (SELECT sum(pos) FROM sc) > 0 THEN CAST(tp AS DOUBLE) / (SELECT sum(pos) FROM sc) ELSE 1.0 END AS recall,
         CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cum
  UNION ALL SELECT NULL, 1.0, 0.0, 0, 0),
pts AS (SELECT *, 2 * (precision * recall) / (precision + recall + 1e-10) AS f1 FROM curve WHERE threshold IS NOT NULL)"""

AUC_SQL = """auc AS (
  SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0
              THEN sum(pos * ((SELECT sum(neg) FROM sc) - fp + 0.5 * neg)) / (sum(pos) * sum(neg)) ELSE 0.0 END AS roc_auc
  FROM cum)"""

CONF_SQL = """m AS (
  SELECT count(*) FILTER (WHERE target = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE target <> 1 AND p >= 0.5) AS fp,
         count(*) FILTER (WHERE target = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE target <> 1 AND p < 0.5) AS tn
  FROM scores)"""


@query("e01_metrics", f"""
WITH {CURVE_SQL}, {AUC_SQL}, {CONF_SQL}
SELECT coalesce((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0.0) AS accuracy,
       coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
       coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
       coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
       (SELECT roc_auc FROM auc) AS roc_auc FROM m""", dbl=("accuracy", "precision", "recall", "f1", "roc_auc"))
def e01(spark, sf):
    return E.metrics(scored(spark, sf))


@query("e02_roc_auc", f"WITH {CURVE_SQL}, {AUC_SQL} SELECT roc_auc FROM auc", dbl=("roc_auc",))
def e02(spark, sf):
    return E.roc_auc(fx.scores(spark, sf))


@query("e03_confusion", f"""
WITH {CONF_SQL}
SELECT 0 AS actual, 0 AS predicted, tn AS n FROM m UNION ALL SELECT 0, 1, fp FROM m
UNION ALL SELECT 1, 0, fn FROM m UNION ALL SELECT 1, 1, tp FROM m""")
def e03(spark, sf):
    return E.confusion(scored(spark, sf))


@query("e04_pr_curve", f"WITH {CURVE_SQL} SELECT * FROM curve", dbl=("precision", "recall"))
def e04(spark, sf):
    return E.pr_curve(fx.scores(spark, sf))


@query("e05_best_f1", f"""
WITH {CURVE_SQL}
SELECT threshold, precision, recall, f1 FROM pts ORDER BY f1 DESC, threshold ASC LIMIT 1""",
       dbl=("precision", "recall", "f1"))
def e05(spark, sf):
    return E.best_f1(E.pr_curve(fx.scores(spark, sf)))


def _at_precision_sql(t):
    return f"""SELECT CAST({t} AS DOUBLE) AS target_precision, threshold, precision, recall, f1 FROM (
  SELECT * FROM pts WHERE precision >= {t} ORDER BY threshold LIMIT 1)"""


@query("e06_at_precision", f"""
WITH {CURVE_SQL}
{_at_precision_sql(0.12)} UNION ALL {_at_precision_sql(0.14)} UNION ALL {_at_precision_sql(0.15)}""",
       dbl=("precision", "recall", "f1"))
def e06(spark, sf):
    curve = E.pr_curve(fx.scores(spark, sf)).cache()
    out = None
    for t in (0.12, 0.14, 0.15):  # the fixture scores reach .16
        x = E.at_precision(curve, t).filter(F.col("threshold").isNotNull())
        out = x if out is None else out.unionByName(x)
    return out


@query("e07_at_recall", f"""
WITH {CURVE_SQL}
SELECT CAST(0.9 AS DOUBLE) AS target_recall, threshold, precision, recall, f1 FROM (
  SELECT * FROM pts WHERE recall >= 0.9 ORDER BY threshold DESC LIMIT 1)""", dbl=("precision", "recall", "f1"))
def e07(spark, sf):
    return E.at_recall(E.pr_curve(fx.scores(spark, sf)), 0.9).filter(F.col("threshold").isNotNull())


@query("e08_class_report", f"""
WITH {CONF_SQL},
k AS (SELECT coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS p1, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS r1,
             coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
             coalesce(tn / nullif(CAST(tn + fn AS DOUBLE), 0), 0.0) AS p0, coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0.0) AS r0,
             coalesce(2 * tn / nullif(CAST(2 * tn + fn + fp AS DOUBLE), 0), 0.0) AS f0,
             CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0,
             coalesce((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0.0) AS acc FROM m)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, CAST(s0 AS BIGINT) AS support FROM k
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM k
UNION ALL SELECT 'accuracy', acc, acc, acc, CAST(s0 + s1 AS BIGINT) FROM k
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(s0 + s1 AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
                 (f0 * s0 + f1 * s1) / (s0 + s1), CAST(s0 + s1 AS BIGINT) FROM k""", dbl=("precision", "recall", "f1"))
def e08(spark, sf):
    return E.class_report(scored(spark, sf))


@query("e09_meets_recall", f"""
WITH {CONF_SQL}
SELECT coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
       coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) >= 0.9 AS meets_target FROM m""", dbl=("recall",))
def e09(spark, sf):
    return E.meets_recall(scored(spark, sf), 0.9)


@query("e10_holdout")
def e10(spark, sf):
    """Metrics on the stored 'test' split (hash-seeded split: rows-only check)."""
    s = B.stratified_split(scored(spark, sf), "target", [0.7, 0.15, 0.15], seed=42, key=["doc_id"])
    return E.holdout(s)


@query("e10_holdout_sample")
def e10s(spark, sf):
    s = B.stratified_split(scored(spark, sf), "target", [0.7, 0.15, 0.15], seed=42, key=["doc_id"])
    return E.holdout_sample(s, ["doc_id"], 20)
