"""E1-E10 (+ W7): exact binary-classifier evaluation as aggregations.

Curves and AUC are computed from per-score counts. Cumulative sums over the
sorted distinct scores never use one global window: scores are cut into ranges
at approximate quantiles of the distinct scores (a bounded number of cuts, wherever the
scores lie), a prefix sum over the ranges' totals gives each range's offset, and the
running sum is finished inside each range. The result is exact (not binned like ``numBins``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which ordered values are cut for a distributed running sum.
_RANGES = 1024


def in_ranges(df: DataFrame, col: str, out: str = "_bk", ranges: int = _RANGES) -> DataFrame:
    """Add the number of the value range of ``col`` (not null), in the order of the values; ranges hold about equally many rows."""
    cuts = sorted(set(df.stat.approxQuantile(col, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    cuts = [c for c in cuts if c == c and abs(c) != float("inf")]
    splits = [-float("inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    found = Bucketizer(splits=splits, inputCol="_range_of", outputCol="_range", handleInvalid="keep")
    return (found.transform(df.withColumn("_range_of", F.col(col).cast("double")))
            .withColumn(out, F.col("_range").cast("int")).drop("_range", "_range_of"))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], freq: int = 1) -> list[float | None]:
    """Exact quantiles (linear interpolation, as ``percentile``) of a column whose rows count ``freq`` times; nulls are ignored.

    Distinct values are counted map-side and cut into ranges; running counts are finished inside each range, and
    only the rows at the wanted ranks reach the driver. No task holds all distinct values.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v")).agg(
        (F.count(F.lit(1)) * F.lit(int(freq))).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    total = counts.agg(F.sum("_n")).first()[0]
    if not total:
        counts.unpersist()
        return [None] * len(qs)
    x = in_ranges(counts, "_v")
    lower = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)  # <= 1,024 rows
    hist = x.groupBy("_bk").agg(F.sum("_n").alias("_r")).select("_bk", F.coalesce(F.sum("_r").over(lower), F.lit(0)).alias("_below"))
    inside = Window.partitionBy("_bk").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(F.broadcast(hist), "_bk").withColumn("_from", F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    places = [q * (total - 1) for q in qs]
    ranks = sorted({r for at in places for r in (math.floor(at), math.ceil(at))})
    hit = F.array(*[F.lit(r).cast("long") for r in ranks])
    here = F.filter(hit, lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))
    value = {r: row["_v"] for row in x.withColumn("_hit", here).filter(F.size("_hit") > 0).select("_v", "_hit").collect() for r in row["_hit"]}
    counts.unpersist()
    return [value[math.floor(at)] + (at - math.floor(at)) * (value[math.ceil(at)] - value[math.floor(at)]) for at in places]


def score_counts(df: DataFrame, label: str = "target", prob: str = "p") -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    y = F.col(label)
    return df.filter(F.col(prob).isNotNull()).groupBy(F.col(prob).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))


def cumulative_at_or_above(counts: DataFrame) -> DataFrame:
    """Add ``tp``/``fp``: positives/negatives with score >= this score (W7), exactly."""
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    x = in_ranges(counts, "score")
    hist = x.groupBy("_bk").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    above = Window.orderBy(F.col("_bk").desc()).rowsBetween(Window.unboundedPreceding, -1)  # <= 1,024 rows
    hist = hist.select("_bk", F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_op"),
                       F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_on"))
    inner = Window.partitionBy("_bk").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (x.join(F.broadcast(hist), "_bk")
            .withColumn("tp", (F.col("_op") + F.sum("pos").over(inner)).cast("long"))
            .withColumn("fp", (F.col("_on") + F.sum("neg").over(inner)).cast("long"))
            .drop("_bk", "_op", "_on"))


# -- E1 / E2 -----------------------------------------------------------------------------
def roc_auc(df: DataFrame, label: str = "target", prob: str = "p") -> DataFrame:
    """Exact ROC-AUC with ties counted as one half (rank-sum); 0 when only one class is present."""
    c = cumulative_at_or_above(score_counts(df, label, prob))
    # negatives strictly below a score = N - fp(score), so
    # sum(pos * (N - fp + neg / 2)) = N * P - sum(pos * fp) + sum(pos * neg) / 2
    s = c.agg(F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"),
              F.sum(F.col("pos").cast("double") * F.col("fp")).alias("S1"),
              F.sum(F.col("pos").cast("double") * F.col("neg")).alias("S2"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0),
                 (F.col("N") * F.col("P") - F.col("S1") + 0.5 * F.col("S2")) / (F.col("P") * F.col("N"))
                 ).otherwise(F.lit(0.0))
    return s.select(auc.cast("double").alias("roc_auc"))


def metrics(df: DataFrame, label: str = "target", pred: str = "pred", prob: str | None = "p") -> DataFrame:
    """accuracy, precision, recall, f1 (0 on zero division) and, with ``prob``, ROC-AUC."""
    y, yh = F.col(label) == 1, F.col(pred) == 1
    c = df.agg(F.count_if(y & yh).alias("tp"), F.count_if(~y & yh).alias("fp"),
               F.count_if(y & ~yh).alias("fn"), F.count_if(~y & ~yh).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(F.try_divide(tp, F.nullif(tp + fp, F.lit(0.0))), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, F.nullif(tp + fn, F.lit(0.0))), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, F.nullif(2 * tp + fp + fn, F.lit(0.0))), F.lit(0.0))
    out = c.select(
        F.coalesce(F.try_divide(tp + tn, F.nullif(tp + tn + fp + fn, F.lit(0.0))), F.lit(0.0)).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))
    if prob is not None:
        out = out.withColumn("roc_auc", roc_auc(df, label, prob).scalar())
    return out


# -- E3 ----------------------------------------------------------------------------------
def confusion(df: DataFrame, label: str = "target", pred: str = "pred") -> DataFrame:
    """All four (actual, predicted) cells, empty ones as 0."""
    y, yh = F.col(label) == 1, F.col(pred) == 1
    c = df.agg(F.count_if(~y & ~yh).alias("c00"), F.count_if(~y & yh).alias("c01"),
               F.count_if(y & ~yh).alias("c10"), F.count_if(y & yh).alias("c11"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("n"))
        for a in (0, 1) for p in (0, 1)]))
    return c.select(cells.alias("x")).select("x.*")


# -- E4-E7 --------------------------------------------------------------------------------
def pr_curve(df: DataFrame, label: str = "target", prob: str = "p") -> DataFrame:
    """One point per distinct score (threshold) plus the end point (precision 1, recall 0, no threshold)."""
    c = cumulative_at_or_above(score_counts(df, label, prob)).persist(StorageLevel.MEMORY_AND_DISK)
    p_total = F.lit(c.agg(F.sum("pos")).first()[0] or 0)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    pts = c.select(
        F.col("score").alias("threshold"),
        F.coalesce(F.try_divide(tp, F.nullif(tp + fp, F.lit(0.0))), F.lit(0.0)).alias("precision"),
        F.when(p_total > 0, tp / p_total).otherwise(F.lit(1.0)).alias("recall"),
        "tp", "fp")
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
        F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    return pts.unionByName(end)


def _f1(p: F.Column, r: F.Column) -> F.Column:
    return 2 * (p * r) / (p + r + F.lit(1e-10))


def best_f1(curve: DataFrame) -> DataFrame:
    """Threshold maximising F1 (+1e-10 in the denominator); ties go to the lowest threshold."""
    pts = curve.filter(F.col("threshold").isNotNull()).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    best = pts.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                            F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select("b.*")


def at_precision(curve: DataFrame, target: float) -> DataFrame:
    """Lowest threshold whose precision reaches ``target`` (the end point is excluded)."""
    pts = curve.filter(F.col("threshold").isNotNull() & (F.col("precision") >= target))
    return pts.agg(F.min_by(F.struct("threshold", "precision", "recall"), "threshold").alias("b")).select(
        F.lit(float(target)).alias("target_precision"), "b.*", _f1(F.col("b.precision"), F.col("b.recall")).alias("f1"))


def at_recall(curve: DataFrame, target: float) -> DataFrame:
    """Highest threshold whose recall reaches ``target``."""
    pts = curve.filter(F.col("threshold").isNotNull() & (F.col("recall") >= target))
    return pts.agg(F.max_by(F.struct("threshold", "precision", "recall"), "threshold").alias("b")).select(
        F.lit(float(target)).alias("target_recall"), "b.*", _f1(F.col("b.precision"), F.col("b.recall")).alias("f1"))


# -- E8 / E9 / E10 ---------------------------------------------------------------------------
def class_report(df: DataFrame, label: str = "target", pred: str = "pred") -> DataFrame:
    """Per-class precision/recall/f1/support plus accuracy, macro and weighted rows."""
    y, yh = F.col(label) == 1, F.col(pred) == 1
    c = df.agg(F.count_if(y & yh).alias("tp"), F.count_if(~y & yh).alias("fp"),
               F.count_if(y & ~yh).alias("fn"), F.count_if(~y & ~yh).alias("tn"))

    def prf(tp, fp, fn):
        tp, fp, fn = (F.col(x).cast("double") for x in (tp, fp, fn))
        p = F.coalesce(F.try_divide(tp, F.nullif(tp + fp, F.lit(0.0))), F.lit(0.0))
        r = F.coalesce(F.try_divide(tp, F.nullif(tp + fn, F.lit(0.0))), F.lit(0.0))
        f = F.coalesce(F.try_divide(2 * tp, F.nullif(2 * tp + fp + fn, F.lit(0.0))), F.lit(0.0))
        return p, r, f

    p1, r1, f1 = prf("tp", "fp", "fn")
    p0, r0, f0 = prf("tn", "fn", "fp")
    s1 = (F.col("tp") + F.col("fn")).cast("double")
    s0 = (F.col("tn") + F.col("fp")).cast("double")
    n = s0 + s1
    acc = F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.nullif(n, F.lit(0.0))), F.lit(0.0))
    rows = [
        ("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
        ("accuracy", acc, acc, acc, n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        ("weighted avg", F.try_divide(p0 * s0 + p1 * s1, n), F.try_divide(r0 * s0 + r1 * s1, n),
         F.try_divide(f0 * s0 + f1 * s1, n), n),
    ]
    arr = F.array(*[F.struct(F.lit(k).alias("class"), p.alias("precision"), r.alias("recall"),
                             f.alias("f1"), s.cast("long").alias("support")) for k, p, r, f, s in rows])
    return c.select(F.explode(arr).alias("x")).select("x.*")


def meets_recall(df: DataFrame, target: float = 0.9, label: str = "target", pred: str = "pred") -> DataFrame:
    m = metrics(df, label, pred, prob=None)
    return m.select("recall", (F.col("recall") >= F.lit(float(target))).alias("meets_target"))


def holdout(df: DataFrame, split_col: str = "split", split: str = "test", label: str = "target",
            pred: str = "pred", prob: str = "p") -> DataFrame:
    """Metrics on the stored held-out split (the split label travels with the row)."""
    return metrics(df.filter(F.col(split_col) == split), label, pred, prob)


def holdout_sample(df: DataFrame, order: list[str], n: int = 20, split_col: str = "split", split: str = "test",
                   label: str = "target", pred: str = "pred", prob: str = "p") -> DataFrame:
    """The first ``n`` held-out rows in key order (actual, predicted, probability)."""
    return (df.filter(F.col(split_col) == split).orderBy(*order).limit(n)
            .select(*order, F.col(label).alias("actual"), F.col(pred).alias("predicted"),
                    F.col(prob).alias("probability")))
