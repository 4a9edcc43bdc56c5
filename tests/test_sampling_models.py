"""Sampling invariants (reproducible, exact counts) and model round trips."""

import pytest
from pyspark.sql import functions as F

from outagelens.operators import sampling as B
from tests.conftest import SF_SMALL


def _frame(spark, n=1000):
    return spark.range(n).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("target"),
                                 (F.col("id") * 1.0).alias("x"))


def test_split_exact_and_partition_independent(spark):  # B5
    df = _frame(spark)
    a = B.stratified_split(df, "target", [0.7, 0.15, 0.15], 42, key=["id"])
    b = B.stratified_split(df.repartition(16), "target", [0.7, 0.15, 0.15], 42, key=["id"])
    assert a.exceptAll(b).count() == 0
    counts = {(r.target, r.split): r["count"] for r in a.groupBy("target", "split").count().collect()}
    n1, n0 = 143, 857
    assert counts[(1, "train")] == round(n1 * 0.7) and counts[(0, "train")] == round(n0 * 0.7)
    assert sum(counts.values()) == 1000


def test_undersample_counts(spark):  # B6
    u = B.undersample(_frame(spark), "target", 0.5, 42, key=["id"])
    c = {r.target: r["count"] for r in u.groupBy("target").count().collect()}
    assert c == {1: 143, 0: 286}


def test_balance_guard_and_weights(spark):  # B8, B12
    df = _frame(spark)
    assert B.needs_balancing(df)
    w = {r.target: r.weight for r in B.class_weights(df).select("target", "weight").distinct().collect()}
    assert abs(w[1] - 1000 / (2 * 143)) < 1e-12


def test_warning_labels_hold(spark):  # B3/B4 invariants
    from outagelens.plans.catalog import QUERIES

    assert QUERIES["b03_positive_labels_hold"](spark, SF_SMALL).count() == 0
    assert QUERIES["b04_negative_labels_hold"](spark, SF_SMALL).count() == 0


def test_model_save_load_same_scores(spark, tmp_path):  # M1, S14
    from outagelens.plans import models as M

    df = _frame(spark, 400).withColumn("y2", F.col("x") % 7)
    m = M.fit(df, ["x", "y2"], "random_forest", {"trees": 5, "depth": 3}, name="rf")
    M.save_model(m, str(tmp_path / "rf"))
    m2 = M.load_model(str(tmp_path / "rf"))
    a = M.probability(m, df, "rf").select("id", "p_rf")
    b = M.probability(m2, df, "rf").select("id", "p_rf")
    assert a.exceptAll(b).count() == 0
    imp = M.importances(m, ["x", "y2"]).agg(F.sum("importance")).first()[0]
    assert abs(imp - 1.0) < 1e-9
    auc = M.evaluate(M.probability(m, df, "rf"), "p_rf").first().roc_auc
    assert auc > 0.5


def test_knn_equals_brute_force(spark):  # exactness of the pivot kNN with many small cells
    import numpy as np

    from outagelens.operators.neighbors import knn

    rng = np.random.default_rng(7)
    pts = rng.normal(size=(300, 4))
    pts[:100] *= 0.01  # a dense cluster
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, features array<double>")
    got = {(r.id, r.rank): r.nn_id for r in knn(df, df, 3, cell_size=10, sample_size=50).collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(pts)):
        order = np.lexsort((np.arange(len(pts)), d[i]))[:3]
        assert [got[(i, r + 1)] for r in range(3)] == list(order)


def test_smote_rows_lie_on_segments(spark):  # B7 invariant
    from outagelens.operators import sampling as S

    rows = [(0, [0.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [3.0, 0.0], 1)] + \
           [(10 + i, [5.0 + i, 5.0], 0) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, features array<double>, target int")
    out = S.smote(df, ratio=0.5, k=1).filter("is_synthetic = 1").collect()
    assert len(out) == 15 - 3
    for r in out:
        x, y = r.features
        assert y == 0.0 and 0.0 <= x <= 3.0 and r.target == 1


def test_daily_as_of_has_no_lookahead(spark):  # A16 option
    from outagelens.plans.catalog import QUERIES

    d = QUERIES["f01_daily_features_as_of"](spark, SF_SMALL)
    first = d.orderBy("date").select("date").first().date
    assert d.filter(F.col("date") == first).agg(F.max("total_historical_outages")).first()[0] == 0


def test_knn_heavy_duplicates_equal_brute_force(spark):  # a third of the rows on one point
    import numpy as np

    from outagelens.operators.neighbors import knn

    rng = np.random.default_rng(11)
    pts = rng.normal(size=(240, 3))
    pts[:80] = pts[0]          # 80 identical rows
    pts[80:84] = pts[80]       # a light duplicate group (4 < k + 1)
    ids = rng.permutation(1000)[:240]
    df = spark.createDataFrame([(int(i), [float(v) for v in p]) for i, p in zip(ids, pts)],
                               "id long, features array<double>")
    got = {(r.id, r.rank): (r.nn_id, r.dist) for r in knn(df, df, 5, cell_size=20, sample_size=60).collect()}
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for a in range(len(pts)):
        order = np.lexsort((ids, d[a]))[:5]
        assert [got[(int(ids[a]), r + 1)][0] for r in range(5)] == [int(ids[b]) for b in order]


def test_registered_queries_fit_the_full_settings():
    """No registered query hands its models other settings than ``FULL_PARAMS``, the default."""
    import ast
    import inspect

    from outagelens.plans import catalog_io, catalog_models

    before = {"fit": 3, "fit_all": 3, "train_compare": 4, "stack": 4, "compare": 4}  # compare: by the name of a study  # arguments ahead of ``params``
    seen = set()
    for module in (catalog_io, catalog_models):
        for x in ast.walk(ast.parse(inspect.getsource(module))):
            if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and getattr(x.func.value, "id", "") == "M" and x.func.attr in before:
                assert len(x.args) <= before[x.func.attr] and "params" not in {k.arg for k in x.keywords}, f"{module.__name__}:{x.lineno}"
                seen.add(x.func.attr)
    assert seen == set(before)


def test_negatives_are_all_free_hours(spark):  # B4: the free (county, hour, window) triples, each as likely
    import datetime as dt
    import random
    from collections import Counter

    from outagelens.operators import sampling as S

    rng, t0 = random.Random(4), dt.datetime(2021, 1, 1, 0, 20)
    ev = [("a", t0)] + [("ab"[rng.randrange(2)], t0 + dt.timedelta(minutes=rng.randrange(0, 60 * 120))) for _ in range(40)]
    ev += [("c", t0 + dt.timedelta(hours=h, minutes=7)) for h in range(130) if h not in (13, 14, 15, 90)] + [("c", None), (None, t0)]
    windows = (1, 3, 12)
    lo = min(t for c, t in ev if t)
    total = int((max(t for c, t in ev if t) - lo).total_seconds() // 3600) - 12
    free = {(c, lo + dt.timedelta(hours=h), w) for c in "abc" for h in range(total) for w in windows
            if not any(k == c and t and lo + dt.timedelta(hours=h) <= t < lo + dt.timedelta(hours=h + w) for k, t in ev)}
    df = spark.createDataFrame(ev, "county_fips string, event_time timestamp")
    n = 40 * len(free)
    got = Counter((r.county_fips, r.prediction_time, r.window_hours) for r in S.negatives(df, n, windows).collect())
    assert set(got) == free and sum(got.values()) == n
    assert max(got.values()) < 100 and min(got.values()) > 8
    assert S.negatives(df, 5, windows).exceptAll(S.negatives(df.repartition(5), 5, windows)).count() == 0


def test_negatives_where_nearly_all_hours_are_taken(spark):
    import datetime as dt

    from outagelens.operators import sampling as S

    t0 = dt.datetime(2021, 1, 1)
    dense = [("a", t0 + dt.timedelta(hours=h)) for h in range(2000) if h not in (77, 1500)]  # 99.9 % of the hours
    rows = S.negatives(spark.createDataFrame(dense, "county_fips string, event_time timestamp"), 500, (1,)).collect()
    assert len(rows) == 500 and {r.prediction_time for r in rows} == {t0 + dt.timedelta(hours=77), t0 + dt.timedelta(hours=1500)}
    full = [("a", t0 + dt.timedelta(hours=h)) for h in range(50)]
    with pytest.raises(ValueError, match="no free hour"):
        S.negatives(spark.createDataFrame(full, "county_fips string, event_time timestamp"), 5, (1,))
