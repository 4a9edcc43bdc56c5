"""Rules that keep searches and tree steps in proportion to their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelens.operators import neighbors as N
from outagelens.operators import sampling as B


def vectors(spark, x, target=None):
    target = np.zeros(len(x), int) if target is None else target
    return spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, target))], "id long, features array<double>, target int")


def test_knn_over_many_groups_parts_and_slices(spark, monkeypatch):  # F16, F17
    """Cells share groups, large cells are cut, data comes in slices: equal to brute force, with ties and copies."""
    for name, value in {"GROUPS": 5, "SLICES": 3, "LEAST_ROWS": 8, "GROUP_BYTES": 40 * 24, "QUERY_LEAF": 7, "DATA_LEAF": 11}.items():
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 6, (300, 3)), rng.normal(50, 0.1, (150, 3)), np.full((20, 3), 2.0)]).astype(float)
    df = vectors(spark, x)
    got = {(r.id, r.rank, r.nn_id): r.dist for r in N.knn(df.filter("id % 2 = 0"), df, 4, cell_size=30, sample_size=64).collect()}
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    want = {}
    for i in range(0, len(x), 2):
        for rank, j in enumerate(np.lexsort((np.arange(len(x)), dist[i]))[:4], 1):
            want[i, rank, int(j)] = pytest.approx(float(dist[i, j]), rel=1e-12)
    assert got == want


def test_knn_of_fewer_rows_than_k(spark):
    df = vectors(spark, np.array([[0.0, 0.0], [3.0, 4.0], [6.0, 8.0]]))
    got = sorted((r.id, r.rank, r.nn_id, r.dist) for r in N.knn(df, df, 5).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 10.0), (1, 1, 0, 5.0), (1, 2, 2, 5.0), (2, 1, 1, 5.0), (2, 2, 0, 10.0)]
    assert N.knn(df.limit(0), df, 2).count() == 0 and N.knn(df, df.limit(0), 2).count() == 0


@pytest.mark.parametrize("run", [B.adasyn, B.borderline_smote, B.smote_tomek])
def test_a_search_runs_once(spark, monkeypatch, run):  # F1, F18, F20, F21
    """Whatever reads the neighbours: their rows are made once, not once per reader."""
    rng = np.random.default_rng(6)
    target = (np.arange(240) % 8 == 0).astype(int)
    df = vectors(spark, rng.normal(size=(240, 3)) + target[:, None] * 0.5, target)
    made, wanted = spark.sparkContext.accumulator(0), []
    search = N.knn

    def counted(query, data, k, **options):
        found = search(query, data, k, **options)
        wanted.append(search(query, data, k, **options).count())

        def count(batches):
            for batch in batches:
                made.add(len(batch))
                yield batch
        return found.mapInPandas(count, found.schema)

    monkeypatch.setattr(N, "knn", counted)
    run(df).groupBy("target").count().collect()
    assert wanted and made.value == sum(wanted)


def test_block_windows_get_tasks_by_their_rows(spark, monkeypatch):  # F24, F26
    from outagelens.operators import windows as W

    cands = spark.range(200).select((F.col("id") % 7).cast("string").alias("county_fips"), F.timestamp_seconds(F.col("id") * 5000).alias("prediction_time"))
    events = spark.range(300).select((F.col("id") % 7).cast("string").alias("county_fips"), F.timestamp_seconds(F.col("id") * 3000).alias("event_time"),
                                     (F.col("id") % 11).cast("double").alias("v"))
    trails = [W.Trail("n", "count", 24), W.Trail("s", "sum", 24, "v"), W.Trail("m", "mean", 72, "v")]
    want = sorted(map(tuple, W.trailing(cands, events, trails).collect()))
    monkeypatch.setattr(W, "TASK_ROWS", 50)
    many = W.trailing(cands, events, trails)
    assert sorted(map(tuple, many.collect())) == want
    rows = 2 * 300 + 2 * 200 * 3
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression [_key" in plan and f", {-(-rows // 50)}" in plan


def test_blocks_of_the_binned_matrix_hold_many_batches(spark):  # F2 to F15, F19, F22
    from outagelens.operators import trees as T

    df = spark.range(3000).select((F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 2).alias("target")).repartition(3).persist()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        blocks = T._blocks(df, ["a"], "target", [F.lit(1.0)], T.bin_bounds(df, ["a"])).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        df.unpersist()
    assert len(blocks) == 3 and sum(len(b["label"]) for b in blocks) == 3000


@pytest.mark.parametrize("kind", ["copies", "gradients", "weighted"])
def test_sums_side_by_side_are_exact(kind):
    from outagelens.operators import trees as T

    rng = np.random.default_rng(7)
    n = T.BLOCK_ROWS
    y = rng.integers(0, 2, n)
    if kind == "copies":
        h = rng.integers(1, 12, n).astype(float)
        g = h * y
    else:
        w = np.ones(n) if kind == "gradients" else rng.random(n) * 1e5
        p = rng.random(n)
        g, h = w * (y - p), w * p * (1 - p)
    value = np.stack([np.rint(g * T._ONE), np.rint(h * T._ONE), np.ones(n)])
    cell = rng.integers(0, 40, (n, 2))
    cell[: n // 2] = 3
    got = T._added_up(cell, value, 40)
    want = np.zeros((3, 40), dtype=object)
    for column in cell.T:
        for v, out in zip(value, want):
            np.add.at(out, column, v.astype(np.int64).astype(object))
    assert (got.astype(object) == want).all()


def test_a_forests_step_sends_no_more_than_its_rows(monkeypatch):  # F3, F4, F12, F14
    """Where nodes have few rows, a step sends the drawn codes of the rows, not the sums of their cells; both make the same histograms."""
    from outagelens.operators import trees as T

    rng = np.random.default_rng(8)
    n, f = 3000, 9
    block = {"codes": rng.integers(0, T.BINS, (n, f)).astype(np.uint8), "label": rng.integers(0, 2, n).astype(float), "weights": np.ones((n, 1)),
             "ids": rng.integers(0, 2**63, n).astype(np.uint64), "margins": np.zeros((n, 1))}
    spec = T.Spec("forest", depth=12, min_weight=0.0, l2=0.0)
    inner = 127  # a full tree over feature 0 .. 6, halved at the middle code; 128 leaves are open
    feature = np.array([int(np.log2(k + 1)) for k in range(inner)] + [-1] * (inner + 1))
    number = np.arange(2 * inner + 1)
    arrays = (feature, np.full(2 * inner + 1, T.BINS // 2 - 1), np.where(feature >= 0, 2 * number + 1, -1), np.where(feature >= 0, 2 * number + 2, -1))
    asked = [(0, spec, 3, arrays, list(range(inner, 2 * inner + 1)))]
    parts = dict(T._partial([block], asked, f))
    assert sum(np.asarray(a).nbytes for part in parts.values() for a in part) <= n * 8

    nodes = np.arange(inner, 2 * inner + 1)
    for (_, _, share), part in parts.items():
        of = nodes[share * 32 : (share + 1) * 32]
        got, drawn = T._dense([part], len(of), 3), T._drawn(spec, 3, of, f)
        at, weight = T.routed(block["codes"], arrays), T.row_weights(spec, block["ids"], 3)
        for k, node in enumerate(of.tolist()):
            for j, column in enumerate(drawn[k].tolist()):
                rows = (at == node) & (weight > 0)
                for v, mine in zip((weight * block["label"] * T._ONE, weight * T._ONE, np.ones(n)), got[:, k, j]):
                    assert np.array_equal(np.bincount(block["codes"][rows, column], v[rows], T.BINS), mine)


def test_block_windows_sort_once(spark):  # F23
    """Frames of several lookbacks come from one window over the rows, and an ask is one row of it for each piece of its frame."""
    from outagelens.operators import windows as W

    at = [(k % 3, 3600 * h) for k, h in enumerate([0, 5, 5, 24, 29, 48, 72, 100])]
    events = spark.createDataFrame([(str(k), s, float(s % 7 + 1)) for k, s in at], "county_fips string, s long, v double").withColumn("event_time", F.timestamp_seconds("s")).drop("s")
    cands = spark.createDataFrame([(str(k), 3600 * h) for k in range(3) for h in (0, 5, 24, 29, 53, 72, 73, 168)], "county_fips string, s long").withColumn(
        "prediction_time", F.timestamp_seconds("s"))
    specs = [W.Trail("n", "count", 24), W.Trail("total", "sum", 24, "v"), W.Trail("hi", "max", 72, "v")]
    for closed in (False, True):
        out = W.trailing(cands, events, specs, closed_end=closed)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) == 1
        for r in out.collect():
            def frame(h, r=r):
                return [s % 7 + 1.0 for k, s in at if str(k) == r["county_fips"] and r["s"] - 3600 * h <= s and (s <= r["s"] if closed else s < r["s"])]
            assert (r["n"], r["total"], r["hi"]) == (len(frame(24)), sum(frame(24)), max(frame(72), default=None)), r
