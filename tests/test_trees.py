"""Tree models: against a plain numpy version, the split-size rule, and independence from partitioning and company."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelens.operators import trees as T

COLS = ["a", "b", "c", "d"]


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[:, 3] = rng.integers(0, 3, n)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 3] > 0.5)).astype(int)
    flip = rng.random(n) < 0.05
    return x, np.where(flip, 1 - y, y)


@pytest.fixture(scope="module")
def frame(spark):
    def make(x, y, parts=3):
        rows = [(*map(float, r), int(t)) for r, t in zip(x, y)]
        return spark.createDataFrame(rows, "a double, b double, c double, d double, target int").repartition(parts)
    return make


def plain_boosting(spec, x, y, bounds, ids):
    """Rows of scores of a boosted model, node by node, without histograms by subtraction, steps or tasks."""
    codes = np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(bounds)], 1)
    share = y.mean()
    start = math.log(share / (1 - share))
    margin = np.full(len(y), start)
    for r in range(spec.trees):
        used = T.row_weights(spec, ids, r)
        columns = T.features_of_tree(spec, r, x.shape[1])
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(used * (y - p) * T._ONE), np.rint(used * p * (1 - p) * T._ONE)
        l2 = spec.l2 * T._ONE

        def best(rows):
            G, H, out = g[rows].sum(), h[rows].sum(), (1e-9, None)
            for f in columns:
                for c in range(T.BINS - 1):
                    left = codes[rows, f] <= c
                    live = used[rows] > 0
                    nl, nr = (left & live).sum(), (~left & live).sum()
                    GL, HL = g[rows][left].sum(), h[rows][left].sum()
                    if nl < spec.min_leaf or nr < spec.min_leaf or nl + nr < spec.min_split or HL < spec.min_weight * T._ONE or H - HL < spec.min_weight * T._ONE:
                        continue
                    gain = (GL ** 2 / (HL + l2) + (G - GL) ** 2 / (H - HL + l2) - G ** 2 / (H + l2)) / T._ONE
                    if gain > out[0] * (1 + 1e-12) + 1e-15 * (out[1] is not None):
                        out = (gain, (f, c))
            return out

        leaves, queue, n = {0: (np.arange(len(y)), 0)}, [], 1
        gain, split = best(leaves[0][0])
        if split:
            heapq.heappush(queue, (-gain, 0, split))
        number = 1
        while queue and (spec.kind == "level" or n < spec.leaves):
            _, node, (f, c) = heapq.heappop(queue)
            rows, depth = leaves.pop(node)
            n += 1
            for part in (rows[codes[rows, f] <= c], rows[codes[rows, f] > c]):
                leaves[number] = (part, depth + 1)
                if depth + 1 < spec.depth:
                    gain, split = best(part)
                    if split:
                        heapq.heappush(queue, (-gain, number, split))
                number += 1
        for rows, _ in leaves.values():
            margin[rows] += spec.rate * g[rows].sum() / (h[rows].sum() + l2)
    return 1 / (1 + np.exp(-margin))


def row_ids(spark, df):
    cols = [F.col(c) for c in COLS]
    return df.select(*COLS, "target", F.xxhash64(*cols, F.col("target").cast("double")).alias("h")).toPandas()


@pytest.mark.parametrize("kind, leaves", [("leaf", 6), ("level", 31)])
def test_boosting_equals_the_plain_version(spark, frame, kind, leaves):
    x, y = sample(500)
    df = frame(x, y)
    spec = T.Spec(kind, trees=6, depth=4, leaves=leaves, rate=0.3, min_leaf=3, columns=0.75)
    model = T.fit_many(df, COLS, {"m": spec})["m"]
    rows = row_ids(spark, df)
    x, y = rows[COLS].to_numpy(), rows["target"].to_numpy()
    want = plain_boosting(spec, x, y, T.bin_bounds(df, COLS), rows["h"].to_numpy().view(np.uint64))
    assert np.allclose(model.score(x), want, atol=1e-9)
    per_tree = np.bincount(model.tree, model.feature < 0)
    assert per_tree.max() <= leaves and (kind == "level" or per_tree.max() == leaves)


def test_same_trees_under_any_partitioning_and_company(spark, frame):
    x, y = sample(600, 1)
    leaf, forest = T.Spec("leaf", trees=4, leaves=8), T.Spec("forest", trees=5, depth=6, min_leaf=3, min_split=10, min_weight=0, l2=0)
    alone = T.fit_many(frame(x, y, 1), COLS, {"leaf": leaf})["leaf"]
    both = T.fit_many(frame(x, y, 7), COLS, {"forest": forest, "leaf": leaf, "level": T.Spec("level", trees=2, depth=3)})
    again = T.fit_many(frame(x, y, 2), COLS, {"forest": forest})["forest"]
    for one, other in ((alone, both["leaf"]), (again, both["forest"])):
        for c in ("tree", "node", "feature", "threshold", "left", "right", "value", "rows"):
            assert np.array_equal(getattr(one, c), getattr(other, c)), c


def test_forest_keeps_the_split_size(frame, tmp_path, spark):
    x, y = sample(1500, 2)
    spec = T.Spec("forest", trees=12, depth=15, min_leaf=5, min_split=10, min_weight=0, l2=0)
    model = T.fit_many(frame(x, y), COLS, {"rf": spec})["rf"]
    model.save(str(tmp_path / "rf"))
    nodes = spark.read.parquet(str(tmp_path / "rf/nodes"))
    assert nodes.filter("feature >= 0 AND rows < 10").count() == 0 and nodes.filter("rows < 5").count() == 0
    assert nodes.filter("feature >= 0").count() > 100
    x2, y2 = sample(800, 3)
    assert ((model.score(x2) > 0.5) == y2).mean() > 0.85
    assert np.array_equal(T.TreeModel.load(str(tmp_path / "rf")).score(x2), model.score(x2))
    assert abs(sum(model.importances()) - 1) < 1e-9


def test_weights_choose_the_rows(frame, spark):
    """Folds as weights of one matrix give the models of separate fits on these rows."""
    x, y = sample(900, 4)
    df = frame(x, y).withColumn("fold", F.pmod(F.xxhash64("a", "b"), F.lit(3)))
    spec = T.Spec("leaf", trees=3, leaves=5)
    bounds = T.bin_bounds(df, COLS)
    folds = T.fit_many(df, COLS, {f"f{k}": spec for k in range(3)}, weights={f"f{k}": (F.col("fold") != k).cast("double") for k in range(3)})
    for k in range(3):
        model = folds[f"f{k}"]
        rows = row_ids(spark, df.filter(F.col("fold") != k))
        want = plain_boosting(spec, rows[COLS].to_numpy(), rows["target"].to_numpy(), bounds, rows["h"].to_numpy().view(np.uint64))
        assert np.allclose(model.score(rows[COLS].to_numpy()), want, atol=1e-9)


def test_scores_and_odd_rows(spark, frame):
    x, y = sample(300, 5)
    df = frame(x, y).union(spark.createDataFrame([(None, 1.0, float("nan"), 0.0, 1), (0.0, None, 0.0, 1.0, None)], frame(x[:1], y[:1]).schema))
    models = T.fit_many(df, COLS, {"m": T.Spec("leaf", trees=3, leaves=4), "f": T.Spec("forest", trees=3, depth=3, l2=0, min_weight=0)})
    rows = T.scored(df, models).collect()
    assert len(rows) == 302 and all(0 <= r["p_m"] <= 1 and 0 <= r["p_f"] <= 1 for r in rows)
    one_class = T.fit_many(frame(x, np.ones(300)), COLS, {"m": T.Spec("leaf", trees=2)})["m"]
    assert (one_class.feature < 0).all() and (one_class.score(x) > 0.99).all()
    none = T.fit_many(frame(x, y).limit(0), COLS, {"m": T.Spec("level", trees=2)})["m"]
    assert (none.score(x) == 0.5).all()


def test_splits_below_small_nodes_are_found_in_one_step(spark, frame, monkeypatch):  # F5 to F11, F13
    """The same trees whether nodes are counted step by step or finished where their rows meet, in fewer jobs."""
    x, y = sample(900, 6)
    df = frame(x, y)
    specs = {"leaf": T.Spec("leaf", trees=3, depth=7, leaves=12, min_leaf=3, l2=0.0, min_weight=0.001), "level": T.Spec("level", trees=3, depth=6, columns=0.75)}
    made, jobs = [], []
    for most in (0, 100, 400, 10_000):
        monkeypatch.setattr(T, "LOCAL_ROWS", most, raising=False)
        spark.sparkContext.setJobGroup(f"trees-{most}", "")
        made.append(T.fit_many(df, COLS, specs))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees-{most}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for models in made[1:]:
        for name in specs:
            for c in ("tree", "node", "feature", "threshold", "left", "right", "value", "gain", "rows"):
                assert np.array_equal(getattr(made[0][name], c), getattr(models[name], c)), (name, c)
    assert jobs[3] <= jobs[0] - 3 * 4 and jobs[3] < jobs[1]
    monkeypatch.setattr(T, "LOCAL_TOTAL", 10, raising=False)
    many = T.fit_many(df, COLS, specs)
    assert all(np.array_equal(getattr(many[n], "value"), getattr(made[0][n], "value")) for n in specs)


def test_small_nodes_wait_for_one_step_a_round(spark, frame, monkeypatch):  # F6 to F10
    """However unevenly nodes become small, the rows are sent once a round, and only rows with weight count as a model's rows."""
    x, y = sample(900, 8)
    df = frame(x, y)
    specs = {"leaf": T.Spec("leaf", trees=2, depth=7, leaves=12, min_leaf=3, l2=0.0, min_weight=0.001), "level": T.Spec("level", trees=2, depth=6)}
    counted = T.fit_many(df, COLS, specs)
    steps, step = [], T._splits_below
    monkeypatch.setattr(T, "_splits_below", lambda *a: steps.append(1) or step(*a))
    monkeypatch.setattr(T, "LOCAL_ROWS", 150)
    few = T.fit_many(df, COLS, specs)
    assert len(steps) == 2
    for n in specs:
        for c in ("tree", "node", "feature", "threshold", "left", "right", "value", "gain", "rows"):
            assert np.array_equal(getattr(counted[n], c), getattr(few[n], c)), (n, c)
    # two models of 450 rows each and many without
    steps.clear()
    monkeypatch.setattr(T, "LOCAL_TOTAL", 1000)
    half = F.col(COLS[0]) < float(np.sort(x[:, 0])[450])
    T.fit_many(df, COLS, specs, weights={"leaf": F.when(half, 1.0).otherwise(0.0), "level": F.when(half, 0.0).otherwise(1.0)})
    assert len(steps) == 2


def test_trees_of_forests_grow_where_their_rows_meet(spark, frame, monkeypatch):  # F8
    """The same trees as level by level, in one step, also with weights that are no whole numbers and with rows of another model."""
    x, y = sample(1500, 9)
    df = frame(x, y)
    specs = {"plain": T.Spec("forest", trees=3, depth=9, min_leaf=2, min_split=4, l2=0.0, min_weight=0.0),
             "weighted": T.Spec("forest", trees=2, depth=5, l2=0.0, min_weight=0.0), "stump": T.Spec("forest", trees=1, depth=0, l2=0.0, min_weight=0.0)}
    weights = {"weighted": F.when(F.col("a") < 0.5, F.col("target") * 1.3 + 0.7).otherwise(0.0)}
    made, jobs = [], []
    for most, together, cells in ((0, 1, 1), (10_000, 512 << 20, 1 << 18), (10_000, 1, 600)):
        monkeypatch.setattr(T, "FOREST_ROWS", most, raising=False)
        monkeypatch.setattr(T, "FOREST_BYTES", together, raising=False)
        monkeypatch.setattr(T, "FOREST_CELLS", cells, raising=False)
        spark.sparkContext.setJobGroup(f"forest-{most}-{cells}", "")
        made.append(T.fit_many(df, COLS, specs, weights=weights))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{most}-{cells}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for models in made[1:]:
        for n in specs:
            for c in ("tree", "node", "feature", "threshold", "left", "right", "value", "gain", "rows"):
                assert np.array_equal(getattr(made[0][n], c), getattr(models[n], c)), (n, c)
    assert jobs[1] <= jobs[0] - 5


def test_boosted_rounds_keep_only_rows_of_boosted_models(spark, frame, monkeypatch):  # F10
    """Rows and weights of a forest don't go through the rounds of boosted models in its company; the trees are those of the model alone."""
    x, y = sample(900, 10)
    df, mine = frame(x, y), F.col("a") < 0.1
    spec, seen = T.Spec("level", trees=2, depth=4), []
    grow = T._grow_round
    monkeypatch.setattr(T, "_grow_round", lambda state, *a: seen.extend(state.map(lambda b: (*b["weights"].shape, b["margins"].shape[1])).collect()) or grow(state, *a))
    both = T.fit_many(df, COLS, {"f": T.Spec("forest", trees=2, depth=3, l2=0, min_weight=0), "m": spec}, weights={"m": F.when(mine, 1.0).otherwise(0.0)})
    held = int((x[:, 0] < 0.1).sum())
    assert sum(n for n, _, _ in seen) == 2 * held and {(w, m) for _, w, m in seen} == {(1, 1)}
    alone = T.fit_many(df, COLS, {"m": spec}, weights={"m": F.when(mine, 1.0).otherwise(0.0)})
    for c in ("tree", "node", "feature", "threshold", "left", "right", "value", "gain", "rows"):
        assert np.array_equal(getattr(both["m"], c), getattr(alone["m"], c)), c


def test_small_nodes_count_the_smaller_child_and_are_dealt_by_size(monkeypatch):  # F7
    """Splits below a node: at most half a level's rows are counted, and what the leaves can't reach is not looked at; big nodes don't meet in one task."""
    rng = np.random.default_rng(11)
    codes = rng.integers(0, T.BINS, (3000, 4)).astype(np.uint8)
    part = (codes, np.rint(rng.normal(size=3000) * T._ONE), np.full(3000, T._ONE / 4))
    counted, totals = [], T._totals
    monkeypatch.setattr(T, "_totals", lambda slot, *a: counted.append(len(slot)) or totals(slot, *a))
    _, level = T._below(T.Spec("level", depth=6), 0, np.arange(4), [part])
    assert len(counted) == 6 and counted[0] == 3000 and max(counted[1:]) <= 1500
    _, leaf = T._below(T.Spec("leaf", depth=6, leaves=4), 0, np.arange(4), [part])
    assert len(leaf) < len(level) and all(level[k] == split for k, split in leaf.items())
    task_of = T._dealt({(0, 1): 500, (0, 2): 490, (1, 1): 480, (1, 2): 10, (1, 3): 5}, 3)
    assert len({task_of[k] for k in ((0, 1), (0, 2), (1, 1))}) == 3


def test_large_models_are_saved_and_read_in_parts(spark, tmp_path, monkeypatch):
    trees, nodes = 6, 31
    rng, n = np.random.default_rng(3), 6 * 31
    node = np.tile(np.arange(nodes), trees)
    inner = node < 15
    columns = [np.repeat(np.arange(trees), nodes), node, np.where(inner, rng.integers(0, 4, n), -1), rng.normal(size=n), np.where(inner, 2 * node + 1, -1),
               np.where(inner, 2 * node + 2, -1), rng.random(n), rng.random(n), rng.random(n)]
    kinds = [np.float64 if c.split()[1] == "double" else np.int32 for c in T.TreeModel.COLUMNS.split(", ")]
    model = T.TreeModel("forest", COLS, 0.0, [c.astype(k) for c, k in zip(columns, kinds)])
    monkeypatch.setattr(T, "SAVE_NODES", 70)
    model.save(str(tmp_path / "m"))
    written = [spark.read.parquet(str(f)).count() for f in (tmp_path / "m" / "nodes").glob("*.parquet")]
    assert sum(written) == n and max(written) <= 70  # one task would carry all nodes
    loaded = T.TreeModel.load(str(tmp_path / "m"))
    for name in (c.split()[0] for c in T.TreeModel.COLUMNS.split(", ")):
        assert getattr(loaded, name).dtype == getattr(model, name).dtype and np.array_equal(getattr(loaded, name), getattr(model, name))
    x = rng.normal(size=(50, 4))
    assert np.array_equal(model.for_scoring().score(x), loaded.score(x))
    T.TreeModel("forest", COLS, 0.0, [c[:0] for c in loaded._columns().values()]).save(str(tmp_path / "none"))
    assert T.TreeModel.load(str(tmp_path / "none")).score(x).tolist() == [0.0] * 50
