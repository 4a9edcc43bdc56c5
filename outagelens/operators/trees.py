"""Tree models on a binned matrix: many forests and boosted models grown together, one Spark job per step.

Features are binned once to bytes and held as blocks of rows. A step asks for the gradient and hessian histograms of all
open nodes of all models at once: each task adds up its rows (map-side partial histograms of the occupied cells), the
partial sums are added by node, and the driver only sees sums whose size depends on nodes, features and bins. A model's training rows
are a weight vector, so folds and sampling strategies share the matrix and the pass.

Boosted models grow by level (``level``) or leaf by leaf (``leaf``): there the open leaf with the largest gain is split next, whatever its
depth, until the leaves are used up. All leaves that may come next are counted in one step, so that a tree takes about as many steps as levels; what is not
reached in the end is cut off again. Only the smaller child of a split is counted, its sibling is the parent's histogram less that. Gradients are
rounded to multiples of 2**-20, so sums are exact and trees don't depend on the partitioning. Forests draw a Poisson number of
copies of each row per tree, and for each node the features it may split on; a node below ``min_split`` rows stays a leaf. Trees over few rows
(``FOREST_ROWS``) are grown by the same levels in the task where a tree's rows meet, so the rows are sent and routed once instead of once a level.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Codes of a feature, and rows from which their bounds are taken (those of least hash, whatever the partitioning).
BINS, BOUND_ROWS = 64, 20_000
#: Rows of a block at most (sums of a block fit into a double together, see ``_added_up``); rows of a task at least and, about, at most.
BLOCK_ROWS, TASK_ROWS, MOST_ROWS = 32_768, 4_000, 500_000
#: Nodes whose sums are handled together, rows that are scored together, and bytes of a forest's step that meet in a task, about.
SHARE, SCORE_ROWS, MEET_BYTES = 32, 8_192, 32 << 20
#: Bytes of partial sums that the driver may be sent by all tasks of a step.
SENT_BYTES = 64 << 20
#: Rows of a boosted model's node up to which one task finds all splits below it, and rows of all models up to which that is done: every round sends
#: the rows once, so beyond that, where a step's fixed time matters less, all nodes are counted step by step.
LOCAL_ROWS, LOCAL_TOTAL = 65_536, 1_000_000
#: Rows of a forest up to which a tree is grown in the task where its rows meet, bytes of rows that are sent together for that, and cells counted together.
FOREST_ROWS, FOREST_BYTES, FOREST_CELLS = 1_000_000, 512 << 20, 1 << 18
#: Boosting rounds after which the state is written to the checkpoint folder.
KEEP_EVERY = 25
#: Nodes of a saved model that pass between the driver and the tasks at a time (some 50 bytes each), unless one tree has more when it is read; tasks that write them.
SAVE_NODES, SAVE_TASKS = 1 << 20, 8
_ONE = float(1 << 20)
_U64 = np.uint64


@dataclass(frozen=True)
class Spec:
    """Settings of one model. ``kind``: forest, level or leaf."""

    kind: str
    trees: int = 200
    depth: int = 8
    leaves: int = 31
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    min_leaf: int = 1
    min_split: int = 2
    min_weight: float = 1.0
    l2: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes as lists: the feature and code to split on (-1: leaf), children, sums (gradient, hessian, rows), gain."""

    feature: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sums: list[tuple[float, float, float]] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, depth: int, sums: tuple[float, float, float]) -> int:
        for column, value in ((self.feature, -1), (self.code, 0), (self.left, -1), (self.right, -1), (self.depth, depth), (self.sums, sums), (self.gain, 0.0)):
            column.append(value)
        return len(self.feature) - 1

    def split(self, node: int, found: "Split") -> tuple[int, int]:
        g, h, n = self.sums[node]
        left = self.add(self.depth[node] + 1, found.left)
        right = self.add(self.depth[node] + 1, (g - found.left[0], h - found.left[1], n - found.left[2]))
        self.feature[node], self.code[node], self.left[node], self.right[node], self.gain[node] = found.feature, found.code, left, right, found.gain
        return left, right

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(c, np.int32) for c in (self.feature, self.code, self.left, self.right))


class ForestTree:
    """A tree that grows by whole levels, its nodes as arrays (see ``Tree``; ``sums`` is nodes x 3)."""

    def __init__(self):
        self.feature, self.code, self.left, self.right = (np.full(1, v, np.int32) for v in (-1, 0, -1, -1))
        self.sums, self.gain = np.zeros((1, 3)), np.zeros(1)

    def split(self, nodes: np.ndarray, feature: np.ndarray, code: np.ndarray, gain: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Splits nodes; the numbers of the children, two for each node in its order."""
        children = len(self.feature) + np.arange(2 * len(nodes))
        self.feature[nodes], self.code[nodes], self.gain[nodes] = feature, code, gain
        self.left[nodes], self.right[nodes] = children[::2], children[1::2]
        sums = np.stack([left, self.sums[nodes] - left], 1).reshape(-1, 3)
        for name, none in (("feature", -1), ("code", 0), ("left", -1), ("right", -1)):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(len(children), none, np.int32)]))
        self.sums, self.gain = np.concatenate([self.sums, sums]), np.concatenate([self.gain, np.zeros(len(children))])
        return children

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.feature, self.code, self.left, self.right


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    code: int
    left: tuple[float, float, float]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each id, by hash."""
    for s in salt:
        ids = mixed(ids + _U64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
    return (mixed(ids) >> _U64(11)).astype(np.float64) / float(1 << 53)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def row_weights(spec: Spec, ids: np.ndarray, tree: int) -> np.ndarray:
    """How often each row counts in a tree."""
    u = uniform(ids, spec.seed, tree)
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64) if spec.kind == "forest" else (u < spec.rows).astype(np.float64)


def features_of_tree(spec: Spec, tree: int, n: int) -> np.ndarray:
    """Columns that a boosted tree may use."""
    keep = max(1, int(spec.columns * n))
    return np.sort(np.argsort(uniform(np.arange(n, dtype=_U64), spec.seed, tree, 1), kind="stable")[:keep])


def features_of_nodes(spec: Spec, tree: int, nodes: np.ndarray, n: int) -> np.ndarray:
    """Columns that each node of a forest's tree may use (nodes x drawn)."""
    keep = max(1, int(math.sqrt(n)))
    u = uniform(nodes.astype(_U64)[:, None] * _U64(n) + np.arange(n, dtype=_U64), spec.seed, tree, 2)
    return np.argsort(u, axis=1, kind="stable")[:, :keep]


def routed(codes: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf of a tree that each row comes to."""
    feature, code, left, right = tree
    inner, own = feature >= 0, np.arange(len(feature))
    column, bound = np.where(inner, feature, 0), np.where(inner, code, 0)
    child = np.stack([np.where(inner, left, own), np.where(inner, right, own)], 1).reshape(-1)  # a leaf leads to itself
    flat, first = np.ascontiguousarray(codes).reshape(-1), np.arange(len(codes)) * codes.shape[1]
    at, reached = np.zeros(len(codes), np.intp), np.zeros(1, np.intp)
    while True:
        reached = reached[inner[reached]]
        if not len(reached):
            return at
        reached = np.concatenate([left[reached], right[reached]])
        at = child[2 * at + (flat[first + column[at]] > bound[at])]


# ---- one step

def best_places(spec: Spec, hist: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node (3 x nodes x columns x bins) the best split's gain, column, code and sums to the left; ties to the first column and code."""
    below = np.cumsum(hist, axis=3)
    g, h, n = below[..., :-1]
    all_g, all_h, all_n = below[..., -1:]
    rest_g, rest_h, rest_n = all_g - g, all_h - h, all_n - n
    l2, least = spec.l2 * _ONE, spec.min_weight * _ONE
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / (h + l2) + rest_g * rest_g / (rest_h + l2) - all_g * all_g / (all_h + l2)
    ok = (n >= max(1, spec.min_leaf)) & (rest_n >= max(1, spec.min_leaf)) & (all_n >= spec.min_split) & (h >= least) & (rest_h >= least) & (h > 0) & (rest_h > 0)
    flat = np.where(ok, gain, 0.0).reshape(gain.shape[0], -1) / _ONE
    at, node = flat.argmax(axis=1), np.arange(len(flat))
    f, c = np.divmod(at, hist.shape[3] - 1)
    return flat[node, at], f, c, below[:, node, f, c].T


def best_splits(spec: Spec, hist: np.ndarray, columns: np.ndarray) -> list[Split | None]:
    """The best split of each node over the given columns."""
    gain, f, c, left = best_places(spec, hist)
    return [Split(*found[:3], tuple(found[3])) if found[0] > 1e-9 else None for found in zip(gain.tolist(), columns[f].tolist(), c.tolist(), left.tolist())]


def _drawn(spec: Spec, tree: int, nodes: Sequence[int], n_features: int) -> np.ndarray:
    """The columns, in order, of each node (nodes x columns), or in one row those of all nodes."""
    if spec.kind == "forest":
        return np.sort(features_of_nodes(spec, tree, np.asarray(nodes), n_features), axis=1)
    return features_of_tree(spec, tree, n_features)[None, :]


def _asked_rows(block: dict, model: int, spec: Spec, tree: int, arrays: tuple, slot_of: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one block's rows in the open nodes: the node's place, codes (rows x drawn columns), gradient and hessian."""
    weight = block["weights"][:, model]
    rows = np.flatnonzero(weight > 0)
    weight = weight[rows] * row_weights(spec, block["ids"][rows], tree)
    live = weight > 0
    rows, weight = rows[live], weight[live]
    slot = slot_of[routed(block["codes"][rows], arrays)]
    held = slot >= 0
    rows, weight, slot = rows[held], weight[held], slot[held]
    y = block["label"][rows]
    if spec.kind == "forest":
        g, h = weight * y, weight
    else:
        p = 1 / (1 + np.exp(-block["margins"][rows, model]))
        g, h = weight * (y - p), weight * p * (1 - p)
    columns = drawn[slot] if len(drawn) > 1 else drawn
    codes = block["codes"].reshape(-1)[(rows * block["codes"].shape[1])[:, None] + columns]
    return slot, codes, np.rint(g * _ONE), np.rint(h * _ONE)


def _added_up(cell: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Sums of the values by cell (3 x size). Whole numbers that fit into a double side by side are added in one go, exactly."""
    def summed(v: np.ndarray) -> np.ndarray:
        return np.bincount(cell.reshape(-1), np.repeat(v, cell.shape[1]), size)

    g, h, n = value
    whole = not (np.mod(g, _ONE).any() or np.mod(h, _ONE).any()) and (g >= 0).all() and (g <= h).all()
    wide = 2.0 ** math.ceil(math.log2(h.sum() / _ONE + 2))
    if whole and (len(n) + 1) * wide * wide < 2**53:  # copies of rows: count, copies and copies of class 1
        sums = summed((wide + h / _ONE) * wide + g / _ONE)
        rows = np.floor(sums / (wide * wide))
        sums -= rows * wide * wide
        copies = np.floor(sums / wide)
        return np.stack([(sums - copies * wide) * _ONE, copies * _ONE, rows])
    wide = 2.0 ** math.ceil(math.log2(2 * np.abs(g).sum() + 2))
    if (len(n) + 1) * wide < 2**53:
        sums = summed(wide + g)
        rows = np.rint(sums / wide)
        return np.stack([sums - rows * wide, summed(h), rows])
    return np.stack([summed(v) for v in value])


def _totals(slot: np.ndarray, codes: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """Sums by node, column and code (3 x cells) of rows, a block at a time."""
    d = codes.shape[1]
    sums = np.zeros((3, nodes * d * BINS))
    for at in range(0, len(slot), BLOCK_ROWS):
        part = slice(at, at + BLOCK_ROWS)
        cell = (slot[part].astype(np.intp) * d)[:, None] * BINS + np.arange(d) * BINS + codes[part]
        sums += _added_up(cell, np.stack([g[part], h[part], np.ones(len(cell))]), sums.shape[1])
    return sums


def _partial(blocks: list[dict], asked: list, n_features: int) -> Iterator[tuple[tuple, tuple]]:
    """((model, tree, share of the nodes), part) of a task's blocks for all models' open nodes.

    A part is (cells, sums). Where that takes more bytes than a forest's few rows in these nodes, it is the rows: (node, codes, gradient, hessian).
    """
    for model, spec, tree, arrays, nodes in asked if blocks else ():
        slot_of = np.full(len(arrays[0]), -1)
        slot_of[nodes] = np.arange(len(nodes))
        drawn = _drawn(spec, tree, nodes, n_features)
        found = [_asked_rows(block, model, spec, tree, arrays, slot_of, drawn) for block in blocks]
        slot, codes, g, h = (np.concatenate(x) for x in zip(*found)) if len(found) != 1 else found[0]
        if len(nodes) > SHARE:
            order = np.argsort((slot // SHARE).astype(np.uint16 if len(nodes) < SHARE << 16 else np.int64), kind="stable")
            slot, codes, g, h = slot[order], codes[order], g[order], h[order]
        ends = np.searchsorted(slot // SHARE, np.arange(-(-len(nodes) // SHARE) + 1))
        copies = spec.kind == "forest" and not np.mod(h, _ONE).any() and h.max(initial=0.0) <= 255 * _ONE
        for share, (first, last) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if last == first:
                continue
            of, held = min(SHARE, len(nodes) - share * SHARE), slice(first, last)
            here, width = (slot[held] - share * SHARE).astype(np.uint8), codes.shape[1]
            if spec.kind == "forest" and (last - first) * (width + 1 + (2 if copies else 16)) <= 16 * of * width * BINS:
                values = ((x[held] / _ONE).astype(np.uint8) for x in (g, h)) if copies else (g[held], h[held])
                yield (model, tree, share), (here, codes[held], *values)
            else:
                sums = _totals(here, codes[held], g[held], h[held], of)
                cells = np.flatnonzero(sums[2])
                yield (model, tree, share), (cells, sums[:, cells])


def _dense(parts: Sequence[tuple], nodes: int, columns: int) -> np.ndarray:
    """The histograms of a share's nodes (3 x nodes x columns x bins) from the parts of all tasks."""
    out = np.zeros((3, nodes * columns * BINS))
    rows = [part for part in parts if len(part) == 4]
    for cells, sums in (part for part in parts if len(part) == 2):
        out[:, cells] += sums
    if rows:
        values = [[v.astype(float) * _ONE if v.dtype == np.uint8 else v for v in part[2:]] for part in rows]
        out += _totals(*(np.concatenate(x) for x in zip(*(part[:2] for part in rows))), *(np.concatenate(x) for x in zip(*values)), nodes)
    return out.reshape(3, nodes, columns, BINS)


# ---- models

class TreeModel:
    """Trees of one model with the bounds of its bins. ``table()`` has a row for each node."""

    COLUMNS = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double, rows double"

    def __init__(self, spec_kind: str, features: Sequence[str], start: float, nodes: list[np.ndarray]):
        self.kind, self.features, self.start = spec_kind, list(features), start
        (self.tree, self.node, self.feature, self.threshold, self.left, self.right, self.value, self.gain, self.rows) = nodes
        self.roots = np.searchsorted(self.tree, np.unique(self.tree))

    @classmethod
    def made(cls, spec: Spec, features: Sequence[str], bounds: list[np.ndarray], start: float, trees: list[Tree | ForestTree]) -> "TreeModel":
        """The model of grown trees, which are taken out of ``trees`` one by one: the driver holds the nodes of a large forest once."""
        columns: list[list] = [[] for _ in range(9)]
        kinds = (np.int32, np.int32, np.int32, float, np.int32, np.int32, float, float, float)
        trees.reverse()
        for t in range(len(trees)):
            tree = trees.pop()
            feature, code, left, right = tree.arrays()
            sums, threshold = np.asarray(tree.sums, float), np.zeros(len(feature))
            g, h, n = sums.T
            if spec.kind == "forest":
                value = np.divide(g, h, out=np.zeros(len(h)), where=h != 0)
            else:
                value = spec.rate * g / (h + spec.l2 * _ONE)
            for f in np.unique(feature[feature >= 0]).tolist():
                threshold[feature == f] = bounds[f][code[feature == f]]
            row = (np.full(len(feature), t), np.arange(len(feature)), feature, threshold, left, right, value, tree.gain, n)
            for c, v, k in zip(columns, row, kinds):
                c.append(np.asarray(v, k))
        return cls(spec.kind, features, start, [_joined(c, k) for c, k in zip(columns, kinds)])

    def for_scoring(self) -> "TreeModel":
        """The model with what ``score`` reads only: every worker holds a copy of it."""
        out = copy.copy(self)
        out.tree = out.node = out.gain = out.rows = np.zeros(0)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(class 1) of rows (missing values go left)."""
        x = np.where(np.isnan(x), -np.inf, x)
        total = np.full(len(x), self.start)
        for root in self.roots.tolist():
            at, rows = np.full(len(x), root), np.arange(len(x))
            while True:
                inner = self.feature[at[rows]] >= 0
                if not inner.any():
                    break
                rows = rows[inner]
                node = at[rows]
                below = x[rows, self.feature[node]] <= self.threshold[node]
                at[rows] = root + np.where(below, self.left[node], self.right[node])
            total += self.value[at]
        return total / max(1, len(self.roots)) if self.kind == "forest" else 1 / (1 + np.exp(-total))

    def importances(self) -> list[float]:
        """Share of the gain that each feature brings."""
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], self.gain[inner], len(self.features))
        return (total / total.sum() if total.sum() > 0 else total).tolist()

    def _columns(self) -> dict[str, np.ndarray]:
        return {c.split()[0]: getattr(self, c.split()[0]) for c in self.COLUMNS.split(", ")}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(pa.table({n: pa.array(c) for n, c in self._columns().items()}))

    def save(self, path: str) -> None:
        """Two Parquet tables: the nodes, and one row with what else the model is made of.

        Rows of a local table are part of the plan and of the tasks, whose size is bounded; so the nodes are broadcast and written part by part.
        """
        spark = SparkSession.getActiveSession()
        for at in range(0, max(1, len(self.tree)), SAVE_NODES):
            held = {n: c[at : at + SAVE_NODES] for n, c in self._columns().items()}
            shared, step = spark.sparkContext.broadcast(held), max(1, -(-len(held["tree"]) // SAVE_TASKS))

            def part(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for first in batch.column(0).to_pylist():
                        yield pa.RecordBatch.from_pydict({n: c[first : first + step] for n, c in shared.value.items()})

            tasks = max(1, -(-len(held["tree"]) // step))
            spark.range(0, tasks * step, step, tasks).mapInArrow(part, self.COLUMNS).write.mode("append" if at else "overwrite").parquet(f"{path}/nodes")
            shared.destroy()
        spark.createDataFrame([(self.kind, self.features, float(self.start))], "kind string, features array<string>, start double").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str) -> "TreeModel":
        spark = SparkSession.getActiveSession()
        head = spark.read.parquet(f"{path}/model").first()
        nodes, parts = spark.read.parquet(f"{path}/nodes"), [[-1, -1, 0]]  # first and last tree, nodes
        for r in nodes.groupBy("tree").count().orderBy("tree").collect():
            if parts[-1][2] + r["count"] > SAVE_NODES:
                parts.append([r["tree"], r["tree"], 0])
            parts[-1][1], parts[-1][2] = r["tree"], parts[-1][2] + r["count"]
        columns: list[list] = [[] for _ in nodes.columns]
        for first, last, _ in parts:
            part = nodes.filter(F.col("tree").between(first, last)).toArrow()
            order = np.lexsort((part.column("node"), part.column("tree")))
            for c, values in zip(columns, part.columns):
                c.append(values.to_numpy()[order])
        return cls(head["kind"], head["features"], head["start"], [_joined(c, c[0].dtype) for c in columns])


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    """The parts in one array; the list is emptied."""
    out = np.concatenate([np.zeros(0, kind), *parts])
    parts.clear()
    return out


def scored(df: DataFrame, models: Mapping[str, TreeModel]) -> DataFrame:
    """Adds ``p_<name>`` of every model to the rows, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast({n: m.for_scoring() for n, m in models.items()})
    columns = sorted({f for m in models.values() for f in m.features})
    given = df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in columns]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # a tree has a fixed time for each call
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SCORE_ROWS:
                yield from done(held)
                held, n = [], 0
        if n:
            yield from done(held)

    def done(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.asarray(b.column(b.num_columns - 1).flatten().fill_null(np.nan), float) for b in batches]).reshape(-1, len(columns))
        made, at = [m.score(x[:, [columns.index(f) for f in m.features]]) for m in shared.value.values()], 0
        for batch in batches:
            mine = [pa.array(p[at : at + batch.num_rows]) for p in made]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *mine], [*batch.schema.names[:-1], *(f"p_{n}" for n in shared.value)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", `p_{n}` double" for n in models)
    return given.mapInArrow(run, schema)


# ---- training

def bin_bounds(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Of each feature, the values between its codes: every pair of neighbours, or evenly many rows a code."""
    x = df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    rows = x.withColumn("h", F.xxhash64(*x.columns)).orderBy("h", *x.columns).limit(BOUND_ROWS).drop("h").toArrow()
    bounds = []
    for column in rows.columns:
        v = np.sort(column.to_numpy().astype(float))
        v = v[~np.isnan(v)]
        distinct = np.unique(v)
        if len(distinct) > BINS:
            distinct = np.unique(v[np.linspace(0, len(v) - 1, BINS).round().astype(int)])
        bounds.append((distinct[1:] + distinct[:-1]) / 2)
    return bounds


def _blocks(df: DataFrame, features: Sequence[str], label: str, weights: Sequence, bounds: list[np.ndarray]):
    """The binned matrix as an RDD of blocks of rows."""
    cols = [F.col(f).cast("double") for f in features]
    rows = df.select(F.array(*cols).alias("x"), F.col(label).cast("double").alias("y"), F.array(*[F.coalesce(w.cast("double"), F.lit(0.0)) for w in weights]).alias("w"),
                     F.xxhash64(*cols, F.col(label).cast("double")).alias("h"))
    models = len(weights)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # a block is made of many batches: every step costs a fixed time for each block and model

        def block():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary()) for x in zip(*held)], ["codes", "label", "weights", "ids"])

        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                x = batch.column(0).flatten()
                x = np.asarray(x.fill_null(np.nan), float).reshape(batch.num_rows, len(features))
                x = np.where(np.isnan(x), -np.inf, x)
                codes = np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(bounds)], 1).astype(np.uint8)
                w = np.asarray(batch.column(2).flatten(), float)
                if held and n + batch.num_rows > BLOCK_ROWS:
                    yield block()
                    held, n = [], 0
                held.append((codes.tobytes(), np.asarray(batch.column(1), float).tobytes(), w.tobytes(), np.asarray(batch.column(3)).tobytes()))
                n += batch.num_rows
        if held:
            yield block()

    def unpack(row) -> dict:
        y = np.frombuffer(row["label"])
        return {"codes": np.frombuffer(row["codes"], np.uint8).reshape(len(y), -1), "label": y, "weights": np.frombuffer(row["weights"]).reshape(len(y), models),
                "ids": np.frombuffer(row["ids"], _U64), "margins": np.zeros((len(y), models))}

    return rows.mapInArrow(pack, "codes binary, label binary, weights binary, ids binary").rdd.map(unpack)


def fit_many(df: DataFrame, features: Sequence[str], specs: Mapping[str, Spec], label: str = "target", weights: Mapping | None = None) -> dict[str, TreeModel]:
    """All models of ``specs`` over the rows of ``df``, grown together. ``weights`` gives a model's row weights as a column (default 1; 0: not its row).

    Missing features count as the least value; rows without a label or with weight null are left out. Without rows, or with one class only, trees are
    single leaves.
    """
    spark, names = df.sparkSession, list(specs)
    checkpoint_dir(spark)
    df = df.filter(F.col(label).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    columns = [(weights or {}).get(n, F.lit(1.0)) for n in names]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"w{i}") for i, c in enumerate(columns)], *[F.sum(c * F.col(label)).alias(f"y{i}") for i, c in enumerate(columns)],
                  *[F.count_if(c > 0).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    bounds = bin_bounds(df, features)
    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(-(-sums["n"] // TASK_ROWS), cores * -(-sums["n"] // (MOST_ROWS * cores))))  # whole rounds of the cores
    state = _blocks(df.repartition(tasks, F.xxhash64(*features)) if sums["n"] else df, features, label, columns, bounds).persist(StorageLevel.MEMORY_AND_DISK)

    start = {}
    for i, n in enumerate(names):
        share = min(max((sums[f"y{i}"] or 0.0) / sums[f"w{i}"], 1e-6), 1 - 1e-6) if sums[f"w{i}"] else 0.5
        start[n] = 0.0 if specs[n].kind == "forest" else math.log(share / (1 - share))
    models: dict[str, list] = {n: [] for n in names}
    f = len(features)
    forests = [n for n in names if specs[n].kind == "forest"]
    if forests:
        few = [n for n in forests if sums[f"n{names.index(n)}"] <= FOREST_ROWS]
        _grow_where_rows_meet(state, names, {n: specs[n] for n in few}, models, f, {n: sums[f"n{names.index(n)}"] for n in few})
        _grow_forests(state, names, {n: specs[n] for n in forests if n not in few}, models, f, sums["n"])
    boosted = [n for n in names if specs[n].kind != "forest"]
    if boosted:
        places, offsets, rows_of = [names.index(n) for n in boosted], np.array([start[n] for n in boosted]), {n: sums[f"n{names.index(n)}"] for n in boosted}
        whole, state = state, _moved(state, lambda block: _of_models(block, places, offsets))
        for r in range(max(specs[n].trees for n in boosted)):
            now = [n for n in boosted if r < specs[n].trees]
            grown = _grow_round(state, boosted, {n: specs[n] for n in now}, r, f, rows_of)
            updates = [(boosted.index(n), t.arrays(), np.array([specs[n].rate * g / (h + specs[n].l2 * _ONE) for g, h, _ in t.sums])) for n, t in grown.items()]
            for n, t in grown.items():
                models[n].append(t)
            before, state = state, _moved(state, lambda block, updates=updates: _advanced(block, updates), write=r % KEEP_EVERY == KEEP_EVERY - 1)
            (older if r else whole).unpersist()  # the state before is there since this round's first step
            older = before
    state.unpersist()
    df.unpersist()
    return {n: TreeModel.made(specs[n], features, bounds, start[n], models.pop(n)) for n in names}


def _of_models(block: dict, models: list[int], offsets: np.ndarray) -> dict:
    """The rows that some of the models have, with these models' weights and first margins: every round handles and keeps them again."""
    weights = block["weights"][:, models]
    rows = np.flatnonzero((weights > 0).any(axis=1))
    return {"codes": block["codes"][rows], "label": block["label"][rows], "weights": weights[rows], "ids": block["ids"][rows],
            "margins": np.tile(offsets, (len(rows), 1))}


def _advanced(block: dict, updates: list) -> dict:
    margins = block["margins"].copy()
    for model, arrays, values in updates:
        rows = np.flatnonzero(block["weights"][:, model] > 0)  # the others' margins are never read
        margins[rows, model] += values[routed(block["codes"][rows], arrays)]
    return {**block, "margins": margins}


def _moved(state, step, write: bool = False):
    """The next state, computed by the next step that reads it."""
    after = state.map(step).persist(StorageLevel.MEMORY_AND_DISK)
    if write:
        after.checkpoint()
    return after


def _of_task(blocks: Iterator[dict], asked: list, n_features: int) -> Iterator[dict]:
    yield dict(_partial(list(blocks), asked, n_features))


def _added(a: tuple, b: tuple) -> tuple:
    """The sums of two parts of a share."""
    out = np.zeros((3, max(a[0].max(), b[0].max()) + 1))
    for cells, sums in (a, b):
        out[:, cells] += sums
    held = np.flatnonzero(out[2])
    return held, out[:, held]


def _merged(a: dict, b: dict) -> dict:
    return {k: _added(a[k], b[k]) if k in a and k in b else a.get(k) or b[k] for k in {**a, **b}}


def _sums(state, asked: list, n_features: int) -> dict:
    """Parts by (model, tree, share) of the asked nodes, of a size that nodes, features and bins bound: added up in a tree of tasks, or left to the driver where
    the parts of all tasks are small (one stage instead of two)."""
    parts: dict = {}
    if state.getNumPartitions() * sum(len(a[4]) for a in asked) * n_features * BINS * 32 <= SENT_BYTES:
        for part in state.mapPartitions(lambda blocks: _of_task(blocks, asked, n_features)).collect():
            for key, value in part.items():
                parts.setdefault(key, []).append(value)
        return parts
    return {k: [v] for k, v in state.mapPartitions(lambda blocks: _of_task(blocks, asked, n_features)).treeAggregate({}, _merged, _merged).items()}


def _found(state, asked: list, n_features: int, finish, tasks: int) -> dict:
    """What ``finish`` makes of the parts of each (model, tree, share), where they meet."""
    shared = state.context.broadcast(asked)
    counted = state.mapPartitions(lambda blocks: _partial(list(blocks), shared.value, n_features))
    result = dict(counted.groupByKey(tasks).map(finish).collect())
    shared.unpersist()
    return result


def _rows_of_nodes(blocks: list[dict], asked: list, n_features: int) -> Iterator[tuple[tuple, tuple]]:
    """((model, node), rows) of a task's blocks: codes, gradient and hessian of the rows in the asked nodes."""
    for model, spec, tree, arrays, nodes in asked:
        slot_of = np.full(len(arrays[0]), -1)
        slot_of[nodes] = np.arange(len(nodes))
        drawn = _drawn(spec, tree, nodes, n_features)
        for block in blocks:
            slot, codes, g, h = _asked_rows(block, model, spec, tree, arrays, slot_of, drawn)
            order = np.argsort(slot.astype(np.uint16 if len(nodes) < 1 << 16 else np.int64), kind="stable")
            ends = np.searchsorted(slot[order], np.arange(len(nodes) + 1))
            for node, first, last in zip(nodes, ends[:-1].tolist(), ends[1:].tolist()):
                if last > first:
                    rows = order[first:last]
                    yield (model, node), (codes[rows], g[rows], h[rows])


def _below(spec: Spec, depth: int, columns: np.ndarray, parts: Sequence[tuple]) -> tuple[tuple, dict[int, Split]]:
    """A node's sums and the splits from it down, each under its place (the node is 1, the children of k are 2k and 2k + 1).

    Of two children, the rows of the smaller are counted. With a limit on leaves, only nodes that the limit can reach are looked at.
    """
    codes, g, h = (np.concatenate(x) for x in zip(*parts))
    out: dict[int, Split] = {}
    places, at = [1], np.zeros(len(g), np.intp)
    total = (float(g.sum()), float(h.sum()), float(len(g)))
    hists = _totals(at, codes, g, h, 1).reshape(3, 1, len(columns), BINS) if depth < spec.depth else None
    while places and depth < spec.depth:
        gain, column, code, left = best_places(spec, hists)
        for k in np.flatnonzero(gain > 1e-9).tolist():
            out[places[k]] = Split(float(gain[k]), int(columns[column[k]]), int(code[k]), tuple(left[k].tolist()))
        reached = _reached(spec, out)
        held = np.array([place in reached for place in places])
        depth += 1
        if depth == spec.depth:
            break
        # rows of the nodes that are split go on to their children
        rows = held[at]
        codes, g, h, at = codes[rows], g[rows], h[rows], at[rows]
        right = codes[np.arange(len(at)), column[at]] > code[at]
        at = 2 * (np.cumsum(held) - 1)[at] + right
        places = [child for k in np.flatnonzero(held).tolist() for child in (2 * places[k], 2 * places[k] + 1)]
        counts = np.bincount(at, minlength=len(places)).reshape(-1, 2)
        pair = np.arange(len(counts))
        least = 2 * pair + (counts[:, 1] < counts[:, 0])
        slot = np.full(len(places), -1)
        slot[least] = pair
        few = np.flatnonzero(slot[at] >= 0)
        seen = _totals(slot[at[few]], codes[few], g[few], h[few], len(pair)).reshape(3, len(pair), len(columns), BINS)
        parents, hists = hists[:, held], np.empty((3, len(places), len(columns), BINS))
        hists[:, least], hists[:, least ^ 1] = seen, parents - seen
    return total, out


def _reached(spec: Spec, splits: dict[int, Split]) -> set[int]:
    """Places that are split next, largest gain first, until the leaves are used up; children that are not known yet would only push others out (see ``_best_first``)."""
    if spec.kind != "leaf":
        return set(splits)
    queue, out = [(-splits[1].gain, 1)] if 1 in splits else [], set()
    while queue and len(out) + 1 < spec.leaves:
        place = heapq.heappop(queue)[1]
        out.add(place)
        for child in (2 * place, 2 * place + 1):
            if child in splits:
                heapq.heappush(queue, (-splits[child].gain, child))
    return out


def _dealt(sizes: Mapping, tasks: int) -> dict:
    """A task for each key: the largest first, each to the task with the least so far."""
    loads, out = [(0.0, k) for k in range(tasks)], {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        load, task = heapq.heappop(loads)
        out[key] = task
        heapq.heappush(loads, (load + sizes[key], task))
    return out


def _splits_below(state, asked: list, depths: dict, sizes: dict, n_features: int) -> dict:
    """``_below`` of each asked (model, node), found where the node's rows meet."""
    specs = {model: (spec, tree) for model, spec, tree, _, _ in asked}

    def finish(item):
        (model, node), parts = item
        spec, tree = specs[model]
        return (model, node), _below(spec, depths[model, node], features_of_tree(spec, tree, n_features), list(parts))

    tasks = min(state.context.defaultParallelism, len(depths))
    task_of = _dealt(sizes, tasks)
    rows = state.mapPartitions(lambda blocks: _rows_of_nodes(list(blocks), asked, n_features))
    return dict(rows.groupByKey(tasks, lambda key: task_of[key]).map(finish).collect())


def _grow_round(state, names: list[str], specs: dict[str, Spec], r: int, n_features: int, rows_of: Mapping[str, int]) -> dict[str, Tree]:
    """One boosted tree of each model: steps until no model has a node left to count. A finished model waits for the others.

    Where rows are few (``LOCAL_TOTAL``), nodes of up to ``LOCAL_ROWS`` rows wait until no larger one is left to count; then all splits below them are found
    in one step. They are looked at in the same order as those of counted nodes.
    """
    local = LOCAL_ROWS if sum(rows_of[n] for n in specs) <= LOCAL_TOTAL else 0
    trees = {n: Tree() for n in specs}
    columns = {n: features_of_tree(spec, r, n_features) for n, spec in specs.items()}
    hists: dict[tuple[str, int], np.ndarray] = {}
    splits: dict[tuple[str, int], Split | None] = {}
    known: dict[tuple[str, int], tuple[dict, int]] = {}  # node -> (splits below some node, its place there)
    wanted, small = {n: [] for n in specs}, {n: [] for n in specs}  # nodes to count, and to find all splits below
    for n in specs:
        (small if rows_of[n] <= local else wanted)[n].append(trees[n].add(0, (0.0, 0.0, 0.0)))
    pairs: dict[tuple[str, int], tuple[int, int]] = {}  # counted child -> (sibling, parent)
    final: dict[str, list[int]] = {}

    def asked(of):
        return [(names.index(n), specs[n], r, trees[n].arrays(), nodes) for n, nodes in of.items() if nodes]

    while len(final) < len(specs):
        if any(wanted.values()):
            sums = _sums(state, asked(wanted), n_features)
        elif any(small.values()):
            sums, depths = {}, {(names.index(n), x): trees[n].depth[x] for n, nodes in small.items() for x in nodes}
            sizes = {(names.index(n), x): trees[n].sums[x][2] if x else rows_of[n] for n, nodes in small.items() for x in nodes}
            below = _splits_below(state, asked(small), depths, sizes, n_features)
            for n, nodes in small.items():
                for node in nodes:
                    total, found = below.get((names.index(n), node), ((0.0, 0.0, 0.0), {}))
                    if node == 0:
                        trees[n].sums[0] = total
                    known[n, node], splits[n, node] = (found, 1), found.get(1)
            small = {n: [] for n in specs}
        for n, nodes in wanted.items():
            found = []
            for k, node in enumerate(nodes):
                if k % SHARE == 0:
                    dense = _dense(sums.get((names.index(n), r, k // SHARE), ()), min(SHARE, len(nodes) - k), len(columns[n]))
                hists[n, node] = dense[:, k % SHARE]
                found.append(node)
                if (n, node) in pairs:
                    sibling, parent = pairs.pop((n, node))
                    hists[n, sibling] = hists[n, parent] - hists[n, node]
                    found.append(sibling)
            if found:
                if trees[n].depth[found[0]] == 0:
                    trees[n].sums[0] = tuple(hists[n, 0][:, 0].sum(axis=1).tolist())
                for node, split in zip(found, best_splits(specs[n], np.stack([hists[n, x] for x in found], 1), columns[n])):
                    splits[n, node] = split
        for n, spec in specs.items():
            wanted[n] = []
            if n in final:
                continue
            order, unknown = _best_first(n, spec, trees[n], splits)
            more = False
            while unknown:
                fresh = False  # children whose splits are known already
                for node in unknown:
                    children = trees[n].split(node, splits[n, node])
                    if trees[n].depth[children[0]] == spec.depth:
                        continue
                    if (n, node) in known:
                        fresh, (found, place) = True, known[n, node]
                        for child, at in zip(children, (2 * place, 2 * place + 1)):
                            known[n, child], splits[n, child] = (found, at), found.get(at)
                        continue
                    more = True
                    many = [child for child in children if trees[n].sums[child][2] > local]
                    small[n].extend(child for child in children if child not in many)
                    if len(many) == 2:
                        left, right = children
                        least, most = (left, right) if trees[n].sums[left][2] <= trees[n].sums[right][2] else (right, left)
                        pairs[n, least] = (most, node)
                        many = [least]
                    wanted[n].extend(many)
                order, unknown = _best_first(n, spec, trees[n], splits)  # the last level needs no counting
                if not fresh:
                    break
            if not more and not small[n]:
                final[n] = order
    return {n: _kept(trees[n], final[n]) for n in specs}


def _best_first(name: str, spec: Spec, tree: Tree, splits: dict) -> tuple[list[int], list[int]]:
    """The nodes that are split, largest gain first until the leaves are used up, and those of them whose children are not known yet.

    Unknown children are passed over, so all that may come next is counted in one step; the order is final once none is unknown. Of equal gains, the upper
    node's is first, then the left one's, whenever they were counted.
    """
    most = spec.leaves if spec.kind == "leaf" else math.inf
    queue, order, unknown = [], [], []

    def push(node: int, place: int) -> None:
        split = splits.get((name, node))
        if split is not None:
            heapq.heappush(queue, (-split.gain, place, node))

    push(0, 1)
    while queue and len(order) + 1 < most:
        _, place, node = heapq.heappop(queue)
        order.append(node)
        if tree.left[node] < 0:
            unknown.append(node)
        else:
            push(tree.left[node], 2 * place)
            push(tree.right[node], 2 * place + 1)
    return order, unknown


def _kept(tree: Tree, order: list[int]) -> Tree:
    """The tree with the given splits only (each after its parent's)."""
    out, at = Tree(), {0: 0}
    out.add(0, tree.sums[0])
    for node in order:
        left = tree.left[node]
        found = Split(tree.gain[node], tree.feature[node], tree.code[node], tree.sums[left])
        at[left], at[tree.right[node]] = out.split(at[node], found)
    return out


def _grow_forests(state, names: list[str], specs: dict[str, Spec], models: dict[str, list], n_features: int, n_rows: int) -> None:
    """All trees of all forests, level by level: splits are found where the sums meet, and only they reach the driver."""
    for n, spec in specs.items():
        models[n].extend(ForestTree() for _ in range(spec.trees))
    opened = {(names.index(n), t): np.zeros(1, int) for n, spec in specs.items() for t in range(spec.trees)}
    by_number, depth = {names.index(n): spec for n, spec in specs.items()}, 0
    while opened:
        asked = [(m, by_number[m], t, models[names[m]][t].arrays(), nodes) for (m, t), nodes in opened.items()]

        def finish(item, opened=opened):
            (m, t, share), parts = item
            nodes = opened[m, t][share * SHARE : (share + 1) * SHARE]
            drawn = _drawn(by_number[m], t, nodes, n_features)
            hist = _dense(list(parts), len(nodes), drawn.shape[1])
            gain, f, code, left = best_places(by_number[m], hist)
            return (m, t, share), (gain, drawn[np.arange(len(nodes)), f], code, left, hist[:, :, 0].sum(axis=2).T)

        rows = sum(models[names[m]][t].sums[nodes, 2].sum() for (m, t), nodes in opened.items()) if depth else n_rows * len(opened)
        tasks = max(min(state.context.defaultParallelism, len(asked)), math.ceil(rows * (math.sqrt(n_features) + 3) / MEET_BYTES))
        found = _found(state, asked, n_features, finish, tasks)
        after: dict[tuple[int, int], np.ndarray] = {}
        for (m, t), nodes in opened.items():
            tree, spec = models[names[m]][t], by_number[m]
            shares = [k for k in range(-(-len(nodes) // SHARE)) if (m, t, k) in found]
            if not shares:
                continue
            nodes = np.concatenate([nodes[k * SHARE : (k + 1) * SHARE] for k in shares])
            gain, feature, code, left, sums = (np.concatenate(x) for x in zip(*(found[m, t, k] for k in shares)))
            if not depth:
                tree.sums[0] = sums[0]
            if depth < spec.depth:
                held = gain > 1e-9
                children = tree.split(nodes[held], feature[held], code[held], gain[held], left[held])
                if depth + 1 < spec.depth:
                    after[m, t] = children[tree.sums[children, 2] >= max(spec.min_split, 2 * spec.min_leaf)]
        opened, depth = {k: v for k, v in after.items() if len(v)}, depth + 1


def _rows_of_trees(blocks: list[dict], asked: list) -> Iterator[tuple[int, tuple]]:
    """(place in ``asked``, rows) of a task's blocks: codes of all columns, gradient and hessian of the rows of each asked (model, spec, tree)."""
    for k, (model, spec, tree) in enumerate(asked):
        for block in blocks:
            weight = block["weights"][:, model]
            rows = np.flatnonzero(weight > 0)
            weight = weight[rows] * row_weights(spec, block["ids"][rows], tree)
            rows, weight = rows[weight > 0], weight[weight > 0]
            if len(rows):
                g, h = np.rint(weight * block["label"][rows] * _ONE), np.rint(weight * _ONE)
                if not np.mod(g, _ONE).any() and not np.mod(h, _ONE).any() and h.max() <= 255 * _ONE:  # copies of rows
                    g, h = (g / _ONE).astype(np.uint8), (h / _ONE).astype(np.uint8)
                yield k, (block["codes"][rows], g, h)


def _grown_tree(spec: Spec, t: int, n_features: int, parts: Sequence[tuple]) -> ForestTree:
    """A forest's tree from all its rows, by the levels and node numbers of ``_grow_forests``."""
    codes = np.concatenate([part[0] for part in parts])
    g, h = (np.concatenate([part[k] * _ONE if part[k].dtype == np.uint8 else part[k] for part in parts]) for k in (1, 2))
    tree, nodes, at, depth = ForestTree(), np.zeros(1, int), np.zeros(len(g), np.int32), 0
    while len(nodes):
        order = np.argsort(at, kind="stable")
        codes, g, h, at = codes[order], g[order], h[order], at[order]
        drawn = _drawn(spec, t, nodes, n_features)
        step, found = max(1, FOREST_CELLS // (drawn.shape[1] * BINS)), []
        ends = np.searchsorted(at, np.arange(0, len(nodes) + step, step))
        for k, (first, last) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            here, mine = at[first:last] - k * step, drawn[k * step : (k + 1) * step]
            seen = np.take_along_axis(codes[first:last], mine[here], axis=1)
            hist = _totals(here, seen, g[first:last], h[first:last], len(mine)).reshape(3, *mine.shape, BINS)
            gain, f, code, left = best_places(spec, hist)
            found.append((gain, mine[np.arange(len(mine)), f], code, left, hist[:, :, 0].sum(axis=2).T))
        gain, feature, code, left, sums = (np.concatenate(x) for x in zip(*found))
        if not depth:
            tree.sums[0] = sums[0]
        if depth >= spec.depth:
            break
        held = gain > 1e-9
        children = tree.split(nodes[held], feature[held], code[held], gain[held], left[held])
        opened = (tree.sums[children, 2] >= max(spec.min_split, 2 * spec.min_leaf)) & (depth + 1 < spec.depth)
        # rows go on to the children that may be split
        place, child = np.where(opened, np.cumsum(opened) - 1, -1), np.cumsum(held) - 1
        right = codes[np.arange(len(at)), feature[at]] > code[at]
        to = np.where(held[at], place[2 * child[at] + right] if len(place) else -1, -1)
        rows = to >= 0
        codes, g, h, at = codes[rows], g[rows], h[rows], to[rows].astype(np.int32)
        nodes, depth = children[opened], depth + 1
    return tree


def _grow_where_rows_meet(state, names: list[str], specs: dict[str, Spec], models: dict[str, list], n_features: int, rows_of: Mapping[str, int]) -> None:
    """All trees of forests over few rows, each in the task where its rows meet; some trees at a time, so that what is sent together stays bounded."""
    cores, held, size = state.context.defaultParallelism, [], 0
    todo = [(n, names.index(n), spec, t) for n, spec in specs.items() for t in range(spec.trees)]
    for place, (n, m, spec, t) in enumerate(todo):
        held.append((n, m, spec, t))
        size += rows_of[n] * (n_features + 2)
        if place + 1 < len(todo) and (len(held) % cores or size + cores * rows_of[n] * (n_features + 2) <= FOREST_BYTES):
            continue
        asked = [x[1:] for x in held]

        def finish(item, asked=asked):
            _, spec, t = asked[item[0]]
            return item[0], _grown_tree(spec, t, n_features, list(item[1]))

        rows = state.mapPartitions(lambda blocks, asked=asked: _rows_of_trees(list(blocks), asked))
        grown = dict(rows.groupByKey(len(asked), lambda k: k).map(finish).collect())
        for k, (name, *_) in enumerate(held):
            models[name].append(grown.get(k) or ForestTree())
        held, size = [], 0
