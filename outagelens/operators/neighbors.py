"""Exact k-nearest neighbours without an all-pairs join (pivot cells, groups of bounded size).

1. ``P`` pivots are drawn by hash from the data (about ``cell_size`` points per pivot, at most
   ``max_pivots``, since pivots travel through the driver) and numbered so that neighbours in number are neighbours in space.
2. Every query point joins the cell of its nearest pivot. Its k-th nearest row of a hash sample bounds the distance of
   its k-th neighbour, and ``reach_i`` is the largest distance to the pivot plus bound in cell ``i`` (a grouped max).
3. By the triangle inequality a data point ``s`` can only matter to cell ``i`` if ``|s, p_i| <= reach_i``.
   Cells next to each other form a query group of at most ``GROUP_BYTES``; a data point is copied to the groups it can matter to, once each
   (a list of numbers, expanded by Spark). In many dimensions this prunes little, and a group may be sent most of the data.
4. So a group never meets its data at once: a large cell's queries and a group's data are dealt by hash, data into slices of
   about ``SLICE_BYTES``; each pair of query group and slice is one Arrow group. Each returns the nearest of its slice for every query, and a
   ranked window merges them. Memory is bounded whatever the cell, and the data is shuffled once per query group, not per cell.
5. In a group, queries and data are halved at medians into leaves with bounding boxes. A leaf of queries goes through the data's leaves by
   box distance until the next is beyond its bounds. Distances come from one matrix product; the finalists, with a margin for rounding,
   are measured again exactly.

The result equals brute force (checked against DuckDB). The work is queries times the data that the bounds let through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import row_hash

#: Bytes of the vectors of a query group and of a data slice, about.
GROUP_BYTES, SLICE_BYTES = 16 << 20, 32 << 20
#: Groups and slices are cut smaller than that for this many tasks, but not below so many rows.
GROUPS, SLICES, LEAST_ROWS = 16, 4, 1024
#: Rows of a leaf of queries and of data.
QUERY_LEAF, DATA_LEAF = 256, 1024


def knn(query: DataFrame, data: DataFrame, k: int, id_col: str = "id", feat: str = "features",
        exclude_self: bool = True, cell_size: int = 2000, max_pivots: int = 1024, sample_size: int = 4096,
        seed: int = 42, dedupe_heavy: bool = True) -> DataFrame:
    """(id, nn_id, dist, rank): the ``k`` nearest ``data`` rows of each ``query`` row.

    Euclidean distance; ties broken by the neighbour id. With ``exclude_self``
    a row is never its own neighbour (same id).

    Heavy duplicates (``dedupe_heavy``, for queries drawn from ``data`` with
    ``exclude_self``): a vector present at least ``k + 1`` times answers its
    own rows directly (the other copies with the smallest ids, distance 0),
    and only its ``k + 1`` smallest ids take part in the cell search; no other
    query can use more of them. A third of all rows on one point therefore
    never lands in one cell.
    """
    if dedupe_heavy and exclude_self:
        return _knn_with_heavy(query, data, k, id_col, feat, cell_size, max_pivots, sample_size, seed)
    return _knn_cells(query, data, k, id_col, feat, exclude_self, cell_size, max_pivots, sample_size, seed)


def _smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """Per vector ``f``, its ``n`` smallest ids as (f, id, pos); Spark cuts each task's rows to ``n`` per vector before the shuffle."""
    w = Window.partitionBy("f").orderBy("id")
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n).select("f", "id", "pos")


def _knn_with_heavy(query, data, k, id_col, feat, cell_size, max_pivots, sample_size, seed):
    d = data.select(F.col(id_col).cast("long").alias("id"), F.col(feat).alias("f")).persist(
        StorageLevel.MEMORY_AND_DISK)
    mult = d.groupBy("f").agg(F.count(F.lit(1)).alias("_m"))
    heavy_vecs = mult.filter(F.col("_m") >= k + 1).select("f")
    if heavy_vecs.isEmpty():
        d.unpersist()
        return _knn_cells(query, data, k, id_col, feat, True, cell_size, max_pivots, sample_size, seed)
    heavy_rows = d.join(heavy_vecs, "f", "left_semi")
    keep = _smallest_ids(heavy_rows, k + 1).persist(StorageLevel.MEMORY_AND_DISK)
    light = d.join(heavy_vecs, "f", "left_anti")
    reduced = light.unionByName(keep.select("id", "f"))
    q = query.select(F.col(id_col).cast("long").alias("id"), F.col(feat).alias("f"))
    q_heavy = q.join(heavy_vecs, "f", "left_semi")
    q_light = q.join(heavy_vecs, "f", "left_anti")
    # heavy queries: the k smallest other ids of their own vector, distance 0
    cand = q_heavy.join(keep.withColumnRenamed("id", "nn_id"), "f").filter(F.col("id") != F.col("nn_id"))
    # at most k + 1 candidates per query id, so this window is bounded
    ranked = cand.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    heavy_ans = ranked.filter(F.col("rank") <= k).select(
        "id", "nn_id", F.lit(0.0).alias("dist"), F.col("rank").cast("int").alias("rank"))
    light_ans = _knn_cells(q_light.withColumnRenamed("f", feat).withColumnRenamed("id", id_col),
                           reduced.withColumnRenamed("f", feat).withColumnRenamed("id", id_col),
                           k, id_col, feat, True, cell_size, max_pivots, sample_size, seed)
    return light_ans.unionByName(heavy_ans)


def _knn_cells(query: DataFrame, data: DataFrame, k: int, id_col: str = "id", feat: str = "features",
               exclude_self: bool = True, cell_size: int = 2000, max_pivots: int = 1024, sample_size: int = 4096,
               seed: int = 42) -> DataFrame:
    """Pivot-cell search (see the module docstring)."""
    spark = query.sparkSession
    query_leaf, data_leaf, null_id = QUERY_LEAF, DATA_LEAF, -(1 << 63)

    # Helpers are local so the Arrow steps pickle by value: workers need numpy and pyarrow only, not this package.
    def vectors(column):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def ids_of(column):
        return column.fill_null(null_id).to_numpy(zero_copy_only=False)

    def squares(x, points):
        """Squared distances (rows x points) and what rounding may make of them."""
        x, y = x - middle, points - middle
        x2, y2 = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        return x2[:, None] + y2 - 2.0 * (x @ y.T), 1e-9 * (x2 + y2.max()) + 1e-12

    def halved(x, size):
        """Row numbers of leaves of at most ``size`` rows, cut at the median of the widest column; leaves in order of place."""
        leaves, todo = [], [np.arange(len(x))]
        while todo:
            at = todo.pop()
            if len(at) <= size:
                leaves.append(at)
                continue
            y = x[at]
            order = np.argpartition(y[:, np.ptp(y, axis=0).argmax()], len(at) // 2)
            todo += [at[order[len(at) // 2:]], at[order[:len(at) // 2]]]
        return leaves

    q = query.select(F.col(id_col).cast("long").alias("id"), F.col(feat).alias("f"))
    d = data.select(F.col(id_col).cast("long").alias("id"), F.col(feat).alias("f"))
    n = d.count()
    if n == 0:
        return spark.createDataFrame([], "id long, nn_id long, dist double, rank int")
    n_piv = max(1, min(max_pivots, math.ceil(n / cell_size)))
    picked = d.orderBy(row_hash(["id"], seed, "pivot"), "id").limit(max(n_piv, sample_size)).collect()  # bounded
    smp = np.vstack([np.asarray(r.f, dtype=np.float64) for r in picked])
    smp_ids = np.array([null_id if r.id is None else r.id for r in picked])
    middle = smp.mean(axis=0)
    pivots = np.unique(smp[:n_piv], axis=0)
    pivots = pivots[np.concatenate(halved(pivots, 1))]

    # pivots (<= max_pivots x dims), the sample and per-cell reach travel inside the task closures
    def assign(batches):
        for batch in batches:
            ids, x = ids_of(batch.column(0)), vectors(batch.column(1))
            cell, reach, bound = np.zeros(len(ids), np.int32), np.zeros(len(ids)), np.zeros(len(ids))
            for s in range(0, len(ids), 512):
                at = slice(s, s + 512)
                near, margin = squares(x[at], smp)
                if exclude_self:
                    near[(ids[at, None] == smp_ids) & (smp_ids != null_id)] = np.inf
                if k <= near.shape[1]:
                    bound[at] = np.maximum(np.partition(near, k - 1, axis=1)[:, k - 1] + margin, 0)
                else:
                    bound[at] = np.inf
                near, margin = squares(x[at], pivots)
                cell[at] = near.argmin(axis=1)
                reach[at] = np.sqrt(np.maximum(near.min(axis=1) + margin, 0)) + np.sqrt(bound[at])
            made = [pa.array(cell), pa.array(reach), pa.array(bound)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["id", "f", "cell", "reach", "bound"])

    qa = q.mapInArrow(assign, "id long, f array<double>, cell int, reach double, bound double").persist(StorageLevel.MEMORY_AND_DISK)
    of_cell = {r.cell: r for r in qa.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()}  # at most P rows
    if not of_cell:
        return spark.createDataFrame([], "id long, nn_id long, dist double, rank int")

    # cells next to each other share a group
    row_bytes = 8 * max(1, pivots.shape[1])
    group_rows = max(1, min(GROUP_BYTES // row_bytes, max(LEAST_ROWS, -(-sum(r.n for r in of_cell.values()) // GROUPS))))
    slice_rows = max(1, min(SLICE_BYTES // row_bytes, max(LEAST_ROWS, -(-n // SLICES))))
    held = sorted(of_cell)
    reach = np.array([of_cell[c].reach for c in held])
    starts, sizes = [], []
    for i, c in enumerate(held):
        if not sizes or sizes[-1] + of_cell[c].n > group_rows:
            starts.append(i)
            sizes.append(0)
        sizes[-1] += of_cell[c].n

    def reached(x):
        """Whether a row can matter to a group (rows x groups)."""
        near, margin = squares(x, pivots[held])
        return np.logical_or.reduceat(np.sqrt(np.maximum(near - margin[:, None], 0)) <= reach, starts, axis=1)

    def send(batches):
        for batch in batches:
            x, rows, groups = vectors(batch.column(1)), [np.zeros(0, int)], [np.zeros(0, int)]
            for s in range(0, len(x), 512):
                r, g = np.nonzero(reached(x[s:s + 512]))
                rows.append(r + s)
                groups.append(g)
            ends = np.cumsum(np.bincount(np.concatenate(rows), minlength=len(x)))
            to = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(groups), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, to], ["id", "f", "to"])

    # slices from the share of the sample that reaches a group, so that the data is not gone through twice
    hits = sum(reached(smp[s:s + 512]).sum(axis=0) for s in range(0, len(smp), 512))
    rows_sent = (hits + (2 * np.sqrt(hits) + 1 if len(smp) < n else 0)) * (n / len(smp))
    slices = [max(1, math.ceil(r / slice_rows)) for r in rows_sent]
    parts = [-(-size // group_rows) for size in sizes]
    group_of = np.searchsorted(starts, np.arange(len(held)), side="right") - 1
    cells = F.broadcast(spark.createDataFrame([(int(c), int(g)) for c, g in zip(held, group_of)], "cell int, grp int"))  # at most max_pivots rows
    groups = F.broadcast(spark.createDataFrame([(g, p, s) for g, (p, s) in enumerate(zip(parts, slices))], "grp int, np long, ns long"))

    def every(count):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    qs = qa.join(cells, "cell").join(groups, "grp").withColumn("part", F.pmod(F.xxhash64("id", F.lit("q")), F.col("np"))).withColumn("slice", every("ns"))
    ds = d.mapInArrow(send, "id long, f array<double>, to array<int>").select("id", "f", F.explode("to").alias("grp"))
    ds = ds.join(groups, "grp").withColumn("slice", F.pmod(F.xxhash64("id", F.lit("d")), F.col("ns"))).withColumn("part", every("np"))
    both = (qs.select("grp", "part", "slice", "id", "f", "bound")
            .unionByName(ds.select("grp", "part", "slice", "id", "f", F.lit(None).cast("double").alias("bound"))))

    def exact(qx, dx, did, r, c):
        """Distances of the finalists, and of each query its k nearest (ties by id)."""
        dist = np.concatenate([np.zeros(0)] + [np.sqrt(np.einsum("ij,ij->i", y, y)) for s in range(0, len(r), 8192) for y in [qx[r[s:s + 8192]] - dx[c[s:s + 8192]]]])
        order = np.lexsort((did[c], dist, r))
        r, c, dist = r[order], c[order], dist[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[keep], c[keep], dist[keep]

    def local(table):
        asks = pc.is_valid(table["bound"])
        qt, dt = table.filter(asks).combine_chunks(), table.filter(pc.invert(asks)).combine_chunks()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(qt) and len(dt):
            one = lambda t, name: t[name].chunk(0)
            qx, dx, qid, did, bounds = vectors(one(qt, "f")), vectors(one(dt, "f")), ids_of(one(qt, "id")), ids_of(one(dt, "id")), one(qt, "bound").to_numpy()
            dx, did = (a[np.argsort(did, kind="stable")] for a in (dx, did))
            leaves = halved(dx, data_leaf)
            low, high = np.stack([dx[at].min(axis=0) for at in leaves]), np.stack([dx[at].max(axis=0) for at in leaves])
            y = dx - middle
            y2 = np.einsum("ij,ij->i", y, y)
            right = np.concatenate([-2.0 * y, y2[:, None]], axis=1)  # [x, 1] . [-2 y, |y|^2] = distance^2 - |x|^2
            rights = [np.ascontiguousarray(right[at].T) for at in leaves]
            leaf_of, place = np.empty(len(dx), int), np.empty(len(dx), int)
            for i, at in enumerate(leaves):
                leaf_of[at], place[at] = i, np.arange(len(at))
            first, last = np.searchsorted(did, qid, side="left"), np.searchsorted(did, qid, side="right")
            last = np.where(qid == null_id, first, last) if exclude_self else first
            for rows in halved(qx, query_leaf):
                x = qx[rows] - middle
                x2 = np.einsum("ij,ij->i", x, x)
                left = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                margin = 1e-9 * (x2 + y2.max()) + 1e-12
                gap = np.maximum(np.maximum(low - qx[rows].max(axis=0), qx[rows].min(axis=0) - high), 0)
                apart = np.einsum("ij,ij->i", gap, gap)
                # a query's own rows in the data
                own = np.repeat(np.arange(len(rows)), (last - first)[rows])
                mine = np.concatenate([np.zeros(0, int)] + [np.arange(first[i], last[i]) for i in rows if last[i] > first[i]])
                best, most = np.full((len(rows), k), np.inf), bounds[rows] - x2
                found_r, found_c, count = [np.zeros(0, int)], [np.zeros(0, int)], 0
                for leaf in np.argsort(apart, kind="stable"):
                    if apart[leaf] > (most + x2 + margin).max():
                        break
                    near = left @ rights[leaf]
                    here = leaf_of[mine] == leaf
                    near[own[here], place[mine[here]]] = np.inf
                    least = near.min(axis=1)
                    closer = np.flatnonzero(least < most)
                    if len(closer):
                        new = np.concatenate([best[closer], near[closer]], axis=1)
                        best[closer] = np.partition(new, k - 1, axis=1)[:, :k]
                        most[closer] = np.minimum(most[closer], best[closer].max(axis=1))
                    some = np.flatnonzero(least <= most + margin)
                    r, c = np.nonzero((near[some] <= (most + margin)[some, None]) & np.isfinite(near[some]))
                    found_r.append(some[r])
                    found_c.append(leaves[leaf][c])
                    count += len(r)
                    if count > 1_000_000:
                        r, c, _ = exact(qx[rows], dx, did, np.concatenate(found_r), np.concatenate(found_c))
                        found_r, found_c, count = [r], [c], 0
                r, c, dist = exact(qx[rows], dx, did, np.concatenate(found_r), np.concatenate(found_c))
                out.append((qid[rows][r], did[c], dist))
        ids, nns, dists = (np.concatenate(c) for c in zip(*out))
        return pa.table({"id": pa.array(ids, mask=ids == null_id), "nn_id": pa.array(nns, mask=nns == null_id), "dist": pa.array(dists)})

    found = both.groupBy("grp", "part", "slice").applyInArrow(local, "id long, nn_id long, dist double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nn_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k)
