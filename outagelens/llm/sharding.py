"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is cut into a fixed number of cells. A document's key hashes to a cell; virtual nodes stand at cells;
the cells up to the next node clockwise form that node's arc. Shard capacities are exact (they add up to the number
of rows, and differ by one at most), so balance is guaranteed. An arc fills its home shard first; its rows beyond the capacity
continue clockwise to the next node whose shard has room. Within an arc, rows are ranked in ring order.

The driver only sees one count per arc (shards x virtual nodes, a constant), from which it lays out the overflow as rank intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_table, offsets_in_order, staged, text_of

CELLS = 1 << 16
VIRTUAL_NODES = 64


def _nodes(docs: DataFrame, shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; a cell taken twice belongs to the lower shard."""
    spark = docs.sparkSession
    at = F.pmod(F.xxhash64(F.lit("node"), F.col("shard"), F.col("node")), F.lit(cells))
    rows = (spark.range(shards * virtual_nodes).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("node"))
            .select(at.alias("cell"), "shard").groupBy("cell").agg(F.min("shard").alias("shard")).orderBy("cell").collect())
    return [(r["cell"], r["shard"]) for r in rows]


def place(arcs: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals (arc, lo, hi, shard, first slot) from the arcs in ring order as (shard, rows).

    In rounds: every arc offers what it has left to its next node clockwise; arcs are served in ring order.
    """
    room, used = list(capacity), [0] * len(capacity)
    left = [n for _, n in arcs]
    out = []
    for step in range(len(arcs)):
        if not any(left):
            break
        for a in range(len(arcs)):
            shard = arcs[(a + step) % len(arcs)][0]
            take = min(left[a], room[shard])
            if take:
                lo = arcs[a][1] - left[a]
                out.append((a, lo, lo + take, shard, used[shard]))
                left[a] -= take
                room[shard] -= take
                used[shard] += take
    return out


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
               virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    Row counts of the shards differ by one at most; slots are gapless from 0 in each shard. The key is the id (null ids
    are spread by their text); null texts count as empty. Rows equal in id and text are interchangeable, each has
    its own slot. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    # the text's checksum only breaks up rows that repeat an id
    key = F.xxhash64(F.lit("key"), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text_crc32")))
    rows = staged(rows.withColumn("cell", F.pmod(key, F.lit(cells))).withColumn("one", F.lit(1).cast("long"))
                  .withColumn("tie", F.xxhash64(F.lit("tie"), "doc_id", "text_crc32", "size")), "shard_rows")

    nodes = _nodes(docs, shards, virtual_nodes, cells)
    n_nodes = len(nodes)
    # cell -> arc: the first node at or after the cell; cells past the last node belong to the first one
    marks = literal_table(spark, "cell bigint, arc bigint", [{"cell": c, "arc": i} for i, (c, _) in enumerate(nodes)])
    ring = spark.range(cells).select(F.col("id").alias("cell")).join(marks, "cell", "left")
    ahead = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a constant number of rows
    ring = ring.select("cell", F.coalesce(F.last("arc", ignorenulls=True).over(ahead), F.lit(0)).alias("arc"))
    # the wrapped cells come before the others of the first arc
    ring = ring.withColumn("cell_rank", F.when((F.col("arc") == 0) & (F.col("cell") > nodes[-1][0]), F.col("cell") - cells).otherwise(F.col("cell")))
    rows = rows.join(F.broadcast(ring), "cell")

    counted = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    arcs = [(s, counted.get(i, 0)) for i, (_, s) in enumerate(nodes)]
    total = sum(n for _, n in arcs)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = place(arcs, capacity)
    laid = literal_table(spark, "arc bigint, pieces array<struct<lo bigint, hi bigint, shard int, slot bigint>>", [
        {"arc": i, "pieces": [{"lo": lo, "hi": hi, "shard": s, "slot": at} for a, lo, hi, s, at in pieces if a == i]} for i in range(n_nodes)])
    ranked = offsets_in_order(rows, ["arc"], "cell_rank", ["tie", "doc_id", "text_crc32", "size"], "one", "rank")
    mine = F.filter("pieces", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))
    return (ranked.join(F.broadcast(laid), "arc").withColumn("__piece", F.get(mine, F.lit(0)))
            .select("doc_id", "size", "text_crc32", F.col("__piece.shard").alias("shard"),
                    (F.col("__piece.slot") + F.col("rank") - F.col("__piece.lo")).cast("long").alias("slot")))
