"""Merkle manifest of a dataset: a persistent tree over the rows, with a proof for each row and a version for each tampered one.

The rows of a tree (one per source) are leaves in order of their id; every ``FANOUT`` neighbours become their parent's digest,
up to one subroot, and the subroots of all trees likewise become the root. A tree of any size is dealt into aligned blocks of
``FANOUT ** LEVELS`` leaves. A block is small, so one task builds its nodes; the roots of the blocks are the
leaves of the next tier, dealt into blocks again, until one node remains. Nodes are never changed: replacing a leaf copies
its ancestors inside the block and shares every other node, which gives a new version of the block's root; the version goes on
through the tiers above, each copy taking the untouched siblings that were found there.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Children of a node.
FANOUT = 3
#: Levels of a block: it holds 729 leaves at most.
LEVELS = 6
BLOCK = FANOUT ** LEVELS
#: Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A row's siblings at each level: digests (hex) before and after it in its run.
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_PATH_SQL = "array<struct<before: string, after: string>>"


def digest_of(values: list[Column]) -> Column:
    """sha256 (32 bytes) of the values: `-` if null, else UTF-8 byte count, `:`, value."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, values)), 256))


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FANOUT), levels + 1
    return levels


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


class Block:
    """A persistent tree: nodes are only added. A version is its root's place in the list of nodes."""

    def __init__(self, leaves: list[str], levels: int):
        self.digest: list[str] = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        self.levels = levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._add(tuple(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)]
        self.root = row[0]

    def _add(self, children: tuple[int, ...]) -> int:
        self.digest.append(parent([self.digest[c] for c in children]))
        self.children.append(children)
        return len(self.digest) - 1

    def ancestors(self, root: int, place: int) -> list[tuple[int, int]]:
        """From the leaf up: (node, which of its children leads to the leaf)."""
        steps, node = [], root
        for level in range(self.levels - 1, -1, -1):
            turn = place // FANOUT ** level % FANOUT
            steps.append((node, turn))
            node = self.children[node][turn]
        return steps[::-1]

    def siblings(self, root: int, place: int) -> list[tuple[str, str]]:
        out = []
        for node, turn in self.ancestors(root, place):
            run = [self.digest[c] for c in self.children[node]]
            out.append(("".join(run[:turn]), "".join(run[turn + 1 :])))
        return out

    def replaced(self, root: int, place: int, leaf: str) -> int:
        """The version in which the leaf at ``place`` is another one: its ancestors are copied, all other nodes shared."""
        steps = self.ancestors(root, place)
        self.digest.append(leaf)
        self.children.append(())
        new = len(self.digest) - 1
        for node, turn in steps:
            old = self.children[node]
            new = self._add((*old[:turn], new, *old[turn + 1 :]))
        return new


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings, level by level, lead to."""
    for before, after in path:
        leaf = parent([before, leaf, after])
    return leaf


def _indexed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds index (from 0, in ``order``) and size (rows of the group).

    Rows are dealt by ranges of (group, order), so a group of any size spreads over the tasks; only the counts of (group, task) are
    summed up, and only the rows of one task are sorted together.
    """
    dealt = staged(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), name)
    parts = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    mine = Window.partitionBy(group)
    parts = parts.select(group, "part", F.sum("n").over(mine).alias("size"),
                         F.coalesce(F.sum("n").over(mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    d, p = dealt.withColumn("within", within).alias("d"), parts.alias("p")
    joined = d.join(p, F.col(f"d.{group}").eqNullSafe(F.col(f"p.{group}")) & (F.col("d.part") == F.col("p.part")))
    return joined.select(*(f"d.{c}" for c in rows.columns), "p.size", (F.col("p.earlier") + F.col("d.within") - 1).alias("index"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per node (tree, index, size, digest): also path (its siblings inside its block) and top (the block's root)."""
    def build(key, table):
        table = table.sort_by("index")
        block = Block(table.column("digest").to_pylist(), min(LEVELS, height(table.column("size")[0].as_py())))
        path = [[{"before": b, "after": a} for b, a in block.siblings(block.root, i)] for i in range(table.num_rows)]
        return pa.table({"tree": table.column("tree"), "index": table.column("index"), "size": table.column("size"),
                         "path": pa.array(path, _PATH), "top": pa.array([block.digest[block.root]] * table.num_rows, pa.string())})

    keyed = nodes.select("tree", "index", "size", "digest", F.expr(f"index div {BLOCK}").alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(build, f"tree long, index long, size long, path {_PATH_SQL}, top string")


def _climb(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """All tiers above the nodes (tree, index, size, digest): (tree, index, path up to the tree's root), (tree, digest of the root).

    A tier has one row for 729 of the tier below; the driver only sees the size of the largest tree.
    """
    paths = nodes.select("tree", "index", F.lit(None).cast(_PATH_SQL).alias("path"), F.col("index").alias("at"))
    most, tier = nodes.agg(F.max("size")).first()[0] or 0, 0
    while most > 1:
        built = staged(_blocks(nodes), f"{name}_{tier}")
        p, b = paths.alias("p"), built.alias("b")
        path = F.concat(F.coalesce("p.path", F.array().cast(_PATH_SQL)), "b.path")
        paths = p.join(b, (F.col("p.tree") == F.col("b.tree")) & (F.col("p.at") == F.col("b.index"))).select(
            "p.tree", "p.index", path.alias("path"), F.expr(f"p.at div {BLOCK}").alias("at"))
        nodes = built.filter(F.col("index") % BLOCK == 0).select(
            "tree", F.expr(f"index div {BLOCK}").alias("index"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), F.col("top").alias("digest"))
        most, tier = -(-most // BLOCK), tier + 1
    return paths.select("tree", "index", F.coalesce("path", F.array().cast(_PATH_SQL)).alias("path")), nodes.select("tree", "digest")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", tree: str = "source",
             tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per input row: the order and tree columns, index and size (place in its tree), leaf, proof (digests of its siblings, level by
    level, left to right), subroot, root, folded_root, verified. Digests are lowercase hex.

    ``tampered`` gives fields another value in the rows ``where`` holds: such a row makes a version of the tree, and folded_root is the
    root of that version; verified says whether it is the untouched root. Other rows fold back to the root. A null field is hashed as `-`; null
    trees come first and null ids first in their tree; rows that repeat an id are ordered by their digest, and rows equal in every field are
    interchangeable leaves. A lone leaf is its tree's subroot and has no sibling there. Extra columns are ignored; an empty table gives an
    empty result.
    """
    changed = F.lit(None).cast("binary")
    if tampered:
        changed = F.when(F.lit(True) if where is None else where, digest_of([tampered.get(f, F.col(f)) for f in fields]))
    rows = docs.select(F.col(order).alias("id"), F.col(tree).alias("name"), digest_of([F.col(f) for f in fields]).alias("leaf"), changed.alias("changed"))
    placed = _indexed(rows, "name", ["id", "leaf"], "merkle_leaves")

    # trees in order of their name
    names = _indexed(placed.filter("index = 0").select("name", F.lit(0).cast("long").alias("all")), "all", ["name"], "merkle_trees")
    l, r = placed.alias("l"), names.alias("r")
    leaves = staged(l.join(r, F.col("l.name").eqNullSafe(F.col("r.name"))).select(
        "l.id", "l.name", F.lower(F.hex("l.leaf")).alias("digest"), F.lower(F.hex("l.changed")).alias("changed"), "l.index", "l.size",
        F.col("r.index").alias("tree"), F.col("r.size").alias("trees"), F.expr(f"l.index div {BLOCK}").alias("block")), "merkle_placed")

    def tops(key, table):
        table = table.sort_by("index")
        size = table.column("size")[0].as_py()
        block = Block(table.column("digest").to_pylist(), min(LEVELS, height(size)))
        return pa.table({"tree": [key[0].as_py()], "index": [key[1].as_py()], "size": [-(-size // BLOCK)], "digest": [block.digest[block.root]],
                         "trees": [table.column("trees")[0].as_py()]}, schema=top_schema)

    top_schema = pa.schema([("tree", pa.int64()), ("index", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("trees", pa.int64())])
    lowest = staged(leaves.select("tree", "block", "index", "size", "digest", "trees").groupBy("tree", "block").applyInArrow(
        tops, "tree long, index long, size long, digest string, trees long"), "merkle_blocks")

    inner, subroots = _climb(lowest, "merkle_tier")
    trees = lowest.filter("index = 0").select("tree", "trees")
    subroots = staged(subroots.join(trees, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.col("trees").alias("size"), "digest"), "merkle_subroots")
    outer, roots = _climb(subroots, "merkle_top")
    upper = (inner.alias("i").join(outer.alias("o"), F.col("i.tree") == F.col("o.index"))
             .join(subroots.alias("s"), F.col("i.tree") == F.col("s.index")).join(roots.alias("r"), F.col("o.tree") == F.col("r.tree"))
             .select("i.tree", F.col("i.index").alias("block"), F.concat("i.path", "o.path").alias("path"),
                     F.col("s.digest").alias("subroot"), F.col("r.digest").alias("root")))
    upper = staged(upper, "merkle_upper")

    def versions(left, right):
        left = left.sort_by("index")
        n, leaf = left.num_rows, left.column("digest").to_pylist()
        block = Block(leaf, min(LEVELS, height(left.column("size")[0].as_py())))
        path = [(x["before"], x["after"]) for x in right.column("path")[0].as_py()]
        subroot, root = right.column("subroot")[0].as_py(), right.column("root")[0].as_py()
        above = [x for b, a in path for s in (b, a) for x in _cut(s)]
        untouched = fold(block.digest[block.root], path)
        proofs, folded = [], []
        for i, changed in enumerate(left.column("changed").to_pylist()):
            proofs.append([x for b, a in block.siblings(block.root, i) for s in (b, a) for x in _cut(s)] + above)
            # the version's own copies of the ancestors in this block, then those of the tiers above
            folded.append(untouched if changed is None else fold(block.digest[block.replaced(block.root, i, changed)], path))
        return pa.table([left.column("id"), left.column("name"), left.column("index"), left.column("size"), left.column("digest"),
                         pa.array(proofs, pa.list_(pa.string())), pa.array([subroot] * n), pa.array([root] * n), pa.array(folded, pa.string()),
                         pa.array([x == root for x in folded], pa.bool_())],
                        names=["id", "name", "index", "size", "leaf", "proof", "subroot", "root", "folded_root", "verified"])

    kinds = ", ".join(f"{c} {leaves.schema[c].dataType.simpleString()}" for c in ("id", "name"))
    both = leaves.drop("trees").groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
    out = both.applyInArrow(versions, f"{kinds}, index long, size long, leaf string, proof array<string>, subroot string, root string, "
                                      "folded_root string, verified boolean")
    return out.withColumnsRenamed({"id": order, "name": tree})


def _cut(digests: str) -> list[str]:
    return [digests[i : i + 64] for i in range(0, len(digests), 64)]
