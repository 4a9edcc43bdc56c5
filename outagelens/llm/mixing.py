"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Each source's documents are put in a fixed shuffled order and cut into blocks of equally many tokens. Slot k of
the schedule is the point frac(k / golden ratio) looked up in the cumulative target shares; slots are ranked per source, and the
r-th slot of a source takes block r of its stream (starting over after the last). Slots stop where a source has its target; sources whose
short last blocks need more slots than their share get them behind the schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets_in_order, staged, text_of, word_count

#: Tokens of a block.
BLOCK = 32
#: Cells into which a source's documents and slots are dealt for ordering.
CELLS = 4096
#: Steps of the unit line by which points find their share.
STEPS = 1024
GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also weight and target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes. A
    target stops at ``most`` times its source's size; the excess is shared again by weight until none is above. In closed form:
    sources sorted by size over weight are full up to a water level, the rest get level x weight.
    """
    # one row per source; these windows run over the list of sources, not over documents
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    below, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (s.withColumn("full_before", F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
         .withColumn("weight_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
         .withColumn("all_sizes", F.sum("source_size").over(everything).cast("double")))
    # the level if this source and all that fill later were open; it is full where even that level is above its cap
    s = s.withColumn("level", (F.col("all_sizes") * share - F.col("full_before")) / F.col("weight_from"))
    s = s.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level"))))
    s = s.withColumn("__open", open_level.over(everything))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("__open.level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _same(a: str, b: str, *names: str):
    return [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]


def schedule(plan: DataFrame, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """Slots (slot, source, rank) whose ranks run from 0 in each source, from a plan (source, source_size, target).

    Grows with the total target over the block size. Sources are found through cumulative shares that are one row per source.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    # a margin for sources whose share of the points comes a little later
    n_slots = int(total / block * 1.002) + 64 if total else 0
    upto = F.sum("target").over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) / F.lit(total or 1.0)
    shares = plan.filter("target > 0").select("source", upto.alias("hi"), (upto - F.col("target") / F.lit(total or 1.0)).alias("lo"))
    # the last share is open above, the first below, so that rounding loses no point
    shares = shares.withColumn("hi", F.when(F.col("hi") > 1 - 1e-9, F.lit(2.0)).otherwise(F.col("hi")))
    ends = F.lag("hi", 1, -1.0).over(Window.orderBy("hi", "lo"))
    shares = shares.withColumn("lo", ends)
    # a share is listed under each step of the unit line that it touches; the points fall evenly on the steps
    shares = shares.withColumn("step", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor(F.col("lo") * STEPS)), F.least(F.lit(STEPS - 1), F.floor(F.col("hi") * STEPS)))))
    point = F.col("slot") * F.lit(GOLDEN)
    slots = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("point", point - F.floor(point))
    slots = slots.withColumn("step", F.floor(F.col("point") * STEPS)).join(shares, "step").filter("lo <= point AND point < hi")
    slots = (slots.select("slot", "source").withColumn("one", F.lit(1).cast("long"))
             .withColumn("cell", F.floor(F.col("slot") / F.lit(max(1, -(-n_slots // cells))))))
    slots = offsets_in_order(slots, ["source"], "cell", ["slot"], "one", "rank").select("slot", "source", "rank")

    # each pass ends in a block that may be short: the slots that a source still lacks follow, one source after the other
    want, length = F.floor("target").cast("long"), F.col("source_size")
    need = F.floor(want / length) * F.ceil(length / block) + F.ceil((want % length) / block)
    held = staged(slots, "mix_slots")
    got = held.groupBy("source").agg(F.count(F.lit(1)).alias("got"))
    lack = plan.filter("source_size > 0").select("source", need.cast("long").alias("need")).alias("p").join(
        got.alias("g"), _same("p", "g", "source"), "left").select("p.source", "need", F.coalesce("got", F.lit(0)).alias("got")).filter("need > got")
    ends = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lack = lack.withColumn("after", F.sum(F.col("need") - F.col("got")).over(ends) - F.col("need") + F.lit(n_slots))
    more = lack.select("source", "after", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    return held.union(more.select((F.col("after") + F.col("rank")).alias("slot"), "source", "rank"))


def shuffled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: int = 11, cells: int = CELLS, extra: list[Column] | None = None) -> DataFrame:
    """doc_id, source, size, row and start: the words before the document in its source's shuffled order.

    The order is a seeded hash of id and text (row), so reruns and other partitionings agree.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
                       _row_key(id_col, text_col, seed).alias("row"), *(extra or []))
    rows = staged(rows.withColumn("cell", F.pmod("row", F.lit(cells))), "mix_rows")
    return offsets_in_order(rows, ["source"], "cell", ["row", "doc_id", "size"], "size", "start").drop("cell")


def _row_key(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK,
        weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, row (key of id and text).

    taken counts the words of the document that the mix takes, repeats counted; it is at most ``most`` times its
    size rounded up to whole passes. Null texts have size 0 and take 0; a null source is a source of its own, last in order. Rows equal in every
    column are interchangeable. An empty table gives an empty result.
    """
    rows = staged(shuffled(docs, id_col, text_col, source_col, seed), "mix_shuffled")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = staged(targets(sizes, weights, share, most).coalesce(1), "mix_plan")

    # a slot takes block (rank mod blocks) of its source, cut where the source has its target
    slots = schedule(plan, block).alias("s").join(plan.alias("p"), _same("s", "p", "source")).select(
        F.col("p.source").alias("source"), "source_size", F.floor("target").cast("long").alias("want"), "rank")
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = slots.withColumn("blocks", n_blocks).withColumn("block", F.col("rank") % F.col("blocks"))
    length = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block)
    before = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("block") * block
    slots = slots.withColumn("length", length).withColumn("take", F.greatest(F.lit(0), F.least(F.col("length"), F.col("want") - before)))
    whole = F.col("take") == F.col("length")
    uses = slots.filter("take > 0").groupBy("source", "block").agg(
        F.sum(F.when(whole, 1).otherwise(0)).cast("long").alias("times"),
        F.max(F.when(~whole, F.col("take")).otherwise(0)).cast("long").alias("part"))

    # a document's pieces, one per block that it touches
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = rows.filter("size > 0").select("doc_id", "source", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("doc_id", "source", "start", "block", (lo - F.col("block") * block).alias("lo"), (hi - F.col("block") * block).alias("hi"))
    part = F.greatest(F.lit(0), F.least("hi", "part") - F.col("lo"))
    got = (pieces.alias("a").join(uses.alias("u"), _same("a", "u", "source", "block"))
           .select("a.doc_id", "a.source", "a.start", (F.col("times") * (F.col("hi") - F.col("lo")) + part).alias("words"))
           .groupBy("doc_id", "source", "start").agg(F.sum("words").cast("long").alias("taken")))
    out = rows.alias("r").join(got.alias("g"), _same("r", "g", "doc_id", "source", "start") + [F.col("r.size") > 0], "left")
    out = out.select("r.doc_id", "r.source", "r.size", "r.row", F.coalesce("g.taken", F.lit(0)).cast("long").alias("taken"))
    return (out.alias("o").join(plan.alias("p"), _same("o", "p", "source"))
            .select("o.doc_id", "o.source", "o.size", "p.source_size", "p.target", "o.taken", "o.row"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, **options) -> DataFrame:
    """The mixed documents (all columns of ``docs``): each as often as the mix takes it, taken / size rounded to whole copies.

    Rows are told apart by id, text and source, null or repeated ids included; rows that agree in these are interchangeable and share
    the copies of all of them. Null texts have no words and are not taken. An empty table gives an empty result.
    """
    copies = F.round(F.col("taken") / F.col("size")).cast("long")
    mixed = mix(docs, id_col, text_col, source_col, seed=seed, **options).filter("size > 0")
    planned = mixed.groupBy(F.col("row").alias("__row"), F.col("source").alias("__source")).agg(
        F.sum(copies).alias("__copies"), F.count(F.lit(1)).alias("__rows")).filter("__copies > 0")
    planned = staged(planned, "mix_copies")
    keyed = docs.withColumn("__key", _row_key(id_col, text_col, seed))

    def with_copies(plan: DataFrame) -> DataFrame:
        return keyed.join(plan, (F.col("__key") == F.col("__row")) & docs[source_col].cast("string").eqNullSafe(F.col("__source")))

    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))
    alone = with_copies(planned.filter("__rows = 1")).select(*docs.columns, F.col("__copies").alias("__times"))
    repeated = staged(planned.filter("__rows > 1"), "mix_repeats")
    if repeated.isEmpty():
        return alone.withColumn("__copy", times).select(*docs.columns)

    # rows that repeat: the copies dealt over them, in the order in which they are read
    several = with_copies(repeated)
    at = F.monotonically_increasing_id()
    several = staged(several.withColumns({"__at": at, "__cell": F.shiftright(at, 33), "__one": F.lit(1).cast("long")}), "mix_repeated")
    several = offsets_in_order(several, ["__key", "__source"], "__cell", ["__at"], "__one", "__rank")
    share = F.expr("__copies div __rows") + (F.col("__rank") < F.col("__copies") % F.col("__rows")).cast("long")
    several = several.select(*docs.columns, share.alias("__times"))
    return alone.union(several).filter("__times > 0").withColumn("__copy", times).select(*docs.columns)
