"""Exact duplicates by progressive refinement: byte length, then prefix hash, then full hash.

Each level only sees the rows whose group at the level before holds two rows or more; the whole text is
hashed only for rows that agree with another row in length and prefix. All groups are counted with map-side
aggregates, so a group that holds a third of all rows is one small row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

#: Characters that the second level hashes.
PREFIX_CHARS = 256


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept; with ``digests`` also text_sha256 (lowercase hex).

    Equal texts (null counts as empty) form a group; its largest id stays. Each input row is judged by its own text: ids may
    be null or repeat. Rows that repeat an id together with its text are counted in group_size and share one verdict. A null id never beats
    another id; where all ids of a group are null, keep_id is null and the rows are kept. An empty table gives an empty result.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).alias("len"),
                       F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"))
    # both light levels on counts: one row per length and prefix, not per document
    prefixes = staged(rows.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")), "exact_prefixes")
    lengths = prefixes.groupBy("len").agg(F.sum("n").alias("held")).filter("held > 1").select("len")
    several = staged(prefixes.filter("n > 1").join(lengths, "len", "left_semi").select("len", "prefix"), "exact_suspects")

    sha = F.sha2("text", 256).alias("sha")
    alone = rows.join(several, ["len", "prefix"], "left_anti")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *([sha] if digests else []))
    # whole texts of the survivors only
    full = staged(rows.join(several, ["len", "prefix"], "left_semi").select("doc_id", "len", sha), "exact_full")
    groups = full.groupBy("len", "sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    members = full.join(groups, ["len", "sha"]).select("doc_id", "keep_id", "group_size", *(["sha"] if digests else []))
    return alone.union(members).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        *([F.col("sha").alias("text_sha256")] if digests else []))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all its columns) that stay: one row of each group of equal texts, with its largest id.

    Rows are judged by their own text: ids may be null or repeat. Of rows that agree in text and id, one stays. Null texts count as empty.
    """
    text = text_of(text_col)
    keyed = docs.withColumns({"__len": F.octet_length(text), "__prefix": F.xxhash64(F.substring(text, 1, PREFIX_CHARS))})
    # a row per group of suspects, not per suspect
    several = keyed.groupBy("__len", "__prefix").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__len", "__prefix")
    several = staged(several, "exact_suspects")
    alone = keyed.join(several, ["__len", "__prefix"], "left_anti").select(*docs.columns)
    some = keyed.join(several, ["__len", "__prefix"], "left_semi").withColumn("__sha", F.sha2(text, 256))
    kept = some.groupBy("__len", "__sha").agg(F.max_by(F.struct(*docs.columns), F.struct(id_col)).alias("row")).select("row.*")
    return alone.unionByName(kept)
