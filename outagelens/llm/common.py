"""Helpers shared by the training-data operators: words, staged tables, literal tables, distributed ranks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: The white space that separates words: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: Column | str) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs without white space (empty array for null, empty or blank texts)."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.coalesce(F.octet_length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WHITE_RUN))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.coalesce(F.octet_length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(
        F.size(F.split(trimmed, WHITE_RUN))).cast("long")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder (``spark.checkpoint.dir``) and read it back.

    Cuts the lineage; an executor lost later costs a reread, not a recomputation. Every call has its own path.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The Arrow batches in slices of few rows, so that a task's Python objects and outputs stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def session_options(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    """SQL options that hold for the actions inside; the session has its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_arrow_batches(spark: SparkSession, rows: int = 1000):
    """Inside, Spark hands texts to Python in batches of few rows: the buffers of both sides stay small."""
    return session_options(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def large_joins_pruned(spark: SparkSession):
    """Inside, Spark puts its runtime Bloom filter (of bounded size) before the shuffle of a joined table of any size.

    It applies where the other side carries a filter; results don't depend on it.
    """
    return session_options(spark, {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
                                   "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"})


def literal_table(spark: SparkSession, schema: str, rows: list[dict]) -> DataFrame:
    """A small table as one literal expression (no Python rows in the plan)."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def offsets_in_order(df: DataFrame, group: list[str], cell: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows that precede a row in its group, ordered by (cell, order).

    A group is never sorted in one task: totals per (group, cell) are summed map-side, their running total
    runs over at most one row per cell, and only the rows of one cell are sorted together.
    """
    keys = [*group, cell]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__total")
    inside = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = df.alias("l").join(totals.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return (joined.select("l.*", F.col("r.__before"))
            .withColumn(out, F.col("__before") + F.coalesce(inside, F.lit(0))).drop("__before"))
