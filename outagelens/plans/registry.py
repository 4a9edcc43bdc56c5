"""Query registry: the ``query`` decorator and the two maps it fills.

Every implemented operator is registered as (spark, sf_dir) -> DataFrame.

Each entry runs over the whole driver tables (through the fixture adapters)
and, where the operator is deterministic, carries the equivalent DuckDB SQL.
Double measures listed in ``dbl`` are rounded to 6 places on both sides,
because float sums depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle_base import rounded, with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _digits(dbl):
    """``"col"`` rounds to 6 places, ``"col:2"`` to 2 (large money sums)."""
    out = []
    for spec in dbl:
        col, _, d = spec.partition(":")
        out.append((col, int(d) if d else 6))
    return out


def query(name: str, sql: str | None = None, dbl: tuple[str, ...] = ()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if dbl:
                df = df.withColumns({c: F.round(F.col(c), d) for c, d in _digits(dbl)})
            return df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = rounded(with_adapters(sql), _digits(dbl))
        return run
    return deco
