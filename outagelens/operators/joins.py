"""Equi, interval, anti, semi and lookup joins.

Interval joins never pair rows on the county key alone: a county holding a
third of all events would put every candidate pair into one task. Both sides
are keyed by ``(county, time bucket)``. One side stays in its own bucket, the
other is copied to every bucket its interval can reach (by default the bucket
width equals the interval length, so that is two buckets), and the residual
condition keeps the result exact. AQE skew handling splits any bucket that is
still large; a finer ``bucket_hours`` splits a hot county-week further.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WINDOWS_HOURS

_US_PER_HOUR = 3_600_000_000


def _bucket(ts: str | F.Column, width_us: int) -> F.Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(width_us)).cast("long")


# -- J1 -----------------------------------------------------------------------------------
def storm_pairs(outages: DataFrame, storms: DataFrame, days: int = 7, key: str = "county_fips",
                bucket_hours: int | None = None) -> DataFrame:
    """Outage/storm pairs with ``storm_time`` in ``[start_time - days, start_time]`` (both ends closed).

    Rows are keyed by ``(county, time bucket)``. The outage stays in its own
    bucket; the storm is copied to every bucket its window can reach
    (``[s, s + days]``): its own and the next with the default bucket width
    of ``days``, more with a finer ``bucket_hours``. A finer width splits a hot
    county-week over many tasks at the cost of more storm copies; the result
    is the same.
    """
    width = int(bucket_hours or days * 24) * _US_PER_HOUR
    span = days * 24 * _US_PER_HOUR
    o = outages.select(F.col(key).alias("county_fips"), "start_time",
                       _bucket("start_time", width).alias("_b"))
    s = storms.select(F.col(key).alias("_skey"), "storm_time", "storm_event_type",
                      F.unix_micros("storm_time").alias("_st"))
    last = F.floor((F.col("_st") + F.lit(span)) / F.lit(width)).cast("long")
    s = s.withColumn("_b", F.explode(F.sequence(_bucket("storm_time", width), last)))
    cond = [
        o.county_fips == s._skey,
        o._b == s._b,
        s.storm_time <= o.start_time,
        s.storm_time >= o.start_time - F.expr(f"INTERVAL {int(days)} DAYS"),
    ]
    return o.join(s, cond, "inner").select("storm_event_type", "county_fips", "start_time", "storm_time")


def outage_ranks(outages: DataFrame, key: str = "county_fips", ts: str = "start_time", block_hours: int = 168) -> DataFrame:
    """county_fips, start_time, rank: the outages of a county in time order, from 0. Null keys and times have no rank.

    Ranks are taken inside blocks of time, behind the counts of the blocks before: a county of any size spreads over its blocks.
    """
    o = outages.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("county_fips"), F.col(ts).alias("start_time"), _bucket(ts, block_hours * _US_PER_HOUR).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("county_fips", "_b").orderBy("start_time")) - 1
    return o.withColumn("_in", inside).join(_offsets(o.withColumn("_one", F.lit(1))), ["county_fips", "_b"]).select(
        "county_fips", "start_time", (F.col("_before") + F.col("_in")).alias("rank"))


def _offsets(rows: DataFrame) -> DataFrame:
    """county_fips, _b, _before: the sum of ``_one`` over the county's earlier blocks; a county has a row for each of its blocks."""
    earlier = Window.partitionBy("county_fips").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("county_fips", "_b").agg(F.sum("_one").alias("_n")).select(
        "county_fips", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def storm_ranges(outages: DataFrame, storms: DataFrame, days: int = 7, key: str = "county_fips", block_hours: int = 168) -> DataFrame:
    """The interval join as rank ranges: the storms (all rows and columns) with first_rank and last_rank.

    The outages of the storm's county in ``[storm_time, storm_time + days]`` are those of rank first_rank .. last_rank - 1 in
    :func:`outage_ranks`: one row per storm, however many pairs there are. Storms without key or time have the empty range 0, 0.
    """
    span, width = days * 24 * _US_PER_HOUR, block_hours * _US_PER_HOUR
    asked = storms.filter(F.col(key).isNotNull() & F.col("storm_time").isNotNull()).select(
        F.col(key).alias("county_fips"), F.unix_micros("storm_time").alias("_s")).distinct()
    # a storm asks how many outages lie before it, and how many up to its end
    ends = F.array(F.struct(F.col("_s").alias("t"), F.lit(False).alias("last")), F.struct((F.col("_s") + F.lit(span)).alias("t"), F.lit(True).alias("last")))
    asked = asked.select("county_fips", "_s", F.explode(ends).alias("e")).select("county_fips", F.col("e.t").alias("_t"), "_s", F.col("e.last").alias("_last"), F.lit(0).alias("_one"))
    o = outages.filter(F.col(key).isNotNull() & F.col("start_time").isNotNull()).select(
        F.col(key).alias("county_fips"), F.unix_micros("start_time").alias("_t"), F.lit(None).cast("long").alias("_s"), F.lit(None).cast("boolean").alias("_last"), F.lit(1).alias("_one"))
    both = o.union(asked).withColumn("_b", F.floor(F.col("_t") / F.lit(width)).cast("long"))
    by_time = Window.partitionBy("county_fips", "_b").orderBy("_t")
    before = F.coalesce(F.sum("_one").over(by_time.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("_one").over(by_time.rangeBetween(Window.unboundedPreceding, 0))
    placed = both.withColumns({"_lt": before, "_le": upto}).filter("_s IS NOT NULL").join(_offsets(both), ["county_fips", "_b"])
    found = placed.groupBy("county_fips", "_s").agg(
        F.max(F.when(~F.col("_last"), F.col("_before") + F.col("_lt"))).alias("first_rank"), F.max(F.when(F.col("_last"), F.col("_before") + F.col("_le"))).alias("last_rank"))
    s, f = storms.withColumn("_at", F.unix_micros("storm_time")).alias("s"), found.alias("f")
    joined = s.join(f, (F.col(f"s.{key}") == F.col("f.county_fips")) & (F.col("s._at") == F.col("f._s")), "left")
    return joined.select(*(f"s.{c}" for c in storms.columns), *(F.coalesce(f"f.{c}", F.lit(0)).cast("long").alias(c) for c in ("first_rank", "last_rank")))


def expand_ranges(ranges: DataFrame, ranks: DataFrame, key: str = "county_fips") -> DataFrame:
    """The pairs of rank ranges on demand: storm_event_type, county_fips, start_time, storm_time. Dealt by (county, rank), so no county is one task."""
    each = ranges.filter("last_rank > first_rank").select(
        F.col(key).alias("county_fips"), "storm_time", "storm_event_type", F.explode(F.sequence(F.col("first_rank"), F.col("last_rank") - 1)).alias("rank"))
    return each.join(ranks, ["county_fips", "rank"]).select("storm_event_type", "county_fips", "start_time", "storm_time")


def storm_lift(outages: DataFrame, storms: DataFrame, days: int = 7, bucket_hours: int | None = None) -> DataFrame:
    """Storm type -> pairings and distinct counties, busiest first.

    Counted without building a pair: every storm takes the number of its county's outages in
    ``[storm_time, storm_time + days]`` from running counts, which are then summed by type.
    """
    from .windows import Trail, trailing

    end = F.col("storm_time") + F.expr(f"INTERVAL {int(days)} DAYS")
    s = storms.filter(F.col("county_fips").isNotNull() & F.col("storm_time").isNotNull()).select(
        "county_fips", "storm_event_type", end.alias("_end"))
    o = outages.filter(F.col("county_fips").isNotNull() & F.col("start_time").isNotNull()).select("county_fips", "start_time")
    n = trailing(s, o, [Trail("_n", "count", days * 24)], ts="_end", event_ts="start_time", chunk_hours=bucket_hours, closed_end=True)
    return (
        n.filter(F.col("_n") > 0).groupBy("storm_event_type")
        .agg(F.sum("_n").alias("pairings"), F.count_distinct("county_fips").alias("counties_seen"))
        .orderBy(F.col("pairings").desc(), F.col("storm_event_type"))
    )


# -- J7 -----------------------------------------------------------------------------------
def without_future_event(cands: DataFrame, events: DataFrame, key: str = "county_fips",
                         ts: str = "prediction_time", window_col: str = "window_hours",
                         event_ts: str = "event_time", max_window_hours: int | None = None,
                         bucket_hours: int | None = None) -> DataFrame:
    """Candidates with no event in ``[ts, ts + window_hours)`` for their key (left anti).

    Events are copied to every bucket whose candidates can reach them; each candidate probes only
    its own bucket. The reach is the longest window among the candidates (one small aggregate), or
    ``max_window_hours`` where the caller knows a bound; a candidate beyond that bound fails the query.
    """
    return _future_join(cands, events, key, ts, window_col, event_ts, max_window_hours, "left_anti", bucket_hours)


def _future_join(cands, events, key, ts, window_col, event_ts, max_window_hours, how, bucket_hours=None):
    if max_window_hours is None:
        longest = cands.agg(F.max(F.ceil(window_col))).first()[0]
        max_window_hours = max(1, int(longest or 1))
    else:
        held = F.col(window_col) <= F.lit(max_window_hours)
        cands = cands.withColumn(window_col, F.when(held | F.col(window_col).isNull(), F.col(window_col)).otherwise(
            F.raise_error(F.concat(F.lit(f"window beyond max_window_hours = {max_window_hours}: "), F.col(window_col).cast("string")))))
    width = int(bucket_hours or min(max_window_hours, max(WINDOWS_HOURS))) * _US_PER_HOUR
    span = int(max_window_hours) * _US_PER_HOUR
    c = cands.withColumn("_b", _bucket(ts, width))
    e = events.select(F.col(key).alias("_ekey"), F.col(event_ts).alias("_et"),
                      F.unix_micros(F.col(event_ts)).alias("_eu"))
    # a candidate at t reaches events in [t, t + span): t in (e - span, e]
    first = F.floor((F.col("_eu") - F.lit(span) + F.lit(1)) / F.lit(width)).cast("long")
    e = e.withColumn("_b", F.explode(F.sequence(first, _bucket("_et", width))))
    end = F.timestamp_add("HOUR", F.col(window_col), F.col(ts))
    cond = [c[key] == e._ekey, c._b == e._b, e._et >= c[ts], e._et < end]
    return c.join(e, cond, how).drop("_b")


def with_future_event(cands: DataFrame, events: DataFrame, key: str = "county_fips",
                      ts: str = "prediction_time", window_col: str = "window_hours",
                      event_ts: str = "event_time", max_window_hours: int | None = None,
                      bucket_hours: int | None = None) -> DataFrame:
    """The complement of ``without_future_event`` (left semi), for label checks."""
    return _future_join(cands, events, key, ts, window_col, event_ts, max_window_hours, "left_semi", bucket_hours)


# -- J9 / W4 --------------------------------------------------------------------------------
def county_lookup(outages: DataFrame, key: str = "county_fips", ts: str = "event_time") -> DataFrame:
    """One (name, state) per county: the earliest event's (ties: smallest name).

    The full scan is a hash aggregate on (county, name, state); only the few
    variants per county are folded by ``min_by``, so a hot county never has to
    be gathered or sorted in one place.
    """
    p1 = outages.groupBy(key, "county_name", "state").agg(F.min(ts).alias("_first"))  # hash aggregate
    order = F.struct(F.col("_first"), F.col("county_name"), F.col("state"))
    return p1.groupBy(key).agg(
        F.min_by(F.struct("county_name", "state"), order).alias("_m")
    ).select(key, "_m.county_name", "_m.state")


def lookup_with_default(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """LEFT join to a one-row-per-key dimension; missing attributes take ``defaults``."""
    j = df.join(dim, key, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# -- J11 ---------------------------------------------------------------------------------------
def predictions_with_truth(preds: DataFrame, truth: DataFrame, keys: Sequence[str] = ("county_fips", "date")) -> DataFrame:
    """Join stored predictions to labels on the row key (never by position)."""
    return preds.join(truth, list(keys), "inner")


# -- J13 --------------------------------------------------------------------------------------
def explode_windows(df: DataFrame, hours: Sequence[int] = WINDOWS_HOURS, col: str = "window_hours") -> DataFrame:
    return df.withColumn(col, F.explode(F.array(*[F.lit(int(h)) for h in hours])))
