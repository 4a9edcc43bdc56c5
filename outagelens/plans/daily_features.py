"""the daily county feature table (2 keys + 30 features + target).

Plan shape (one lazy DataFrame):
  counties (distinct)  -- county-level joins: history (A16), population (J5)
     -> weighted quantile flags / median on the county table (A21/A22)
     -> explode each county over the date range  (J6 without a cross join)
     -> LEFT JOIN outage days (A19/J2) and weather days (A17/J4) on (county, date)
     -> calendar / interaction / polynomial columns (P16-P23)
Every county row expands to the same number of days, so quantiles over the
grid equal frequency-weighted quantiles over the county table: the grid is
never scanned for them. Both (county, date) joins use the same keys, so the
second reuses the first one's hash partitioning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark import StorageLevel

from ..functions import columns as P
from ..operators import aggregates as A
from ..operators.evaluation import exact_quantiles
from ..operators.sampling import sample_keys

# Fixed values that must equal the reference's: feature order of the daily model.
DAILY_FEATURES = [
    "year", "month", "day_of_week", "day_of_year", "is_weekend", "season",
    "avg_customers_affected", "max_customers_ever", "avg_duration_hours", "total_historical_outages",
    "weather_event_count", "total_property_damage", "avg_magnitude", "total_injuries", "total_deaths",
    "latest_population",
    "weather_x_population", "damage_per_capita", "customers_per_outage", "severity_score",
    "is_summer", "is_winter", "is_storm_season", "quarter",
    "high_risk_county", "extreme_weather", "high_population_density",
    "outages_squared", "population_log", "damage_log",
]
# The 16 base features used by the sampling studies (F2).
BASE_FEATURES = DAILY_FEATURES[:16]

GRID_ROWS_PER_PARTITION = 1_000_000
HISTORY_COLS = ["avg_customers_affected", "max_customers_ever", "avg_duration_hours", "total_historical_outages"]
WEATHER_COLS = ["weather_event_count", "total_property_damage", "avg_magnitude", "total_injuries", "total_deaths"]


def county_day_grid(counties: DataFrame, start, end) -> DataFrame:
    """Each county row exploded over ``[start, end]`` (inclusive, one row per day)."""
    return counties.withColumn("date", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))))


def outage_daily(outages_raw: DataFrame) -> DataFrame:
    """One row per (county, day) with outages: the only pass over the outage table.

    History (A16), the target (A19) and the date range (A20) are all derived
    from these partial sums, so the feature plan scans outages once.
    """
    return outages_raw.groupBy("county_fips", "date").agg(
        F.count("event_began").alias("_n"),
        F.count("max_customers").alias("_nc"), F.sum("max_customers").alias("_sc"),
        F.max("max_customers").alias("_mx"),
        F.count("duration_hours").alias("_nd"), F.sum("duration_hours").alias("_sd"))


def _history_from_daily(daily: DataFrame) -> DataFrame:
    """A16 from the daily partial sums (same values as ``county_history``)."""
    return daily.groupBy("county_fips").agg(
        F.try_divide(F.sum("_sc"), F.sum("_nc")).alias("avg_customers_affected"),
        F.max("_mx").alias("max_customers_ever"),
        F.try_divide(F.sum("_sd"), F.sum("_nd")).alias("avg_duration_hours"),
        F.sum("_n").cast("long").alias("total_historical_outages"),
        F.min("date").alias("_first_day"), F.max("date").alias("_last_day"))


def _history_as_of(grid: DataFrame, daily: DataFrame) -> DataFrame:
    """History features from days strictly before each grid date (no look-ahead).

    The running window spans at most the number of days per county (the
    daily table has one row per county and day).
    """
    g = grid.join(daily, ["county_fips", "date"], "left")
    w = Window.partitionBy("county_fips").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumns({
        "avg_customers_affected": F.try_divide(F.sum("_sc").over(w), F.sum("_nc").over(w)),
        "max_customers_ever": F.max("_mx").over(w),
        "avg_duration_hours": F.try_divide(F.sum("_sd").over(w), F.sum("_nd").over(w)),
        "total_historical_outages": F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long"),
    }).drop("_nc", "_sc", "_mx", "_nd", "_sd", "_n")


def daily_features(outages_raw: DataFrame, weather_raw: DataFrame, population: DataFrame,
                   start: dt.date | None = None, end: dt.date | None = None, compat_season_flags: bool = False,
                   sample_counties: int | None = None, seed: int = 42, as_of: bool = False) -> DataFrame:
    """Daily (county, date) rows with the 30 reference features and the outage target.

    Defaults build the whole grid (all counties x all days). ``sample_counties``
    reproduces the reference's county sample reproducibly (hash order);
    ``as_of=True`` computes history from earlier days only.

    The outage table is read once (``outage_daily``, persisted with disk
    spill); the date range, median and 75th percentiles are computed as a few
    scalars from the county table (one row per county) and enter the plan as
    literals, so no statistic rescans the outages.
    """
    daily = outage_daily(outages_raw).persist(StorageLevel.MEMORY_AND_DISK)
    ct = _history_from_daily(daily)
    if sample_counties:
        ct = ct.join(sample_keys(ct, "county_fips", sample_counties, seed), "county_fips", "left_semi")
    ct = ct.join(population.select("county_fips", "latest_population"), "county_fips", "left")
    ct = ct.persist(StorageLevel.MEMORY_AND_DISK)

    r = ct.agg(F.min("_first_day").alias("lo"), F.max("_last_day").alias("hi"),
               F.count(F.lit(1)).alias("n")).first()
    lo, hi = start or r["lo"], end or r["hi"]
    if lo is None or hi is None:
        lo = hi = dt.date(1970, 1, 1)
    n_days = (hi - lo).days + 1
    ct = ct.drop("_first_day", "_last_day")
    if not as_of:
        ct = ct.fillna(0, subset=HISTORY_COLS)
    else:
        ct = ct.drop(*HISTORY_COLS)
    # Grid quantiles == quantiles over counties, each weighted by n_days.
    freq = max(n_days, 1)
    med = exact_quantiles(ct, "latest_population", [0.5], freq)[0]
    q_out = None if as_of else exact_quantiles(ct, "total_historical_outages", [0.75], freq)[0]
    ct = ct.withColumn("latest_population", F.coalesce(F.col("latest_population"), F.lit(med).cast("double")))
    q_pop = exact_quantiles(ct, "latest_population", [0.75], freq)[0]
    ct = ct.withColumn("high_population_density", (F.col("latest_population") > F.lit(q_pop)).cast("int"))
    if not as_of:
        ct = ct.withColumn("high_risk_county", (F.col("total_historical_outages") > F.lit(q_out)).cast("int"))

    # spread the county rows so the day explode is generated by many tasks (~1M grid rows each)
    parts = max(1, -(-int(r["n"] or 0) * max(n_days, 1) // GRID_ROWS_PER_PARTITION))
    grid = county_day_grid(ct.repartition(parts, "county_fips"), F.lit(lo), F.lit(hi))
    if as_of:
        grid = _history_as_of(grid, daily).fillna(0, subset=HISTORY_COLS)
        grid = grid.persist(StorageLevel.MEMORY_AND_DISK)
        q_out = exact_quantiles(grid, "total_historical_outages", [0.75])[0]
        grid = grid.withColumn("high_risk_county", (F.col("total_historical_outages") > F.lit(q_out)).cast("int"))

    days = daily.select("county_fips", "date", F.lit(1).alias("target"))
    grid = grid.join(days, ["county_fips", "date"], "left").withColumn(
        "target", F.coalesce(F.col("target"), F.lit(0)).cast("int"))
    grid = grid.join(A.weather_by_day(weather_raw), ["county_fips", "date"], "left").fillna(0, subset=WEATHER_COLS)

    grid = P.calendar(grid, "date")
    grid = P.interactions(grid)
    grid = P.season_flags(grid, "season", compat=compat_season_flags)
    grid = P.storm_season_quarter(grid, "month")
    grid = grid.withColumn("extreme_weather", P.flag_positive("weather_event_count"))
    grid = P.polynomials(grid)
    return grid.select("county_fips", "date", *DAILY_FEATURES, "target")
