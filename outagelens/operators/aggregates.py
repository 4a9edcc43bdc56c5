"""Grouped and global aggregations.

Each operator is one lazy plan; grouped aggregates use Spark's partial
(map-side) aggregation, so a hot key is combined per task before the shuffle.
Results carry explicit tie keys wherever the reference sorts and cuts.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import optional_equals, pct_change, time_between, year_range
from .evaluation import exact_quantiles

# Fixed values that must equal the reference's: importance categories.
IMPORTANCE_CATEGORIES = {
    "Temporal": ["year", "month", "day_of_week", "day_of_year", "is_weekend", "season"],
    "Historical": ["avg_customers_affected", "max_customers_ever", "avg_duration_hours",
                   "total_historical_outages"],
    "Weather": ["weather_event_count", "total_property_damage", "avg_magnitude",
                "total_injuries", "total_deaths"],
    "Demographics": ["latest_population"],
}


# -- A1 / A2 / A3 ----------------------------------------------------------------------------
def _county_rollup(outages: DataFrame, time_col: str, measures: dict[str, F.Column]) -> DataFrame:
    """Two-phase county aggregate that keeps the heavy pass on HashAggregate.

    Phase 1 groups by (county, name, state) with numeric buffers only, so the
    full scan is hash-aggregated map-side; phase 2 folds the (few) name/state
    variants of a county and picks the earliest one's name and state
    (a deterministic FIRST). ``measures`` are partial sums/counts combined in
    phase 2 by summing.
    """
    p1 = outages.groupBy("county_fips", "county_name", "state").agg(
        F.min(time_col).alias("_first"), F.count(F.lit(1)).alias("_n"), *[e.alias(k) for k, e in measures.items()])
    order = F.struct(F.col("_first"), F.col("county_name"), F.col("state"))
    return p1.groupBy("county_fips").agg(
        F.min_by(F.struct("county_name", "state"), order).alias("_cs"),
        F.sum("_n").alias("outage_count"), *[F.sum(k).alias(k) for k in measures],
    ).select("county_fips", "_cs.county_name", "_cs.state", "outage_count", *measures)


def by_county(outages: DataFrame, year: int | None = None, time_col: str = "start_time") -> DataFrame:
    """county -> first name, first state, count. ``outages`` is the S1 view."""
    df = outages if year is None else outages.filter(year_range(time_col, year))
    return _county_rollup(df, time_col, {})


def hotspots(outages: DataFrame) -> DataFrame:
    """county -> count, customer-hours, mean duration; by impact, descending."""
    r = _county_rollup(outages, "start_time", {
        "_ch": F.sum(F.col("max_customers") * F.col("duration_hours")),
        "_sd": F.sum("duration_hours"),
        "_nd": F.count("duration_hours"),
    })
    return (
        r.select("county_fips", "county_name", "state", "outage_count",
                 F.round(F.col("_ch")).alias("customer_hours"),
                 F.round(F.col("_sd") / F.col("_nd"), 2).alias("avg_duration_hours"))
        .orderBy(F.col("customer_hours").desc(), F.col("county_fips"))
    )


# -- A5 + J12 -------------------------------------------------------------------
def seasonal(outages: DataFrame, top: int = 15) -> DataFrame:
    """(state, month) -> outages, kept for the ``top`` busiest states."""
    by_month = (
        outages.filter(F.col("state") != "")
        .groupBy("state", F.month("start_time").alias("month"))
        .agg(F.count(F.lit(1)).alias("outages"))
    )
    busiest = keep_top_keys(by_month, "state", "outages", top)
    return by_month.join(busiest, "state", "left_semi")


def keep_top_keys(df: DataFrame, key: str, measure: str, k: int) -> DataFrame:
    """The ``k`` keys with the largest summed measure (ties: smaller key first).

    The input is already aggregated, so the top-k is a TakeOrderedAndProject
    over one row per key; the result has exactly ``k`` rows and is safe to
    broadcast into the semi join.
    """
    totals = df.groupBy(key).agg(F.sum(measure).alias("_total"))
    return F.broadcast(totals.orderBy(F.col("_total").desc(), F.col(key)).limit(k).select(key))


# -- A6 -----------------------------------------------------------------------
def by_event_type(outages: DataFrame, top: int | None = 15) -> DataFrame:
    """event type (null is a group) -> count, mean customers, mean duration."""
    out = (
        outages.groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("max_customers").alias("avg_customers"),
            F.avg("duration_hours").alias("avg_duration"),
        )
        .orderBy(F.col("count").desc(), F.col("event_type").asc_nulls_first())
    )
    return out.limit(top) if top else out


# -- A7 -----------------------------------------------------------------------
# Fixed values that must equal the reference's: the five regions and their states.
REGION_STATES = {
    "Northeast": ("Connecticut", "Maine", "Massachusetts", "New Hampshire", "Rhode Island", "Vermont", "New Jersey", "New York", "Pennsylvania"),
    "Southeast": ("Delaware", "Florida", "Georgia", "Maryland", "North Carolina", "South Carolina", "Virginia", "West Virginia", "Alabama",
                  "Kentucky", "Mississippi", "Tennessee", "Arkansas", "Louisiana"),
    "Midwest": ("Illinois", "Indiana", "Michigan", "Ohio", "Wisconsin", "Iowa", "Kansas", "Minnesota", "Missouri", "Nebraska", "North Dakota", "South Dakota"),
    "Southwest": ("Arizona", "New Mexico", "Oklahoma", "Texas"),
    "West": ("Colorado", "Idaho", "Montana", "Nevada", "Utah", "Wyoming", "Alaska", "California", "Hawaii", "Oregon", "Washington"),
}


def region_dimension(spark: SparkSession) -> DataFrame:
    """(state, region) of the 50 states."""
    return spark.createDataFrame([(s, r) for r, states in REGION_STATES.items() for s in states], "state string, region string")


def by_region(outages: DataFrame, regions: DataFrame | None = None, state_col: str = "state") -> DataFrame:
    """region -> outage count, mean and total customers; empty region gives 0. Without ``regions``: the five regions of the 50 states.

    Outages are first reduced to one row per state (partial aggregation, no
    wide shuffle), then joined to the small region dimension.
    """
    regions = region_dimension(outages.sparkSession) if regions is None else regions
    per_state = outages.groupBy(F.col(state_col).alias("state")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("max_customers").alias("_nc"),
        F.sum("max_customers").alias("_sc"),
    )
    j = regions.select("state", "region").join(per_state, "state", "left")
    return j.groupBy("region").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("outage_count"),
        F.coalesce(F.try_divide(F.sum("_sc"), F.sum("_nc")), F.lit(0.0)).alias("avg_customers_affected"),
        F.coalesce(F.sum("_sc"), F.lit(0.0)).alias("total_customers_affected"),
    )


# -- A8 -----------------------------------------------------------------------
def compare_states(outages: DataFrame, state1: str, state2: str) -> DataFrame:
    return (
        outages.filter(F.col("state").isin(state1, state2))
        .groupBy("state")
        .agg(
            F.count(F.lit(1)).alias("outage_count"),
            F.avg("max_customers").alias("avg_customers"),
            F.avg("duration_hours").alias("avg_duration"),
        )
    )


# -- A9 -----------------------------------------------------------------------
def compare_years(outages: DataFrame, year1: int, year2: int, time_col: str = "event_began") -> DataFrame:
    """Both years in one pass (conditional aggregates) + guarded % change."""
    in1, in2 = year_range(time_col, year1), year_range(time_col, year2)
    agg = outages.filter(in1 | in2).agg(
        F.count_if(in1).alias("outages_1"),
        F.count_if(in2).alias("outages_2"),
        F.coalesce(F.sum(F.when(in1, F.col("max_customers"))), F.lit(0.0)).alias("customers_1"),
        F.coalesce(F.sum(F.when(in2, F.col("max_customers"))), F.lit(0.0)).alias("customers_2"),
    )
    return agg.select(
        F.lit(year1).alias("year_1"), F.lit(year2).alias("year_2"), "*",
        F.when(F.col("outages_1") > 0, pct_change("outages_1", "outages_2")).alias("outages_change_pct"),
        F.when(F.col("customers_1") > 0, pct_change("customers_1", "customers_2")).alias("customers_change_pct"),
    )


# -- A10 / A11 / L4 ---------------------------------------------------------------
def monthly_trend(outages: DataFrame, states: Sequence[str], time_col: str = "event_began") -> DataFrame:
    return (
        outages.filter(F.col("state").isin(*states) & F.col(time_col).isNotNull())
        .groupBy(F.date_format(time_col, "yyyy-MM").alias("month"), "state")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def month_of_year(outages: DataFrame, years: Sequence[int], time_col: str = "event_began") -> DataFrame:
    cond = F.lit(False)
    for y in years:
        cond = cond | year_range(time_col, y)
    return (
        outages.filter(cond)
        .groupBy(F.year(time_col).alias("year"), F.month(time_col).alias("month"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


# -- A12 ----------------------------------------------------------------------
def top_event_types(outages: DataFrame, states: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Per state, the ``k`` most frequent event types (null types dropped, N4)."""
    df = outages.filter(F.col("event_type").isNotNull())
    if states:
        df = df.filter(F.col("state").isin(*states))
    counts = df.groupBy("state", "event_type").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("state").orderBy(F.col("count").desc(), F.col("event_type"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# -- A13 / A14 / J10 ------------------------------------------------------------
def county_outage_profile(outages: DataFrame, limit: int | None = None) -> DataFrame:
    """The reference caps this at 2000 unordered groups; ours keeps all by default."""
    df = outages.filter(F.col("county_fips").isNotNull() & F.col("max_customers").isNotNull())
    out = df.groupBy("county_fips").agg(
        F.count(F.lit(1)).alias("outage_count"),
        F.avg("max_customers").alias("avg_customers"),
        F.max("max_customers").alias("max_customers"),
        F.avg("duration_hours").alias("avg_duration"),
        F.sum("max_customers").alias("total_customers"),
    )
    return out.limit(limit) if limit else out


def county_weather_profile(storms: DataFrame) -> DataFrame:
    return storms.filter(F.col("county_fips").isNotNull()).groupBy("county_fips").agg(
        F.count(F.lit(1)).alias("weather_event_count"),
        F.avg("damage_property").alias("avg_damage"),
        F.coalesce(F.sum("injuries"), F.lit(0.0)).alias("total_injuries"),
        F.coalesce(F.sum("deaths"), F.lit(0.0)).alias("total_deaths"),
    )


def county_profile(outage_profile: DataFrame, weather_profile: DataFrame, population: DataFrame) -> DataFrame:
    """outages LEFT weather LEFT population, named numeric gaps filled with 0."""
    j = outage_profile.join(weather_profile, "county_fips", "left").join(population, "county_fips", "left")
    return j.fillna(0, subset=["weather_event_count", "avg_damage", "total_injuries",
                               "total_deaths", "latest_population"])


# -- A15 ----------------------------------------------------------------------
def abs_correlations(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """|Pearson(feature, target)|, pair-complete, NaN-safe; undefined ones dropped.

    One pass computes every coefficient; a constant column yields NULL
    (``try_divide``) rather than a division error, and is dropped.
    """
    t = F.col(target).cast("double")
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & t.isNotNull() & ~F.isnan(t)
        xp, tp = F.when(ok, x), F.when(ok, t)
        aggs.append(F.try_divide(F.covar_pop(xp, tp), F.stddev_pop(xp) * F.stddev_pop(tp)).alias(f))
    wide = df.agg(*aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("c")) for f in features]))
    return (
        wide.select(pairs.alias("p"))
        .select(F.col("p.feature").alias("feature"), F.abs(F.col("p.c")).alias("correlation"))
        .filter(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
        .orderBy(F.col("correlation").desc(), F.col("feature"))
    )


# -- A16-A20 ------------------------------------------------------------------------
def county_history(outages_raw: DataFrame) -> DataFrame:
    """Whole-history county profile (as the reference computes it, future included)."""
    return outages_raw.groupBy("county_fips").agg(
        F.avg("max_customers").alias("avg_customers_affected"),
        F.max("max_customers").alias("max_customers_ever"),
        F.avg("duration_hours").alias("avg_duration_hours"),
        F.count("event_began").alias("total_historical_outages"),
    )


def weather_by_day(weather_raw: DataFrame) -> DataFrame:
    return weather_raw.groupBy("county_fips", "date").agg(
        F.count("event_type").alias("weather_event_count"),
        F.coalesce(F.sum("damage_property"), F.lit(0.0)).alias("total_property_damage"),
        F.avg("magnitude").alias("avg_magnitude"),
        F.coalesce(F.sum("injuries"), F.lit(0.0)).alias("total_injuries"),
        F.coalesce(F.sum("deaths"), F.lit(0.0)).alias("total_deaths"),
    )


def generators_by_county(gens: DataFrame, keys: Sequence[str] = ("state", "county")) -> DataFrame:
    """Sum MW, mean age per county. ``keys=('county',)`` reproduces the name-only key."""
    return gens.groupBy(*keys).agg(
        F.coalesce(F.sum("nameplate_capacity_mw"), F.lit(0.0)).alias("total_capacity_mw"),
        F.avg("age_years").alias("avg_generator_age"),
    ).withColumnRenamed("county", "county_name")


def outage_days(outages_raw: DataFrame) -> DataFrame:
    """Distinct (county, date) with an outage -> target 1."""
    return outages_raw.select("county_fips", "date").distinct().withColumn("target", F.lit(1))


def extent(outages_raw: DataFrame, date_col: str = "date") -> DataFrame:
    return outages_raw.agg(
        F.min(date_col).alias("min_date"),
        F.max(date_col).alias("max_date"),
        F.count_distinct("county_fips").alias("n_counties"),
    )


# -- A21 / A22 ------------------------------------------------------------------------
def quantile_value(df: DataFrame, col: str, q: float, approx: bool = False) -> DataFrame:
    """One-row frame with the q-quantile (exact linear interpolation by default)."""
    if approx:
        return df.agg(F.percentile_approx(col, q, 100000).cast("double").alias("_q"))
    return df.sparkSession.range(1).select(F.lit(exact_quantiles(df, col, [q])[0]).cast("double").alias("_q"))


def flag_above_quantile(df: DataFrame, col: str, out: str, q: float = 0.75, approx: bool = False) -> DataFrame:
    """``out = (col > quantile_q(col))`` as 0/1; the quantile is a scalar subquery."""
    qv = quantile_value(df, col, q, approx).scalar()
    return df.withColumn(out, (F.col(col) > qv).cast("int"))


def impute_median(df: DataFrame, col: str) -> DataFrame:
    med = exact_quantiles(df, col, [0.5])[0]
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(med).cast("double")))


# -- A23 / A24 / A25 --------------------------------------------------------------------
def class_balance(df: DataFrame, label: str = "target") -> DataFrame:
    counts = df.groupBy(F.col(label).alias(label)).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over the (at most a few) class rows only
    return counts.select(
        label, "n",
        (F.col("n") / F.sum("n").over(w)).alias("share"),
        (F.max("n").over(w) / F.min("n").over(w)).alias("imbalance_ratio"),
    )


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature -> mean, sample std, min, max; one aggregation pass over all columns."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                 F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"))
        for c in cols]))
    return wide.select(rows.alias("r")).select("r.*")


def score_profile(df: DataFrame, p: str = "p", label: str = "target") -> DataFrame:
    prob = F.col(p)
    quarters = [F.lit(v).cast("double") for v in exact_quantiles(df, p, [0.25, 0.5, 0.75])]
    return df.agg(
        F.min(prob).alias("p_min"),
        *[F.first(v).alias(n) for v, n in zip(quarters, ("p25", "p50", "p75"))],
        F.max(prob).alias("p_max"),
        F.count_if(prob > 0.5).alias("n_above_50"),
        F.avg((prob > 0.5).cast("double")).alias("share_above_50"),
        F.count_if(prob > 0.7).alias("n_above_70"),
        F.avg((prob > 0.7).cast("double")).alias("share_above_70"),
        F.sum(F.col(label)).cast("long").alias("positives"),
    )


# -- A26 / A27 ------------------------------------------------------------------------------
def state_period(outages: DataFrame, state: str, start: _dt.datetime, end: _dt.datetime,
                 compat_bounds: bool = False, time_col: str = "start_time") -> DataFrame:
    """Equality + time range. Default half-open ``[start, end)``; ``compat_bounds`` closes the end.

    Rows carry the study's defaults: missing county name 'Unknown', missing
    customers / duration 0.
    """
    rows = outages.filter((F.col("state") == state) & time_between(time_col, start, end, closed_end=compat_bounds))
    return rows.withColumns({
        "county_name": F.coalesce(F.col("county_name"), F.lit("Unknown")),
        "max_customers": F.coalesce(F.col("max_customers").cast("double"), F.lit(0.0)),
        "duration_hours": F.coalesce(F.col("duration_hours").cast("double"), F.lit(0.0)),
    })


def period_kpis(period: DataFrame) -> DataFrame:
    return period.agg(
        F.count(F.lit(1)).alias("outage_events"),
        F.count_distinct("county_name").alias("counties_affected"),
        F.max("max_customers").alias("peak_customers"),
    )


def period_top_counties(period: DataFrame, k: int = 15) -> DataFrame:
    return (period.groupBy("county_name").agg(F.sum("max_customers").alias("max_customers"))
            .orderBy(F.col("max_customers").desc(), F.col("county_name")).limit(k))


def map_kpis(by_county_df: DataFrame) -> DataFrame:
    return by_county_df.agg(
        F.count(F.lit(1)).alias("counties"),
        F.coalesce(F.sum("outage_count"), F.lit(0)).alias("total_outages"),
        F.coalesce(F.max("outage_count"), F.lit(0)).alias("max_in_one_county"),
    )


# -- A28 ----------------------------------------------------------------------------
def importance_by_category(importances: DataFrame, categories: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Sum of importance per category; features in no category are reported as 'Other'."""
    categories = categories or IMPORTANCE_CATEGORIES
    spark = importances.sparkSession
    dim = spark.createDataFrame([(f, c) for c, fs in categories.items() for f in fs], "feature string, category string")
    return (
        importances.join(F.broadcast(dim), "feature", "left")
        .groupBy(F.coalesce(F.col("category"), F.lit("Other")).alias("category"))
        .agg(F.sum("importance").alias("importance"))
    )


# -- A29 ----------------------------------------------------------------------------
def score_histogram(df: DataFrame, p: str = "p", label: str = "target", bins: int = 50) -> DataFrame:
    """Exact ``bins`` equal-width buckets on [0, 1]; p = 1 falls in the last bucket."""
    bucket = F.least(F.width_bucket(F.col(p), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return df.groupBy(F.col(label).alias(label), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# -- A30 ----------------------------------------------------------------------------
def warning_kpis(preds: DataFrame, threshold: float, window_hours: int | None = None, state: str | None = None) -> DataFrame:
    df = preds
    if window_hours is not None:
        df = df.filter(F.col("window_hours") == window_hours)
    df = df.filter(optional_equals("state", state))
    p = F.coalesce(F.col("outage_probability"), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("counties_monitored"),
        F.count_if(p >= threshold).alias("active_warnings"),
        F.coalesce(F.max(p), F.lit(0.0)).alias("max_probability"),
        F.max("prediction_time").alias("latest_time"),
        F.coalesce(F.min("model_used"), F.lit("Existing ML model")).alias("model_name"),
    )


# -- A31 ----------------------------------------------------------------------------
def states(outages: DataFrame, state_col: str = "state") -> DataFrame:
    return (outages.select(F.col(state_col).alias("state"))
            .filter(F.col("state").isNotNull() & (F.col("state") != "")).distinct().orderBy("state"))
