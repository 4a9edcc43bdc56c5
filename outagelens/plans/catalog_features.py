"""Catalog entries: feature tables (F1, F3) and sampling (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as P
from ..functions.columns import WINDOWS_HOURS
from ..operators import joins as J
from ..operators import sampling as B
from ..sources import fixtures as fx
from ..sources import loaders as L
from . import daily_features as D
from . import warning_features as WF
from .registry import query
from .catalog_aggregates import oraw, popl, wraw

F1_SQL = """
WITH counties AS (SELECT DISTINCT county_fips FROM oraw),
ext AS (SELECT min(date) AS lo, max(date) AS hi FROM oraw),
dates AS (SELECT CAST(d AS DATE) AS date FROM ext,
          generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(d)),
hist AS (SELECT county_fips, avg(max_customers) AS avg_customers_affected, max(max_customers) AS max_customers_ever,
                avg(duration_hours) AS avg_duration_hours, count(event_began) AS total_historical_outages
         FROM oraw GROUP BY county_fips),
od AS (SELECT DISTINCT county_fips, date FROM oraw),
wd AS (SELECT county_fips, date, count(event_type) AS weather_event_count,
              coalesce(sum(damage_property), 0.0) AS total_property_damage, avg(magnitude) AS avg_magnitude,
              coalesce(sum(injuries), 0.0) AS total_injuries, coalesce(sum(deaths), 0.0) AS total_deaths
       FROM wraw GROUP BY county_fips, date),
g0 AS (
  SELECT c.county_fips, d.date,
         coalesce(h.avg_customers_affected, 0.0) AS avg_customers_affected,
         coalesce(h.max_customers_ever, 0.0) AS max_customers_ever,
         coalesce(h.avg_duration_hours, 0.0) AS avg_duration_hours,
         coalesce(h.total_historical_outages, 0) AS total_historical_outages,
         p.latest_population AS pop0,
         CASE WHEN od.county_fips IS NULL THEN 0 ELSE 1 END AS target,
         coalesce(wd.weather_event_count, 0) AS weather_event_count,
         coalesce(wd.total_property_damage, 0.0) AS total_property_damage,
         coalesce(wd.avg_magnitude, 0.0) AS avg_magnitude,
         coalesce(wd.total_injuries, 0.0) AS total_injuries,
         coalesce(wd.total_deaths, 0.0) AS total_deaths
  FROM counties c CROSS JOIN dates d
  LEFT JOIN hist h ON h.county_fips = c.county_fips
  LEFT JOIN popl p ON p.county_fips = c.county_fips
  LEFT JOIN od ON od.county_fips = c.county_fips AND od.date = d.date
  LEFT JOIN wd ON wd.county_fips = c.county_fips AND wd.date = d.date),
g1 AS (SELECT * EXCLUDE (pop0), coalesce(pop0, (SELECT median(pop0) FROM g0)) AS latest_population FROM g0),
g2 AS (
  SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(date) AS INTEGER) AS day_of_year
  FROM g1),
g3 AS (
  SELECT *, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend, CAST((month % 12) // 3 + 1 AS INTEGER) AS season
  FROM g2)
SELECT county_fips, date, year, month, day_of_week, day_of_year, is_weekend, season,
       avg_customers_affected, max_customers_ever, avg_duration_hours, total_historical_outages,
       weather_event_count, total_property_damage, avg_magnitude, total_injuries, total_deaths, latest_population,
       weather_event_count * latest_population / 100000.0 AS weather_x_population,
       total_property_damage / (latest_population + 1.0) AS damage_per_capita,
       avg_customers_affected / (total_historical_outages + 1.0) AS customers_per_outage,
       avg_magnitude * weather_event_count * (total_injuries + total_deaths + 1.0) AS severity_score,
       CAST(season = 3 AS INTEGER) AS is_summer, CAST(season = 1 AS INTEGER) AS is_winter,
       CAST(month IN (6, 7, 8, 9) AS INTEGER) AS is_storm_season, CAST((month - 1) // 3 + 1 AS INTEGER) AS quarter,
       CAST(total_historical_outages > (SELECT quantile_cont(total_historical_outages, 0.75) FROM g3) AS INTEGER)
         AS high_risk_county,
       CAST(weather_event_count > 0 AS INTEGER) AS extreme_weather,
       CAST(latest_population > (SELECT quantile_cont(latest_population, 0.75) FROM g3) AS INTEGER)
         AS high_population_density,
       total_historical_outages * total_historical_outages AS outages_squared,
       ln(1 + latest_population) AS population_log, ln(1 + total_property_damage) AS damage_log,
       target
FROM g3"""

F1_DBL = ("avg_customers_affected", "max_customers_ever", "avg_duration_hours", "total_property_damage",
          "avg_magnitude", "total_injuries", "total_deaths", "latest_population", "weather_x_population",
          "damage_per_capita", "customers_per_outage", "severity_score", "population_log", "damage_log")


def daily(spark, sf, **kw):
    return D.daily_features(oraw(spark, sf), wraw(spark, sf), popl(spark, sf), **kw)


@query("f01_daily_features", F1_SQL, dbl=F1_DBL)
def f01(spark, sf):
    return daily(spark, sf)


@query("f01_daily_features_as_of")
def f01b(spark, sf):
    """History features from earlier days only (no look-ahead); rows-only check."""
    return daily(spark, sf, as_of=True)


def warning_inputs(spark, sf):
    return (L.warning_outages(fx.outages_ev(spark, sf)), L.warning_weather(fx.storms_ev(spark, sf)),
            L.population_lookup(fx.population(spark, sf)))


@query("f03_warning_features")
def f03(spark, sf):
    """Early-warning table over all outages (hash-seeded sampling: rows-only check)."""
    o, w, p = warning_inputs(spark, sf)
    return WF.warning_features(o, w, p, seed=42)


@query("b03_positive_labels_hold", """
SELECT county_fips, max(event_began) AS prediction_time, 1 AS window_hours, 1 AS target FROM oev WHERE false GROUP BY county_fips""")
def b03(spark, sf):
    """Invariant: every positive row has an outage in [t, t+w); returns the violations (expect 0 rows)."""
    o, _, _ = warning_inputs(spark, sf)
    pos = B.positives(o, WINDOWS_HOURS, 42)
    return J.without_future_event(pos, o)


@query("b04_negative_labels_hold", """
SELECT county_fips, max(event_began) AS prediction_time, 1 AS window_hours, 0 AS target FROM oev WHERE false GROUP BY county_fips""")
def b04(spark, sf):
    """Invariant: no negative row has an outage in [t, t+w); returns the violations (expect 0 rows)."""
    o, _, _ = warning_inputs(spark, sf)
    neg = WF.candidates(o, WINDOWS_HOURS, 42).filter("target = 0")  # as many as the early-warning table has
    return J.with_future_event(neg, o)


def _daily_split(spark, sf):
    return B.stratified_split(daily(spark, sf), "target", [0.7, 0.15, 0.15], seed=42, key=["county_fips", "date"])


SPLIT_SQL = """
WITH counties AS (SELECT DISTINCT county_fips FROM oraw),
ext AS (SELECT min(date) AS lo, max(date) AS hi FROM oraw),
ndays AS (SELECT datediff('day', lo, hi) + 1 AS nd FROM ext),
od AS (SELECT county_fips, count(DISTINCT date) AS pos FROM oraw GROUP BY county_fips),
cls AS (SELECT 1 AS target, sum(pos) AS n FROM od
        UNION ALL SELECT 0, (SELECT count(*) FROM counties) * (SELECT nd FROM ndays) - (SELECT sum(pos) FROM od)),
b AS (SELECT target, n, round(n * 0.7) AS b1, round(n * 0.85) AS b2 FROM cls)
SELECT target, 'train' AS split, CAST(b1 AS BIGINT) AS n FROM b
UNION ALL SELECT target, 'validation', CAST(b2 - b1 AS BIGINT) FROM b
UNION ALL SELECT target, 'test', CAST(n - b2 AS BIGINT) FROM b"""


@query("b05_stratified_split_counts", SPLIT_SQL)
def b05(spark, sf):
    s = _daily_split(spark, sf)
    return s.groupBy("target", "split").agg(F.count(F.lit(1)).alias("n"))


@query("b06_undersample_counts", """
WITH counties AS (SELECT DISTINCT county_fips FROM oraw),
ext AS (SELECT min(date) AS lo, max(date) AS hi FROM oraw),
nd AS (SELECT datediff('day', lo, hi) + 1 AS nd FROM ext),
pos AS (SELECT count(*) AS p FROM (SELECT DISTINCT county_fips, date FROM oraw)),
tot AS (SELECT (SELECT count(*) FROM counties) * (SELECT nd FROM nd) AS t)
SELECT 1 AS target, (SELECT p FROM pos) AS n
UNION ALL SELECT 0, least((SELECT t FROM tot) - (SELECT p FROM pos), CAST(floor((SELECT p FROM pos) / 0.1) AS BIGINT))""")
def b06(spark, sf):
    u = B.undersample(daily(spark, sf), "target", ratio=0.1, seed=42, key=["county_fips", "date"])
    return u.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("b12_class_weights", """
WITH c AS (SELECT target, count(*) AS n FROM scores GROUP BY target)
SELECT target, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight, n FROM c""", dbl=("weight",))
def b12(spark, sf):
    w = B.class_weights(fx.scores(spark, sf), "target")
    return w.groupBy("target", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("b01_sample_keys")
def b01(spark, sf):
    """100 counties in hash order (reference's county sample, reproducible)."""
    return B.sample_keys(oraw(spark, sf), "county_fips", 100, seed=42)


@query("p19_season_flags_compat", """
SELECT DISTINCT date, CAST(month(date) IN (3, 4, 5) AS INTEGER) AS is_summer, CAST(month(date) IN (9, 10, 11) AS INTEGER) AS is_winter FROM oraw""")
def p19(spark, sf):
    """P19 with ``compat``: the season codes 2 and 4, so the flags mark spring and fall."""
    days = P.season_flags(P.calendar(oraw(spark, sf).select("date").distinct(), "date"), "season", compat=True)
    return days.select("date", "is_summer", "is_winter")
