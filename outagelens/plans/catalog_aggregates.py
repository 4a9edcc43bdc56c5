"""Catalog entries: sources (S) and aggregations (A)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..sources import fixtures as fx
from ..sources import loaders as L
from .registry import query


def o1(spark, sf):
    return L.outages_zero(fx.outages_ev(spark, sf))


def oc1(spark, sf):
    return L.outages_zero(fx.outages_cal(spark, sf))


def s1(spark, sf):
    return L.storms_zero(fx.storms_ev(spark, sf))


def oraw(spark, sf):
    return L.outages_raw(fx.outages_ev(spark, sf))


def wraw(spark, sf):
    return L.weather_raw(fx.storms_ev(spark, sf))


def ocal_flat(spark, sf):
    """Raw calendar outages, flattened (document-store paths: nulls are kept)."""
    raw = fx.outages_cal(spark, sf)
    return raw.select(
        F.col("location.county_fips").alias("county_fips"),
        F.col("location.county_name").alias("county_name"),
        F.col("location.state").alias("state"),
        "start_time", "event_began", "event_type", "max_customers", "duration_hours",
    )


def popl(spark, sf):
    return L.population_lookup(fx.population(spark, sf))


# ---------------------------------------------------------------- sources
@query("s01_outages_view", """
SELECT * FROM o1""")
def s01(spark, sf):
    return o1(spark, sf)


@query("s02_storms_view", """
SELECT * FROM s1""")
def s02(spark, sf):
    return s1(spark, sf)


@query("s03_outages_raw", """
SELECT * FROM oraw""")
def s03o(spark, sf):
    return oraw(spark, sf)


@query("s03_weather_raw", """
SELECT * FROM wraw""")
def s03w(spark, sf):
    return wraw(spark, sf)


@query("s04_warning_outages", """
SELECT event_began AS event_time, county_fips, county_name, state,
       coalesce(max_customers, 0.0) AS max_customers, coalesce(duration_hours, 0.0) AS duration_hours
FROM oev WHERE event_began IS NOT NULL AND county_fips IS NOT NULL""")
def s04o(spark, sf):
    return L.warning_outages(fx.outages_ev(spark, sf))


@query("s04_warning_weather", """
SELECT begin_date AS event_time, county_fips, coalesce(damage_property, 0.0) AS damage_property,
       coalesce(magnitude, 0.0) AS magnitude
FROM sev WHERE begin_date IS NOT NULL AND county_fips IS NOT NULL""")
def s04w(spark, sf):
    return L.warning_weather(fx.storms_ev(spark, sf))


@query("s05_population_lookup", """
SELECT * FROM popl""")
def s05(spark, sf):
    return popl(spark, sf)


@query("s06_generators", """
SELECT state, county, nameplate_capacity_mw, age_years FROM gens""", dbl=("age_years",))
def s06(spark, sf):
    return L.generators_load(fx.generators(spark, sf))


# ---------------------------------------------------------------- aggregates
@query("a01_by_county", """
SELECT county_fips, arg_min(county_name, start_time) AS county_name, arg_min(state, start_time) AS state,
       count(*) AS outage_count
FROM o1 GROUP BY county_fips""")
def a01(spark, sf):
    return A.by_county(o1(spark, sf))


@query("a02_by_county_year", """
SELECT county_fips, arg_min(county_name, start_time) AS county_name, arg_min(state, start_time) AS state,
       count(*) AS outage_count
FROM oc1 WHERE start_time >= TIMESTAMP '1998-01-01' AND start_time < TIMESTAMP '1999-01-01'
GROUP BY county_fips""")
def a02(spark, sf):
    return A.by_county(oc1(spark, sf), year=1998)


@query("a03_hotspots", """
SELECT county_fips, arg_min(county_name, start_time) AS county_name, arg_min(state, start_time) AS state,
       count(*) AS outage_count, round(sum(max_customers * duration_hours)) AS customer_hours,
       round(avg(duration_hours), 2) AS avg_duration_hours
FROM o1 GROUP BY county_fips ORDER BY customer_hours DESC, county_fips""")
def a03(spark, sf):
    return A.hotspots(o1(spark, sf))


@query("a05_seasonal", """
WITH bm AS (SELECT state, CAST(month(start_time) AS INTEGER) AS month, count(*) AS outages
            FROM oc1 WHERE state <> '' GROUP BY 1, 2),
     top AS (SELECT state FROM bm GROUP BY state ORDER BY sum(outages) DESC, state LIMIT 15)
SELECT * FROM bm WHERE state IN (SELECT state FROM top)""")
def a05(spark, sf):
    return A.seasonal(oc1(spark, sf), top=15)


@query("a06_by_event_type", """
SELECT event_type, count(*) AS count, avg(max_customers) AS avg_customers, avg(duration_hours) AS avg_duration
FROM ocal GROUP BY event_type ORDER BY count DESC, event_type NULLS FIRST LIMIT 15""",
       dbl=("avg_customers", "avg_duration"))
def a06(spark, sf):
    return A.by_event_type(ocal_flat(spark, sf), top=15)


@query("a07_by_region", """
WITH ps AS (SELECT state, count(*) AS n, count(max_customers) AS nc, sum(max_customers) AS sc FROM ocal GROUP BY state)
SELECT region, CAST(coalesce(sum(n), 0) AS BIGINT) AS outage_count,
       coalesce(sum(sc) / nullif(sum(nc), 0), 0.0) AS avg_customers_affected,
       coalesce(sum(sc), 0.0) AS total_customers_affected
FROM regions LEFT JOIN ps USING (state) GROUP BY region""",
       dbl=("avg_customers_affected", "total_customers_affected:2"))
def a07(spark, sf):
    return A.by_region(ocal_flat(spark, sf), fx.region_dim(spark, sf))


@query("a08_compare_states", """
SELECT state, count(*) AS outage_count, avg(max_customers) AS avg_customers, avg(duration_hours) AS avg_duration
FROM ocal WHERE state IN ('NATION_1', 'NATION_2') GROUP BY state""", dbl=("avg_customers", "avg_duration"))
def a08(spark, sf):
    return A.compare_states(ocal_flat(spark, sf), "NATION_1", "NATION_2")


@query("a09_compare_years", """
WITH y AS (
  SELECT count(*) FILTER (WHERE event_began >= TIMESTAMP '1996-01-01' AND event_began < TIMESTAMP '1997-01-01') AS outages_1,
         count(*) FILTER (WHERE event_began >= TIMESTAMP '1997-01-01' AND event_began < TIMESTAMP '1998-01-01') AS outages_2,
         coalesce(sum(max_customers) FILTER (WHERE event_began >= TIMESTAMP '1996-01-01' AND event_began < TIMESTAMP '1997-01-01'), 0.0) AS customers_1,
         coalesce(sum(max_customers) FILTER (WHERE event_began >= TIMESTAMP '1997-01-01' AND event_began < TIMESTAMP '1998-01-01'), 0.0) AS customers_2
  FROM ocal WHERE event_began >= TIMESTAMP '1996-01-01' AND event_began < TIMESTAMP '1998-01-01')
SELECT 1996 AS year_1, 1997 AS year_2, outages_1, outages_2, customers_1, customers_2,
       CASE WHEN outages_1 > 0 THEN (CAST(outages_2 AS DOUBLE) - outages_1) / outages_1 * 100.0 END AS outages_change_pct,
       CASE WHEN customers_1 > 0 THEN (customers_2 - customers_1) / customers_1 * 100.0 END AS customers_change_pct
FROM y""", dbl=("customers_1:2", "customers_2:2", "outages_change_pct", "customers_change_pct"))
def a09(spark, sf):
    return A.compare_years(ocal_flat(spark, sf), 1996, 1997)


@query("a10_monthly_trend", """
SELECT strftime(event_began, '%Y-%m') AS month, state, count(*) AS count
FROM ocal WHERE state IN ('NATION_1', 'NATION_2') AND event_began IS NOT NULL GROUP BY 1, 2""")
def a10(spark, sf):
    return A.monthly_trend(ocal_flat(spark, sf), ["NATION_1", "NATION_2"])


@query("a11_month_of_year", """
SELECT CAST(year(event_began) AS INTEGER) AS year, CAST(month(event_began) AS INTEGER) AS month, count(*) AS count
FROM ocal WHERE (event_began >= TIMESTAMP '1996-01-01' AND event_began < TIMESTAMP '1997-01-01')
             OR (event_began >= TIMESTAMP '1997-01-01' AND event_began < TIMESTAMP '1998-01-01')
GROUP BY 1, 2""")
def a11(spark, sf):
    return A.month_of_year(ocal_flat(spark, sf), [1996, 1997])


@query("a12_top_event_types", """
WITH c AS (SELECT state, event_type, count(*) AS count FROM oev WHERE event_type IS NOT NULL GROUP BY 1, 2),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY state ORDER BY count DESC, event_type) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 5""")
def a12(spark, sf):
    raw = fx.outages_ev(spark, sf).select(F.col("location.state").alias("state"), "event_type")
    return A.top_event_types(raw, k=5)


def _oprof(spark, sf):
    return A.county_outage_profile(oraw(spark, sf))


def _wprof(spark, sf):
    return A.county_weather_profile(wraw(spark, sf))


OPROF_SQL = """SELECT county_fips, count(*) AS outage_count, avg(max_customers) AS avg_customers,
       max(max_customers) AS max_customers, avg(duration_hours) AS avg_duration, sum(max_customers) AS total_customers
FROM oraw WHERE max_customers IS NOT NULL GROUP BY county_fips"""
WPROF_SQL = """SELECT county_fips, count(*) AS weather_event_count, avg(damage_property) AS avg_damage,
       coalesce(sum(injuries), 0.0) AS total_injuries, coalesce(sum(deaths), 0.0) AS total_deaths
FROM wraw GROUP BY county_fips"""
PROFILE_SQL = f"""
WITH op AS ({OPROF_SQL}), wp AS ({WPROF_SQL}),
prof AS (
  SELECT op.*, coalesce(wp.weather_event_count, 0) AS weather_event_count, coalesce(wp.avg_damage, 0.0) AS avg_damage,
         coalesce(wp.total_injuries, 0.0) AS total_injuries, coalesce(wp.total_deaths, 0.0) AS total_deaths,
         coalesce(popl.latest_population, 0.0) AS latest_population
  FROM op LEFT JOIN wp USING (county_fips) LEFT JOIN popl USING (county_fips))"""
CORR_FEATURES = ["avg_customers", "avg_duration", "weather_event_count", "avg_damage",
                 "total_injuries", "total_deaths", "latest_population"]


def _profile(spark, sf):
    return A.county_profile(_oprof(spark, sf), _wprof(spark, sf), popl(spark, sf))


@query("a13_county_outage_profile", OPROF_SQL,
       dbl=("avg_customers", "max_customers", "avg_duration", "total_customers"))
def a13(spark, sf):
    return _oprof(spark, sf)


@query("a14_county_weather_profile", WPROF_SQL, dbl=("avg_damage", "total_injuries", "total_deaths"))
def a14(spark, sf):
    return _wprof(spark, sf)


@query("j10_county_profile", PROFILE_SQL + "\nSELECT * FROM prof",
       dbl=("avg_customers", "max_customers", "avg_duration", "total_customers", "avg_damage"))
def j10(spark, sf):
    return _profile(spark, sf)


_corr_sql = "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, abs(covar_pop(CAST({f} AS DOUBLE), CAST(outage_count AS DOUBLE)) / "
    f"nullif(stddev_pop(CAST({f} AS DOUBLE)) * stddev_pop(CAST(outage_count AS DOUBLE)), 0)) AS correlation FROM prof"
    for f in CORR_FEATURES)


@query("a15_abs_correlations", PROFILE_SQL + f"""
SELECT * FROM ({_corr_sql}) WHERE correlation IS NOT NULL AND NOT isnan(correlation)
ORDER BY correlation DESC, feature""", dbl=("correlation",))
def a15(spark, sf):
    return A.abs_correlations(_profile(spark, sf), "outage_count", CORR_FEATURES)


@query("a16_county_history", """
SELECT county_fips, avg(max_customers) AS avg_customers_affected, max(max_customers) AS max_customers_ever,
       avg(duration_hours) AS avg_duration_hours, count(event_began) AS total_historical_outages
FROM oraw GROUP BY county_fips""", dbl=("avg_customers_affected", "max_customers_ever", "avg_duration_hours"))
def a16(spark, sf):
    return A.county_history(oraw(spark, sf))


@query("a17_weather_by_day", """
SELECT county_fips, date, count(event_type) AS weather_event_count,
       coalesce(sum(damage_property), 0.0) AS total_property_damage, avg(magnitude) AS avg_magnitude,
       coalesce(sum(injuries), 0.0) AS total_injuries, coalesce(sum(deaths), 0.0) AS total_deaths
FROM wraw GROUP BY county_fips, date""", dbl=("total_property_damage", "avg_magnitude", "total_injuries"))
def a17(spark, sf):
    return A.weather_by_day(wraw(spark, sf))


@query("a18_generators_by_county", """
SELECT state, county AS county_name, coalesce(sum(nameplate_capacity_mw), 0.0) AS total_capacity_mw,
       avg(age_years) AS avg_generator_age
FROM gens GROUP BY state, county""", dbl=("total_capacity_mw", "avg_generator_age"))
def a18(spark, sf):
    return A.generators_by_county(fx.generators(spark, sf))


@query("a19_outage_days", """
SELECT DISTINCT county_fips, date, 1 AS target FROM oraw""")
def a19(spark, sf):
    return A.outage_days(oraw(spark, sf))


@query("a20_extent", """
SELECT min(date) AS min_date, max(date) AS max_date, count(DISTINCT county_fips) AS n_counties FROM oraw""")
def a20(spark, sf):
    return A.extent(oraw(spark, sf))


@query("a21_high_population_flag", """
SELECT county_fips, latest_population,
       CAST(latest_population > (SELECT quantile_cont(latest_population, 0.75) FROM popl) AS INTEGER)
         AS high_population_density
FROM popl""")
def a21(spark, sf):
    return A.flag_above_quantile(popl(spark, sf), "latest_population", "high_population_density", 0.75)


@query("a22_impute_median", """
WITH c AS (SELECT DISTINCT county_fips FROM ocal),
     j AS (SELECT c.county_fips, popl.latest_population FROM c LEFT JOIN popl USING (county_fips))
SELECT county_fips, coalesce(latest_population, (SELECT median(latest_population) FROM j)) AS latest_population
FROM j""", dbl=("latest_population",))
def a22(spark, sf):
    counties = ocal_flat(spark, sf).select("county_fips").distinct()
    return A.impute_median(counties.join(popl(spark, sf), "county_fips", "left"), "latest_population")


@query("a23_class_balance", """
WITH c AS (SELECT target, count(*) AS n FROM scores GROUP BY target)
SELECT target, n, n / sum(n) OVER () AS share, max(n) OVER () / min(n) OVER () AS imbalance_ratio FROM c""",
       dbl=("share", "imbalance_ratio"))
def a23(spark, sf):
    return A.class_balance(fx.scores(spark, sf))


STAT_COLS = ["outage_count", "avg_customers", "avg_duration", "weather_event_count", "avg_damage", "latest_population"]
_stats_sql = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std, "
    f"min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max FROM prof" for c in STAT_COLS)


@query("a24_feature_stats", PROFILE_SQL + "\n" + _stats_sql, dbl=("mean", "std", "min", "max"))
def a24(spark, sf):
    return A.feature_stats(_profile(spark, sf), STAT_COLS)


@query("a25_score_profile", """
SELECT min(p) AS p_min, quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.5) AS p50, quantile_cont(p, 0.75) AS p75,
       max(p) AS p_max, count(*) FILTER (WHERE p > 0.5) AS n_above_50, avg(CAST(p > 0.5 AS DOUBLE)) AS share_above_50,
       count(*) FILTER (WHERE p > 0.7) AS n_above_70, avg(CAST(p > 0.7 AS DOUBLE)) AS share_above_70,
       CAST(sum(target) AS BIGINT) AS positives
FROM scores""", dbl=("p_min", "p25", "p50", "p75", "p_max", "share_above_50", "share_above_70"))
def a25(spark, sf):
    return A.score_profile(fx.scores(spark, sf))


PERIOD = ("NATION_3", dt.datetime(1996, 2, 1), dt.datetime(1996, 3, 1))
PERIOD_SQL = """SELECT * REPLACE (coalesce(county_name, 'Unknown') AS county_name,
                   coalesce(max_customers, 0.0) AS max_customers, coalesce(duration_hours, 0.0) AS duration_hours)
FROM ocal WHERE state = 'NATION_3'
  AND start_time >= TIMESTAMP '1996-02-01' AND start_time < TIMESTAMP '1996-03-01'"""


@query("a26_period_kpis", f"""
WITH p AS ({PERIOD_SQL})
SELECT count(*) AS outage_events, count(DISTINCT county_name) AS counties_affected, max(max_customers) AS peak_customers
FROM p""", dbl=("peak_customers",))
def a26k(spark, sf):
    return A.period_kpis(A.state_period(ocal_flat(spark, sf), *PERIOD))


@query("a26_period_top_counties", f"""
WITH p AS ({PERIOD_SQL})
SELECT county_name, sum(max_customers) AS max_customers FROM p GROUP BY county_name
ORDER BY max_customers DESC, county_name LIMIT 15""", dbl=("max_customers",))
def a26t(spark, sf):
    return A.period_top_counties(A.state_period(ocal_flat(spark, sf), *PERIOD), 15)


@query("a27_map_kpis", """
WITH b AS (SELECT county_fips, count(*) AS outage_count FROM o1 GROUP BY county_fips)
SELECT count(*) AS counties, CAST(coalesce(sum(outage_count), 0) AS BIGINT) AS total_outages,
       coalesce(max(outage_count), 0) AS max_in_one_county FROM b""")
def a27(spark, sf):
    return A.map_kpis(A.by_county(o1(spark, sf)))


@query("a29_score_histogram", """
SELECT target, CAST(least(floor(p * 50) + 1, 50) AS BIGINT) AS bucket, count(*) AS n FROM scores GROUP BY 1, 2""")
def a29(spark, sf):
    return A.score_histogram(fx.scores(spark, sf))


@query("a31_states", """
SELECT DISTINCT state FROM ocal WHERE state IS NOT NULL AND state <> '' ORDER BY state""")
def a31(spark, sf):
    return A.states(ocal_flat(spark, sf))


# -- the SQL view path and documented options ----------------------------------------------------
@query("s01_sql_over_views", """
SELECT o.state, o.outages, o.customers, coalesce(s.storms, 0) AS storms
FROM (SELECT state, count(*) AS outages, sum(max_customers) AS customers FROM o1 GROUP BY state) o
LEFT JOIN (SELECT state, count(*) AS storms FROM s1 GROUP BY state) s USING (state)""", dbl=("customers:2",))
def s01_sql(spark, sf):
    """A user's SQL over the registered views ``outages`` and ``storms``."""
    L.register_views(spark, fx.outages_ev(spark, sf), fx.storms_ev(spark, sf))
    return spark.sql("""
        SELECT o.state, o.outages, o.customers, coalesce(s.storms, 0) AS storms
        FROM (SELECT state, count(*) AS outages, sum(max_customers) AS customers FROM outages GROUP BY state) o
        LEFT JOIN (SELECT state, count(*) AS storms FROM storms GROUP BY state) s USING (state)""")


_STATE_OF = {f"NATION_{i}": s for i, s in enumerate(s for states in A.REGION_STATES.values() for s in states[:3])}
# the other ten nations; the fourth Southwest state stands for two of them
_EVERY_STATE_OF = _STATE_OF | {f"NATION_{15 + i}": s for i, s in enumerate(s for states in A.REGION_STATES.values() for s in (*states, states[-1])[3:5])}


@query("a07_by_default_region", "WITH m(state, region) AS (VALUES " + ", ".join(
    f"('{n}', '{next(r for r, states in A.REGION_STATES.items() if s in states)}')" for n, s in _EVERY_STATE_OF.items()) + """),
ps AS (SELECT region, count(*) AS n, count(max_customers) AS nc, sum(max_customers) AS sc FROM ocal JOIN m USING (state) GROUP BY region),
r(region) AS (VALUES ('Northeast'), ('Southeast'), ('Midwest'), ('Southwest'), ('West'))
SELECT region, CAST(coalesce(n, 0) AS BIGINT) AS outage_count, coalesce(sc / nullif(nc, 0), 0.0) AS avg_customers_affected,
       coalesce(sc, 0.0) AS total_customers_affected
FROM r LEFT JOIN ps USING (region)""", dbl=("avg_customers_affected", "total_customers_affected:2"))
def a07_default(spark, sf):
    """The shipped five-region dimension; the 25 fixture nations stand for five states of each region."""
    named = F.create_map(*[F.lit(x) for pair in _EVERY_STATE_OF.items() for x in pair])
    return A.by_region(ocal_flat(spark, sf).withColumn("state", F.element_at(named, F.col("state"))))


@query("a26_period_kpis_closed_end", f"""
WITH p AS ({PERIOD_SQL.replace("start_time <", "start_time <=")})
SELECT count(*) AS outage_events, count(DISTINCT county_name) AS counties_affected, max(max_customers) AS peak_customers
FROM p""", dbl=("peak_customers",))
def a26_closed(spark, sf):
    """P3 with ``compat_bounds``: the end is included."""
    return A.period_kpis(A.state_period(ocal_flat(spark, sf), *PERIOD, compat_bounds=True))


@query("a18_generators_by_name", """
SELECT county AS county_name, coalesce(sum(nameplate_capacity_mw), 0.0) AS total_capacity_mw, avg(age_years) AS avg_generator_age
FROM gens GROUP BY county""", dbl=("total_capacity_mw", "avg_generator_age"))
def a18_name(spark, sf):
    """A18 with the name-only key."""
    return A.generators_by_county(fx.generators(spark, sf), keys=("county",))
