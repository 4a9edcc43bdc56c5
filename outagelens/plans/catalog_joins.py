"""Catalog entries: joins (J) and per-key windows (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import WINDOWS_HOURS
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..sources import fixtures as fx
from ..sources import loaders as L
from .registry import query
from .catalog_aggregates import o1, s1


@query("j01_storm_pairs", """
SELECT s.storm_event_type, o.county_fips, o.start_time, s.storm_time
FROM o1 o JOIN s1 s ON o.county_fips = s.county_fips
 AND s.storm_time <= o.start_time AND s.storm_time >= o.start_time - INTERVAL 7 DAYS""")
def j01(spark, sf):
    return J.storm_pairs(o1(spark, sf), s1(spark, sf), days=7)


@query("j01_storm_ranges", """
SELECT s.county_fips, s.storm_time, s.storm_event_type,
  (SELECT count(*) FROM o1 o WHERE o.county_fips = s.county_fips AND o.start_time < s.storm_time) AS first_rank,
  (SELECT count(*) FROM o1 o WHERE o.county_fips = s.county_fips AND o.start_time <= s.storm_time + INTERVAL 7 DAYS) AS last_rank
FROM s1 s""")
def j01r(spark, sf):
    """J1 without its pairs: each storm with the range of its county's outages, in time order."""
    return J.storm_ranges(o1(spark, sf), s1(spark, sf), days=7).select("county_fips", "storm_time", "storm_event_type", "first_rank", "last_rank")


@query("j01_storm_pairs_of_ranges", """
SELECT s.storm_event_type, o.county_fips, o.start_time, s.storm_time
FROM o1 o JOIN s1 s ON o.county_fips = s.county_fips
 AND s.storm_time <= o.start_time AND s.storm_time >= o.start_time - INTERVAL 7 DAYS""")
def j01x(spark, sf):
    """J1's pairs, expanded from the rank ranges."""
    o, s = o1(spark, sf), s1(spark, sf)
    return J.expand_ranges(J.storm_ranges(o, s, days=7), J.outage_ranks(o))


@query("a04_storm_lift", """
WITH p AS (
  SELECT s.storm_event_type, o.county_fips FROM o1 o JOIN s1 s ON o.county_fips = s.county_fips
   AND s.storm_time <= o.start_time AND s.storm_time >= o.start_time - INTERVAL 7 DAYS)
SELECT storm_event_type, count(*) AS pairings, count(DISTINCT county_fips) AS counties_seen
FROM p GROUP BY storm_event_type ORDER BY pairings DESC, storm_event_type""")
def a04(spark, sf):
    return J.storm_lift(o1(spark, sf), s1(spark, sf), days=7)


def _probe_cands(spark, sf):
    """Deterministic probe points: every 'signup'/'purchase' event, as (county, time, window)."""
    ev = fx.table(spark, sf, "events").filter(F.col("event_type").isin("signup", "purchase"))
    windows = F.array(*[F.lit(w) for w in WINDOWS_HOURS])
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        "event_id",
        F.when(F.length(F.col("user_id").cast("string")) < 5,
               F.lpad(F.col("user_id").cast("string"), 5, "0")).otherwise(F.col("user_id").cast("string"))
        .alias("county_fips"),
        F.col("ts").cast("timestamp").alias("prediction_time"),
        F.element_at(windows, k % 5 + 1).alias("window_hours"),
    )


PROBE_SQL = """cands AS (
  SELECT event_id, lpad(CAST(user_id AS VARCHAR), 5, '0') AS county_fips, ts AS prediction_time,
         CAST([1, 3, 6, 12, 24][k % 5 + 1] AS INTEGER) AS window_hours
  FROM ev WHERE event_type IN ('signup', 'purchase')),
wo AS (SELECT event_began AS event_time, county_fips, coalesce(max_customers, 0.0) AS max_customers,
              coalesce(duration_hours, 0.0) AS duration_hours FROM oev WHERE event_began IS NOT NULL),
ww AS (SELECT begin_date AS event_time, county_fips, coalesce(damage_property, 0.0) AS damage_property,
              coalesce(magnitude, 0.0) AS magnitude FROM sev WHERE begin_date IS NOT NULL)"""


@query("j07_without_future_event", f"""
WITH {PROBE_SQL}
SELECT * FROM cands c WHERE NOT EXISTS (
  SELECT 1 FROM wo WHERE wo.county_fips = c.county_fips AND wo.event_time >= c.prediction_time
   AND wo.event_time < c.prediction_time + to_hours(c.window_hours))""")
def j07(spark, sf):
    return J.without_future_event(_probe_cands(spark, sf), L.warning_outages(fx.outages_ev(spark, sf)))


@query("j07_with_future_event", f"""
WITH {PROBE_SQL}
SELECT * FROM cands c WHERE EXISTS (
  SELECT 1 FROM wo WHERE wo.county_fips = c.county_fips AND wo.event_time >= c.prediction_time
   AND wo.event_time < c.prediction_time + to_hours(c.window_hours))""")
def j07b(spark, sf):
    return J.with_future_event(_probe_cands(spark, sf), L.warning_outages(fx.outages_ev(spark, sf)))


def _trail_ctes():
    """``fo`` / ``fw``: per probe (event_id), the trailing outage / weather aggregates."""
    o = ", ".join([
        "count(o.event_time) FILTER (WHERE o.event_time >= c.prediction_time - INTERVAL 24 HOURS) AS recent_outage_count_24h",
        "count(o.event_time) FILTER (WHERE o.event_time >= c.prediction_time - INTERVAL 72 HOURS) AS recent_outage_count_72h",
        "count(o.event_time) AS recent_outage_count_168h",
        "coalesce(sum(o.max_customers) FILTER (WHERE o.event_time >= c.prediction_time - INTERVAL 24 HOURS), 0.0) AS recent_customers_affected_24h",
        "coalesce(sum(o.max_customers) FILTER (WHERE o.event_time >= c.prediction_time - INTERVAL 72 HOURS), 0.0) AS recent_customers_affected_72h",
        "coalesce(avg(o.duration_hours), 0.0) AS recent_duration_mean_168h",
    ])
    w = ", ".join([
        "count(w.event_time) FILTER (WHERE w.event_time >= c.prediction_time - INTERVAL 24 HOURS) AS weather_event_count_24h",
        "count(w.event_time) FILTER (WHERE w.event_time >= c.prediction_time - INTERVAL 72 HOURS) AS weather_event_count_72h",
        "count(w.event_time) AS weather_event_count_168h",
        "coalesce(sum(w.damage_property) FILTER (WHERE w.event_time >= c.prediction_time - INTERVAL 72 HOURS), 0.0) AS total_property_damage_72h",
        "coalesce(avg(w.magnitude) FILTER (WHERE w.event_time >= c.prediction_time - INTERVAL 72 HOURS), 0.0) AS avg_weather_magnitude_72h",
    ])
    return f"""fo AS (SELECT c.event_id, {o} FROM cands c LEFT JOIN wo o ON o.county_fips = c.county_fips
        AND o.event_time >= c.prediction_time - INTERVAL 168 HOURS AND o.event_time < c.prediction_time
       GROUP BY c.event_id),
fw AS (SELECT c.event_id, {w} FROM cands c LEFT JOIN ww w ON w.county_fips = c.county_fips
        AND w.event_time >= c.prediction_time - INTERVAL 168 HOURS AND w.event_time < c.prediction_time
       GROUP BY c.event_id)"""


def _trail_sql():
    return f"""
WITH {PROBE_SQL},
{_trail_ctes()}
SELECT cands.*, fo.* EXCLUDE (event_id), fw.* EXCLUDE (event_id)
FROM cands JOIN fo USING (event_id) JOIN fw USING (event_id)"""


TRAIL_DBL = ("recent_customers_affected_24h", "recent_customers_affected_72h", "recent_duration_mean_168h",
             "total_property_damage_72h", "avg_weather_magnitude_72h")


def trailing_features(cands, outages, weather, chunk_hours=None):
    return W.trailing_multi(cands, [(outages, W.WARNING_OUTAGE_TRAILS), (weather, W.WARNING_WEATHER_TRAILS)],
                            chunk_hours=chunk_hours)


@query("w05_trailing", _trail_sql(), dbl=TRAIL_DBL)
def w05(spark, sf):
    return trailing_features(_probe_cands(spark, sf), L.warning_outages(fx.outages_ev(spark, sf)),
                             L.warning_weather(fx.storms_ev(spark, sf)))


@query("w05_trailing_small_chunks", _trail_sql(), dbl=TRAIL_DBL)
def w05s(spark, sf):
    """Same frames with 24-hour chunks (7 halo copies per event): hot-key layout."""
    return trailing_features(_probe_cands(spark, sf), L.warning_outages(fx.outages_ev(spark, sf)),
                             L.warning_weather(fx.storms_ev(spark, sf)), chunk_hours=24)


@query("j09_county_lookup", """
SELECT county_fips, arg_min(county_name, event_began) AS county_name, arg_min(state, event_began) AS state
FROM oev WHERE event_began IS NOT NULL GROUP BY county_fips""")
def j09(spark, sf):
    return J.county_lookup(L.warning_outages(fx.outages_ev(spark, sf)))


@query("j13_explode_windows", """
SELECT o1.*, CAST(w AS INTEGER) AS window_hours FROM o1, unnest([1, 3, 6, 12, 24]) AS t(w)""")
def j13(spark, sf):
    return J.explode_windows(o1(spark, sf))


LATEST_SQL = """latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY county_fips, window_hours
                                 ORDER BY prediction_time DESC NULLS LAST, outage_probability DESC) AS rn
    FROM pev) WHERE rn = 1)"""


@query("w01_latest_per_key", f"WITH {LATEST_SQL} SELECT * FROM latest")
def w01(spark, sf):
    return W.latest_per_key(fx.predictions_ev(spark, sf))


@query("w02_latest_match", """
SELECT * FROM pev WHERE state = 'NATION_19' AND county_name = 'Customer#000000001' AND window_hours = 24
ORDER BY prediction_time DESC NULLS LAST, outage_probability DESC LIMIT 1""")
def w02(spark, sf):
    return W.latest_match(fx.predictions_ev(spark, sf), "NATION_19", "Customer#000000001", 24)


@query("w03_latest_batch", """
SELECT * FROM pev WHERE prediction_time = (SELECT max(prediction_time) FROM pev)""")
def w03(spark, sf):
    return W.latest_batch(fx.predictions_ev(spark, sf))


@query("w06_top_counties", """
WITH b AS (SELECT county_fips, arg_min(county_name, start_time) AS county_name, arg_min(state, start_time) AS state,
                  count(*) AS outage_count FROM o1 GROUP BY county_fips)
SELECT *, CAST(row_number() OVER (ORDER BY outage_count DESC, county_fips) AS INTEGER) AS rank
FROM b ORDER BY outage_count DESC, county_fips LIMIT 10""")
def w06(spark, sf):
    return W.top_counties(A.by_county(o1(spark, sf)), k=10)


@query("w08_risk_trend", f"""
WITH {LATEST_SQL},
top AS (SELECT county_fips FROM latest WHERE window_hours = 24
        ORDER BY outage_probability DESC, county_fips LIMIT 5)
SELECT pev.*, coalesce(county_name, county_fips) AS label FROM pev
WHERE window_hours = 24 AND county_fips IN (SELECT county_fips FROM top)""")
def w08(spark, sf):
    preds = fx.predictions_ev(spark, sf)
    return W.risk_trend(preds, W.latest_per_key(preds), 24, k=5)


@query("a30_warning_kpis", f"""
WITH {LATEST_SQL},
f AS (SELECT * FROM latest WHERE window_hours = 24)
SELECT count(*) AS counties_monitored, count(*) FILTER (WHERE coalesce(outage_probability, 0.0) >= 0.8) AS active_warnings,
       coalesce(max(coalesce(outage_probability, 0.0)), 0.0) AS max_probability, max(prediction_time) AS latest_time,
       coalesce(min(model_used), 'Existing ML model') AS model_name FROM f""")
def a30(spark, sf):
    return A.warning_kpis(W.latest_per_key(fx.predictions_ev(spark, sf)), 0.8, window_hours=24)


@query("j06_county_day_grid", """
WITH counties AS (SELECT DISTINCT county_fips FROM oraw),
ext AS (SELECT min(date) AS lo, max(date) AS hi FROM oraw)
SELECT county_fips, CAST(d AS DATE) AS date FROM counties, ext,
       generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(d)""")
def j06(spark, sf):
    from .catalog_aggregates import oraw
    from .daily_features import county_day_grid

    o = oraw(spark, sf)
    return county_day_grid(o.select("county_fips").distinct(), o.agg(F.min("date")).scalar(),
                           o.agg(F.max("date")).scalar())


@query("j11_predictions_with_truth", """
WITH p AS (SELECT county_fips, CAST(prediction_time AS DATE) AS date, max(outage_probability) AS outage_probability
           FROM pev GROUP BY 1, 2),
t AS (SELECT DISTINCT county_fips, date, 1 AS target FROM oraw)
SELECT p.county_fips, p.date, p.outage_probability, t.target FROM p JOIN t USING (county_fips, date)""")
def j11(spark, sf):
    from .catalog_aggregates import oraw

    preds = (fx.predictions_ev(spark, sf).groupBy("county_fips", F.to_date("prediction_time").alias("date"))
             .agg(F.max("outage_probability").alias("outage_probability")))
    return J.predictions_with_truth(preds, A.outage_days(oraw(spark, sf)))


@query("f03_features_on_probes", f"""
WITH {PROBE_SQL},
lk AS (SELECT county_fips, arg_min(county_name, event_began) AS county_name, arg_min(state, event_began) AS state
       FROM oev WHERE event_began IS NOT NULL GROUP BY county_fips),
{_trail_ctes()},
lab AS (SELECT c.event_id, CASE WHEN EXISTS (
          SELECT 1 FROM wo WHERE wo.county_fips = c.county_fips AND wo.event_time >= c.prediction_time
           AND wo.event_time < c.prediction_time + to_hours(c.window_hours)) THEN 1 ELSE 0 END AS target FROM cands c)
SELECT c.county_fips, lk.county_name, lk.state, c.prediction_time, c.window_hours,
       CAST(hour(c.prediction_time) AS INTEGER) AS hour, CAST(isodow(c.prediction_time) - 1 AS INTEGER) AS day_of_week,
       CAST(month(c.prediction_time) AS INTEGER) AS month, CAST(isodow(c.prediction_time) >= 6 AS INTEGER) AS is_weekend,
       fo.* EXCLUDE (event_id), fw.* EXCLUDE (event_id),
       coalesce(popl.latest_population, 0.0) AS latest_population, lab.target
FROM cands c JOIN fo USING (event_id) JOIN fw USING (event_id) JOIN lab USING (event_id)
LEFT JOIN lk ON lk.county_fips = c.county_fips LEFT JOIN popl ON popl.county_fips = c.county_fips""", dbl=TRAIL_DBL)
def f03p(spark, sf):
    """F3 feature assembly on deterministic probe rows, labelled by the next-window rule."""
    from .warning_features import META, WARNING_FEATURES, features_for

    o = L.warning_outages(fx.outages_ev(spark, sf))
    w = L.warning_weather(fx.storms_ev(spark, sf))
    p = L.population_lookup(fx.population(spark, sf))
    probes = _probe_cands(spark, sf)
    pos = J.with_future_event(probes, o).withColumn("target", F.lit(1))
    neg = J.without_future_event(probes, o).withColumn("target", F.lit(0))
    return features_for(pos.unionByName(neg).drop("event_id"), o, w, p).select(*META, *WARNING_FEATURES, "target")


@query("j01_storm_pairs_fine_buckets", """
SELECT s.storm_event_type, o.county_fips, o.start_time, s.storm_time
FROM o1 o JOIN s1 s ON o.county_fips = s.county_fips
 AND s.storm_time <= o.start_time AND s.storm_time >= o.start_time - INTERVAL 7 DAYS""")
def j01f(spark, sf):
    """J1 with 6-hour buckets (storms copied to 29 buckets): the layout for a hot county-week."""
    return J.storm_pairs(o1(spark, sf), s1(spark, sf), days=7, bucket_hours=6)


@query("j07_without_future_event_fine_buckets", f"""
WITH {PROBE_SQL}
SELECT * FROM cands c WHERE NOT EXISTS (
  SELECT 1 FROM wo WHERE wo.county_fips = c.county_fips AND wo.event_time >= c.prediction_time
   AND wo.event_time < c.prediction_time + to_hours(c.window_hours))""")
def j07f(spark, sf):
    """J7 with 1-hour buckets (events copied to 24-25 buckets)."""
    return J.without_future_event(_probe_cands(spark, sf), L.warning_outages(fx.outages_ev(spark, sf)), bucket_hours=1)
