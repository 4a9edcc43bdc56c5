"""Catalog entries: sinks and snapshots (S7-S15), alerts and risk scales."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import columns as P
from ..operators import aggregates as A
from ..operators import alerts as AL
from ..operators import windows as W
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import sinks as S
from .registry import query
from .catalog_aggregates import o1, oraw
from .catalog_joins import LATEST_SQL

_NOW = dt.datetime(2030, 1, 1)


@query("s10_replace_roundtrip", "SELECT * FROM o1")
def s10(spark, sf):
    path = scratch_path(spark, "s10_outages")
    S.replace_table(o1(spark, sf), path)
    S.replace_table(o1(spark, sf), path)  # replacing twice leaves one copy
    return S.read_table(spark, path)


@query("s11_keyed_replace", """
SELECT * EXCLUDE (model_version), 'fixture_v1' AS model_version FROM pev WHERE window_hours = 1
UNION ALL SELECT * EXCLUDE (model_version), 'fixture_v2' AS model_version FROM pev WHERE window_hours = 24""")
def s11(spark, sf):
    path = scratch_path(spark, "s11_predictions")
    pev = fx.predictions_ev(spark, sf)
    pev.limit(0).write.mode("overwrite").parquet(path)
    S.replace_keyed(pev, path, "model_version")
    S.replace_keyed(pev.filter("window_hours = 24").withColumn("model_version", F.lit("fixture_v2")), path,
                    "model_version")
    S.replace_keyed(pev.filter("window_hours = 1"), path, "model_version")
    return spark.read.parquet(path).select(*pev.columns)


@query("s12_csv_roundtrip", """
SELECT county_fips, avg(max_customers) AS avg_customers_affected, max(max_customers) AS max_customers_ever,
       avg(duration_hours) AS avg_duration_hours, count(event_began) AS total_historical_outages
FROM oraw GROUP BY county_fips""", dbl=("avg_customers_affected", "max_customers_ever", "avg_duration_hours"))
def s12(spark, sf):
    path = scratch_path(spark, "s12_history_csv")
    hist = A.county_history(oraw(spark, sf))
    S.write_csv(hist, path)
    return S.read_csv(spark, path, hist.schema)


@query("s08_s09_snapshot_fresh", "SELECT * FROM o1")
def s08(spark, sf):
    path = scratch_path(spark, "s08_snapshot")
    S.write_snapshot(o1(spark, sf), path, at=_NOW - dt.timedelta(hours=3))
    return S.fresh(S.read_table(spark, path), now=_NOW, hours=24).drop("snapshot_ts")


@query("s09_stale_snapshot", "SELECT * FROM o1 WHERE false")
def s09(spark, sf):
    path = scratch_path(spark, "s09_snapshot")
    S.write_snapshot(o1(spark, sf), path, at=_NOW - dt.timedelta(hours=25))
    return S.fresh(S.read_table(spark, path), now=_NOW, hours=24).drop("snapshot_ts")


@query("s07_read_or_snapshot", "SELECT * FROM o1")
def s07(spark, sf):
    primary, snap = scratch_path(spark, "s07_primary"), scratch_path(spark, "s07_snapshot")
    view = o1(spark, sf)
    S.replace_table(view.limit(0), primary)
    S.write_snapshot(view, snap)
    return S.read_or_snapshot(spark, primary, snap)


_PROFILE_COLS = [("county_fips", "string"), ("county_name", "string"), ("state", "string"),
                 ("start_time", "timestamp"), ("max_customers", "double"), ("duration_hours", "double")]


@query("s15_profile", "\nUNION ALL\n".join(
    f"SELECT 'outages' AS \"table\", '{c}' AS \"column\", '{t}' AS type, (SELECT count(*) FROM o1) AS rows, "
    f"count({c}) AS non_null, {i} AS position FROM o1" for i, (c, t) in enumerate(_PROFILE_COLS)))
def s15(spark, sf):
    return S.profile(o1(spark, sf), "outages")


@query("p24_p25_risk_scales", """
SELECT county_fips, prediction_time, window_hours, outage_probability,
       CASE WHEN outage_probability >= 0.8 THEN 'Critical' WHEN outage_probability >= 0.7 THEN 'High'
            WHEN outage_probability >= 0.5 THEN 'Elevated' ELSE 'Low' END AS risk_label,
       risk_level AS risk_bin,
       least(greatest(outage_probability, 0.0), 1.0) AS clamped
FROM pev""")
def p24(spark, sf):
    pev = fx.predictions_ev(spark, sf)
    return pev.select("county_fips", "prediction_time", "window_hours", "outage_probability",
                      P.risk_label("outage_probability").alias("risk_label"),
                      P.risk_bin("outage_probability").alias("risk_bin"),
                      P.clamp01("outage_probability").alias("clamped"))


@query("p26_warning_rows", f"""
WITH {LATEST_SQL}
SELECT county_fips, coalesce(county_name, county_fips) AS county_name, state, window_hours,
       coalesce(outage_probability, 0.0) AS outage_probability,
       CASE WHEN coalesce(outage_probability, 0.0) >= 0.8 THEN 'Critical' WHEN coalesce(outage_probability, 0.0) >= 0.7 THEN 'High'
            WHEN coalesce(outage_probability, 0.0) >= 0.5 THEN 'Elevated' ELSE 'Low' END AS risk_level
FROM latest WHERE window_hours = 24 AND coalesce(outage_probability, 0.0) >= 0.7
ORDER BY outage_probability DESC, county_fips, window_hours LIMIT 15""")
def p26(spark, sf):
    return AL.warning_rows(W.latest_per_key(fx.predictions_ev(spark, sf)), 0.7, window_hours=24)


@query("p29_alert_rows", f"""
WITH {LATEST_SQL},
x AS (SELECT *, least(greatest(coalesce(outage_probability, 0.0), 0.0), 1.0) AS probability FROM latest
      WHERE state IS NOT NULL AND county_name IS NOT NULL AND window_hours IS NOT NULL),
y AS (SELECT *, probability >= 0.7 AS is_warning,
             CASE WHEN probability >= 0.8 THEN 'Critical' WHEN probability >= 0.7 THEN 'High'
                  WHEN probability >= 0.5 THEN 'Elevated' ELSE 'Low' END AS risk_level FROM x)
SELECT county_fips, county_name, state, window_hours, prediction_time, probability, risk_level, is_warning,
       CASE WHEN is_warning THEN risk_level || ' Outage Warning' ELSE 'No Active Warning' END AS status,
       'Hey there! ' || county_name || ', ' || state || ' is ' || CASE WHEN is_warning THEN 'above' ELSE 'below' END
         || ' your selected warning threshold for the next ' || CAST(window_hours AS VARCHAR) || ' hours.' AS message
FROM y""")
def p29(spark, sf):
    return AL.alert_rows(W.latest_per_key(fx.predictions_ev(spark, sf)), 0.7)


@query("p30_pct_change", """
WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM o1)
SELECT CAST(NULL AS DOUBLE) AS guarded_zero, (2.0 - n) / n * 100.0 AS change FROM n""", dbl=("change",))
def p30(spark, sf):
    """Guarded percent change: NULL when the base is 0, else (b - a) / a * 100."""
    n = o1(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.select(P.pct_change(F.lit(0.0), F.lit(5.0)).alias("guarded_zero"),
                    P.pct_change(F.col("n"), F.lit(2.0)).alias("change"))


@query("s13_backup_copy", "SELECT * FROM o1")
def s13(spark, sf):
    primary, backup = scratch_path(spark, "s13_primary"), scratch_path(spark, "s13_backup")
    S.write_backup(o1(spark, sf), primary, backup)
    return S.read_table(spark, backup)


@query("s14_model_roundtrip", """
SELECT county_fips, min(date) AS date, 0.0::DOUBLE AS p_rf, 0.0::DOUBLE AS p2 FROM oraw WHERE false GROUP BY county_fips""")
def s14(spark, sf):
    """Fit, save, load: the loaded pipeline scores the same probabilities (rows = disagreements, expect 0)."""
    from . import models as M
    from .catalog_features import daily
    from .daily_features import DAILY_FEATURES

    d = M.materialize(daily(spark, sf))
    m = M.fit(d, DAILY_FEATURES, "random_forest", name="rf")
    path = scratch_path(spark, "s14_model")
    M.save_model(m, path)
    a = M.probability(m, d, "rf").select("county_fips", "date", "p_rf")
    b = M.probability(M.load_model(path), d, "rf").select("county_fips", "date", F.col("p_rf").alias("p2"))
    return a.join(b, ["county_fips", "date"]).filter(F.col("p_rf") != F.col("p2"))
