"""P24-P29 at table scale: warning rows and per-county alert messages for every
county and window at once (the reference builds one alert for one user)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import active_warning, clamp01, label_or_key, risk_label

# Fixed values that must equal the reference's: alert status and message formats.
WARNING_STATUS = "%s Outage Warning"
NO_WARNING_STATUS = "No Active Warning"
MESSAGE = "Hey %s! %s is %s your selected warning threshold for the next %d hours."


def warning_rows(preds: DataFrame, threshold: float, window_hours: int | None = None,
                 state: str | None = None, top: int | None = 15) -> DataFrame:
    """Rows at or above ``threshold`` (P26), labelled with the left-closed scale, highest first."""
    df = preds
    if window_hours is not None:
        df = df.filter(F.col("window_hours") == window_hours)
    if state is not None and state != "ALL":
        df = df.filter(F.col("state") == state)
    p = F.coalesce(F.col("outage_probability"), F.lit(0.0))
    out = (df.withColumn("outage_probability", p)
           .filter(active_warning("outage_probability", threshold))
           .select("county_fips", label_or_key("county_name", "county_fips").alias("county_name"), "state",
                   "window_hours", "outage_probability", risk_label("outage_probability").alias("risk_level"))
           .orderBy(F.col("outage_probability").desc(), F.col("county_fips"), F.col("window_hours")))
    return out.limit(top) if top else out


def alert_rows(latest: DataFrame, threshold: float, user_name: str = "there") -> DataFrame:
    """Status and message per (county, window) from the latest predictions."""
    p = clamp01(F.coalesce(F.col("outage_probability"), F.lit(0.0)))
    df = latest.dropna(subset=["state", "county_name", "window_hours"]).withColumn("probability", p)
    warn = active_warning("probability", threshold)
    risk = risk_label("probability")
    place = F.format_string("%s, %s", F.col("county_name"), F.col("state"))
    side = F.when(warn, F.lit("above")).otherwise(F.lit("below"))
    message = F.format_string(MESSAGE, F.lit(user_name), place, side, F.col("window_hours"))
    return df.select(
        "county_fips", "county_name", "state", "window_hours", "prediction_time", "probability",
        risk.alias("risk_level"), warn.alias("is_warning"),
        F.when(warn, F.format_string(WARNING_STATUS, risk)).otherwise(F.lit(NO_WARNING_STATUS)).alias("status"),
        message.alias("message"),
    )
