"""Scalar column expressions and row-wise predicates.

All of these return built-in Spark expressions, so they stay inside
whole-stage codegen; none needs a Python UDF.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "as_col", "pad_fips", "default_text", "default_number", "to_number",
    "to_time", "time_column", "year_range", "time_between", "optional_equals",
    "calendar", "hour_features", "season", "season_flags", "storm_season_quarter",
    "interactions", "polynomials", "flag_positive", "risk_label", "risk_bin",
    "active_warning", "clamp01", "label_or_key", "pct_change", "WINDOWS_HOURS", "RISK_LEVELS",
]

# Fixed values that must equal the reference's.
WINDOWS_HOURS = (1, 3, 6, 12, 24)
RISK_LEVELS = ("Low", "Elevated", "High", "Critical")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- P14 / N8: zero-pad county FIPS without ever truncating ---------------
def pad_fips(c: str | Column, width: int = 5) -> Column:
    c = as_col(c).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


# -- P9: python-style "x or default" ---------------------------------------
def default_text(c: str | Column, default: str) -> Column:
    """``x or default`` for text: null and '' both fall back."""
    return F.coalesce(F.nullif(as_col(c), F.lit("")), F.lit(default))


def default_number(c: str | Column, default: float = 0.0) -> Column:
    """``float(x or 0)``: null and 0 give ``default`` (NaN is truthy and stays)."""
    c = as_col(c).cast("double")
    return F.when(c.isNull() | (c == 0), F.lit(float(default))).otherwise(c)


# -- P11 / N10: numeric coercion, unparseable -> 0 ------------------------
def to_number(c: str | Column, default: float | None = 0.0) -> Column:
    parsed = F.expr(f"try_cast({_sql_ref(c)} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def _sql_ref(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


# -- P12: time coercion, bad values -> null -------------------------------
def to_time(c: str | Column) -> Column:
    return as_col(c).try_cast("timestamp")


# -- P13: first usable time column ----------------------------------------
def time_column(df: DataFrame, candidates: Sequence[str], per_row: bool = False) -> Column:
    """The reference picks the first *column* holding any value.

    ``per_row=False`` reproduces that with an existence probe per candidate
    (``isEmpty`` = LIMIT 1, which stops at the first non-null value instead of
    scanning the table); ``per_row=True`` coalesces row by row instead.
    """
    present = [c for c in candidates if c in df.columns]
    if not present:
        return F.lit(None).cast("timestamp")
    if per_row:
        return F.coalesce(*[to_time(c) for c in present])
    for c in present:
        if not df.select(to_time(c).alias("_t")).filter(F.col("_t").isNotNull()).isEmpty():
            return to_time(c)
    return F.lit(None).cast("timestamp")


# -- P3 / P4 / P5: time range predicates that push down --------------------
def year_range(c: str | Column, year: int) -> Column:
    """``[Jan 1 y, Jan 1 y+1)`` as two comparisons (pushable, unlike year(ts)=y)."""
    c = as_col(c)
    return (c >= F.lit(_dt.datetime(year, 1, 1))) & (c < F.lit(_dt.datetime(year + 1, 1, 1)))


def time_between(c: str | Column, start: _dt.datetime, end: _dt.datetime, closed_end: bool = False) -> Column:
    c = as_col(c)
    upper = (c <= F.lit(end)) if closed_end else (c < F.lit(end))
    return (c >= F.lit(start)) & upper


# -- P8: "ALL or equals" ---------------------------------------------------
def optional_equals(c: str | Column, value, all_token: str = "ALL") -> Column:
    if value is None or value == all_token:
        return F.lit(True)
    return as_col(c) == F.lit(value)


# -- P15-P18, P20: calendar features ---------------------------------------
def calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns({
        "year": F.year(d),
        "month": F.month(d),
        "day_of_week": F.weekday(d),  # Monday = 0
        "day_of_year": F.dayofyear(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "season": season(F.month(d)),
    })


def hour_features(df: DataFrame, ts_col: str = "prediction_time") -> DataFrame:
    t = F.col(ts_col)
    return df.withColumns({
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "month": F.month(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
    })


def season(month: str | Column) -> Column:
    """1 winter, 2 spring, 3 summer, 4 fall: ``month % 12 div 3 + 1``."""
    m = as_col(month)
    return (F.pmod(m, F.lit(12)) / 3).cast("int") + 1


def season_flags(df: DataFrame, season_col: str = "season", compat: bool = False) -> DataFrame:
    """is_summer / is_winter. ``compat=True`` keeps the reference's codes 2 / 4."""
    summer, winter = (2, 4) if compat else (3, 1)
    s = F.col(season_col)
    return df.withColumns({
        "is_summer": (s == summer).cast("int"),
        "is_winter": (s == winter).cast("int"),
    })


def storm_season_quarter(df: DataFrame, month_col: str = "month") -> DataFrame:
    m = F.col(month_col)
    return df.withColumns({
        "is_storm_season": m.isin(6, 7, 8, 9).cast("int"),
        "quarter": ((m - 1) / 3).cast("int") + 1,
    })


# -- P21 / P22 / P23 ---------------------------------------------------------
def interactions(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "weather_x_population": c("weather_event_count") * c("latest_population") / 100000.0,
        "damage_per_capita": c("total_property_damage") / (c("latest_population") + 1.0),
        "customers_per_outage": c("avg_customers_affected") / (c("total_historical_outages") + 1.0),
        "severity_score": c("avg_magnitude") * c("weather_event_count")
        * (c("total_injuries") + c("total_deaths") + 1.0),
    })


def polynomials(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "outages_squared": c("total_historical_outages") * c("total_historical_outages"),
        "population_log": F.log1p(c("latest_population")),
        "damage_log": F.log1p(c("total_property_damage")),
    })


def flag_positive(c: str | Column) -> Column:
    return (as_col(c) > 0).cast("int")


# -- P24 / P25: two risk scales that differ at .5/.7/.8 ---------------------
def risk_label(p: str | Column) -> Column:
    """Left-closed: >=.8 Critical, >=.7 High, >=.5 Elevated, else Low."""
    p = as_col(p)
    return (F.when(p >= 0.8, "Critical").when(p >= 0.7, "High")
            .when(p >= 0.5, "Elevated").otherwise("Low"))


def risk_bin(p: str | Column) -> Column:
    """Right-closed bins (-.01,.5] (.5,.7] (.7,.8] (.8,1]; outside -> 'nan'."""
    p = as_col(p)
    return (F.when((p > -0.01) & (p <= 0.5), "Low").when((p > 0.5) & (p <= 0.7), "Elevated")
            .when((p > 0.7) & (p <= 0.8), "High").when((p > 0.8) & (p <= 1.0), "Critical")
            .otherwise("nan"))


# -- P26 / P27 / P28 ---------------------------------------------------------
def active_warning(p: str | Column, threshold: float) -> Column:
    return as_col(p) >= F.lit(float(threshold))


def clamp01(p: str | Column) -> Column:
    return F.least(F.greatest(as_col(p), F.lit(0.0)), F.lit(1.0))


def label_or_key(label: str | Column, key: str | Column) -> Column:
    return F.coalesce(as_col(label), as_col(key))


# -- P30: guarded percent change ------------------------------------------
def pct_change(before: str | Column, after: str | Column) -> Column:
    """``(after - before) / before * 100``; NULL (reported N/A) when before is 0."""
    b, a = as_col(before).cast("double"), as_col(after).cast("double")
    return F.try_divide(a - b, F.nullif(b, F.lit(0.0))) * 100.0
