"""Explicit schemas of the domain tables (nothing is inferred)."""

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

OUTAGE_LOCATION = StructType([
    StructField("county_fips", StringType()),
    StructField("county_name", StringType()),
    StructField("state", StringType()),
])

OUTAGES = StructType([
    StructField("location", OUTAGE_LOCATION),
    StructField("start_time", TimestampType()),
    StructField("event_began", TimestampType()),
    StructField("event_type", StringType()),
    StructField("max_customers", DoubleType()),
    StructField("duration_hours", DoubleType()),
])

STORM_LOCATION = StructType([
    StructField("county_fips", StringType()),
    StructField("state", StringType()),
    StructField("cz_type", StringType()),
])

STORM_EVENTS = StructType([
    StructField("location", STORM_LOCATION),
    StructField("begin_date", TimestampType()),
    StructField("event_type", StringType()),
    StructField("damage_property", DoubleType()),
    StructField("magnitude", DoubleType()),
    StructField("injuries", DoubleType()),
    StructField("deaths", DoubleType()),
])

COUNTY_POPULATION = StructType([
    StructField("county_fips", StringType()),
    StructField("county_name", StringType()),
    StructField("state_name", StringType()),
    StructField("latest_population", DoubleType()),
])

GENERATORS = StructType([
    StructField("state", StringType()),
    StructField("county", StringType()),
    StructField("nameplate_capacity_mw", DoubleType()),
    StructField("age_years", DoubleType()),
])

PREDICTIONS = StructType([
    StructField("county_fips", StringType()),
    StructField("date", DateType()),
    StructField("predicted_outage", IntegerType()),
    StructField("outage_probability", DoubleType()),
    StructField("model_used", StringType()),
])

WARNING_PREDICTIONS = StructType([
    StructField("county_fips", StringType()),
    StructField("county_name", StringType()),
    StructField("state", StringType()),
    StructField("prediction_time", TimestampType()),
    StructField("window_hours", IntegerType()),
    StructField("outage_probability", DoubleType()),
    StructField("predicted_outage", IntegerType()),
    StructField("risk_level", StringType()),
    StructField("model_used", StringType()),
    StructField("model_version", StringType()),
])

MODEL_METADATA = StructType([
    StructField("model_version", StringType()),
    StructField("best_model", StringType()),
    StructField("feature_columns", ArrayType(StringType())),
    StructField("metrics", MapType(StringType(), MapType(StringType(), DoubleType()))),
    StructField("feature_importances", MapType(StringType(), DoubleType())),
])

TABLES = {
    "outages": OUTAGES,
    "storm_events": STORM_EVENTS,
    "county_population": COUNTY_POPULATION,
    "generators": GENERATORS,
    "predictions": PREDICTIONS,
    "early_warning_predictions": WARNING_PREDICTIONS,
    "model_metadata": MODEL_METADATA,
}
