"""Domain loaders and the two outage/storm views.

``load`` reads any domain table with its explicit schema (parquet or JSON
lines); the view builders then apply the reference's projection, defaults and
null rules as one lazy plan, so filters reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import default_number, default_text, pad_fips, time_column, to_number, to_time
from ..session import configure


def load(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a domain table with its declared schema (nothing inferred)."""
    configure(spark)
    reader = spark.read.schema(schemas.TABLES[name])
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "json":
        return reader.json(path)
    return reader.format(fmt).load(path)


# -- S1: SQL-console outage view (N1: missing numerics become 0) -----------
def outages_zero(raw: DataFrame) -> DataFrame:
    return (
        raw.filter(F.col("location.county_fips").isNotNull())
        .select(
            F.col("location.county_fips").alias("county_fips"),
            default_text("location.county_name", "Unknown").alias("county_name"),
            F.coalesce(F.col("location.state"), F.lit("")).alias("state"),
            to_time("start_time").alias("start_time"),
            default_number("max_customers").alias("max_customers"),
            default_number("duration_hours").alias("duration_hours"),
        )
        .filter(F.col("start_time").isNotNull())
    )


# -- S2: SQL-console storm view ---------------------------------------------
def storms_zero(raw: DataFrame, cz_type: str | None = "C") -> DataFrame:
    cond = F.col("location.county_fips").isNotNull()
    if cz_type is not None:
        cond = cond & (F.col("location.cz_type") == cz_type)
    return (
        raw.filter(cond)
        .select(
            F.col("location.county_fips").alias("county_fips"),
            F.coalesce(F.col("location.state"), F.lit("")).alias("state"),
            to_time("begin_date").alias("storm_time"),
            default_text("event_type", "Unknown").alias("storm_event_type"),
            default_number("damage_property").alias("damage_property"),
            default_number("magnitude").alias("magnitude"),
        )
        .filter(F.col("storm_time").isNotNull())
    )


def register_views(spark: SparkSession, outages: DataFrame, storms: DataFrame | None = None,
                   cache: bool = False) -> None:
    """Temp views ``outages`` / ``storms`` for SQL users (cache only on request)."""
    o = outages_zero(outages)
    (o.cache() if cache else o).createOrReplaceTempView("outages")
    if storms is not None:
        s = storms_zero(storms)
        (s.cache() if cache else s).createOrReplaceTempView("storms")


# -- S3: raw outage / weather load for the daily features (N2: nulls kept) --
def outages_raw(raw: DataFrame) -> DataFrame:
    return (
        raw.select(
            F.col("location.county_fips").alias("county_fips"),
            F.col("location.state").alias("state"),
            to_time("event_began").alias("event_began"),
            F.to_date(to_time("event_began")).alias("date"),
            F.col("max_customers").cast("double").alias("max_customers"),
            F.col("duration_hours").cast("double").alias("duration_hours"),
            F.col("event_type"),
        )
        .dropna(subset=["county_fips", "date"])
    )


def weather_raw(raw: DataFrame) -> DataFrame:
    return (
        raw.select(
            F.col("location.county_fips").alias("county_fips"),
            to_time("begin_date").alias("begin_date"),
            F.to_date(to_time("begin_date")).alias("date"),
            F.col("event_type"),
            F.col("damage_property").cast("double").alias("damage_property"),
            F.col("magnitude").cast("double").alias("magnitude"),
            F.col("injuries").cast("double").alias("injuries"),
            F.col("deaths").cast("double").alias("deaths"),
        )
        .dropna(subset=["county_fips", "date"])
    )


# -- S4: early-warning loads (FIPS padding, coercion, time-column choice) -----
def warning_outages(raw: DataFrame, per_row_time: bool = False) -> DataFrame:
    """Event time, padded FIPS, numbers coerced to 0.

    A missing FIPS is dropped (documented deviation N9: the reference turns it
    into '00000' / '0None' and keeps it).
    """
    flat = raw.select(
        F.col("location.county_fips").alias("_fips"),
        F.col("location.county_name").alias("county_name"),
        F.col("location.state").alias("state"),
        F.col("event_began"), F.col("start_time"),
        F.col("max_customers"), F.col("duration_hours"),
    )
    event_time = time_column(flat, ["event_began", "start_time"], per_row=per_row_time)
    return (
        flat.select(
            event_time.alias("event_time"),
            pad_fips("_fips").alias("county_fips"),
            "county_name", "state",
            to_number(F.col("max_customers")).alias("max_customers"),
            to_number(F.col("duration_hours")).alias("duration_hours"),
        )
        .dropna(subset=["event_time", "county_fips"])
    )


def warning_weather(raw: DataFrame) -> DataFrame:
    return (
        raw.select(
            to_time("begin_date").alias("event_time"),
            pad_fips("location.county_fips").alias("county_fips"),
            to_number(F.col("damage_property")).alias("damage_property"),
            to_number(F.col("magnitude")).alias("magnitude"),
        )
        .dropna(subset=["event_time", "county_fips"])
    )


# -- S5: population as a lookup, one row per FIPS --------------------------
def population_lookup(pop: DataFrame, order_col: str | None = None) -> DataFrame:
    """Deduplicate on FIPS so joins never fan out.

    The reference keeps the *last* row per key in collection order; a
    DataFrame has no order, so the tie is broken by ``order_col`` (largest
    wins; default the largest population), which is deterministic. A grouped
    ``max_by`` aggregates map-side, so a key repeated many times never lands
    whole in one task.
    """
    keyed = pop.select(
        pad_fips("county_fips").alias("county_fips"),
        to_number(F.col("latest_population")).alias("latest_population"),
        *([F.col(order_col).alias("_ord")] if order_col else []),
    )
    if order_col:
        pick = F.max_by("latest_population", F.struct("_ord", "latest_population"))
    else:
        pick = F.max("latest_population")
    return keyed.groupBy("county_fips").agg(pick.alias("latest_population"))


# -- S6: generators, 4 columns ------------------------------------------------
def generators_load(gens: DataFrame) -> DataFrame:
    return gens.select("state", "county", "nameplate_capacity_mw", "age_years")
