"""Adapters that map the driver's star-schema tables onto the domain tables.

The formulas are fixed so the DuckDB oracle can compute the same rows
(see FIXTURES.md). Every adapter is a lazy DataFrame plan over the parquet
files: filters and projections reach the scans, dimension joins are left
to Catalyst (nation/region are tiny and broadcast under the size threshold;
customer is joined by shuffle when it is large).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import WINDOWS_HOURS, pad_fips, risk_bin
from ..session import configure

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _events(spark, sf_dir, types) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*types))
    return ev.select(
        F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value"), _k().alias("k"),
    )


def _county_dim(spark, sf_dir) -> DataFrame:
    """custkey -> county name and state (nation name)."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return cust.join(nation, cust.c_nationkey == nation.n_nationkey, "inner").select(
        "c_custkey", "c_name", "n_name")


def outages_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-of-day outages from `events` of type 'error'."""
    ev = _events(spark, sf_dir, ["error"])
    dim = _county_dim(spark, sf_dir)
    j = ev.join(dim, ev.user_id == dim.c_custkey, "inner")
    return j.select(
        F.struct(
            pad_fips(F.col("user_id").cast("string")).alias("county_fips"),
            F.col("c_name").alias("county_name"),
            F.col("n_name").alias("state"),
        ).alias("location"),
        F.col("ts").alias("start_time"),
        F.col("ts").alias("event_began"),
        F.concat(F.lit("cause_"), (F.col("k") % 7).cast("string")).alias("event_type"),
        (F.col("value") * 100.0).alias("max_customers"),
        F.col("k").cast("double").alias("duration_hours"),
    )


def storms_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm events from `events` of type 'click' / 'view'."""
    ev = _events(spark, sf_dir, ["click", "view"])
    dim = _county_dim(spark, sf_dir)
    j = ev.join(dim, ev.user_id == dim.c_custkey, "inner")
    k = F.col("k")
    return j.select(
        F.struct(
            pad_fips(F.col("user_id").cast("string")).alias("county_fips"),
            F.col("n_name").alias("state"),
            F.when(k % 5 != 0, F.lit("C")).otherwise(F.lit("Z")).alias("cz_type"),
        ).alias("location"),
        F.col("ts").alias("begin_date"),
        F.concat(F.lit("storm_"), (k % 9).cast("string")).alias("event_type"),
        F.col("value").alias("damage_property"),
        (k.cast("double") / 10.0).alias("magnitude"),
        (k % 3).cast("double").alias("injuries"),
        F.lit(0.0).alias("deaths"),
    )


def outages_cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar outages 1995-2001 from `orders`; duration = order quantity (null if no lines)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    # Pre-aggregate lineitem to one row per order before the join (map-side partial agg).
    qty = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
           .agg(F.sum("l_quantity").alias("qty")))
    dim = _county_dim(spark, sf_dir)
    j = (orders.join(dim, orders.o_custkey == dim.c_custkey, "inner")
         .join(qty, orders.o_orderkey == qty.l_orderkey, "left"))
    return j.select(
        F.struct(
            pad_fips(F.col("o_custkey").cast("string")).alias("county_fips"),
            F.col("c_name").alias("county_name"),
            F.col("n_name").alias("state"),
        ).alias("location"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        F.col("o_orderdate").cast("timestamp").alias("event_began"),
        F.col("o_orderpriority").alias("event_type"),
        F.col("o_totalprice").alias("max_customers"),
        F.col("qty").alias("duration_hours"),
    )


def region_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state -> region (nation name -> region name); the A7 dimension."""
    nation = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("state"), F.col("r_name").alias("region"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = _county_dim(spark, sf_dir)
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    j = cust.join(dim, "c_custkey")
    return j.select(
        pad_fips(F.col("c_custkey").cast("string")).alias("county_fips"),
        F.col("c_name").alias("county_name"),
        F.col("n_name").alias("state_name"),
        F.round(F.abs(F.col("c_acctbal")) * 100.0).alias("latest_population"),
    )


def generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_type").alias("state"),
        F.col("p_brand").alias("county"),
        F.col("p_size").cast("double").alias("nameplate_capacity_mw"),
        (F.col("p_retailprice") / 100.0).alias("age_years"),
    )


def predictions_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored early-warning predictions, one per event."""
    ev = _events(spark, sf_dir, ["click", "view", "signup", "error", "purchase"])
    dim = _county_dim(spark, sf_dir)
    j = ev.join(dim, ev.user_id == dim.c_custkey, "inner")
    windows = F.array(*[F.lit(w) for w in WINDOWS_HOURS])
    p = F.least(F.col("value") / 150.0, F.lit(1.0))
    return j.select(
        pad_fips(F.col("user_id").cast("string")).alias("county_fips"),
        F.col("c_name").alias("county_name"),
        F.col("n_name").alias("state"),
        F.col("ts").alias("prediction_time"),
        F.element_at(windows, (F.col("k") % 5 + 1)).alias("window_hours"),
        p.alias("outage_probability"),
        (p >= 0.5).cast("int").alias("predicted_outage"),
        risk_bin(p).alias("risk_level"),
        F.lit("fixture").alias("model_used"),
        F.lit("fixture_v1").alias("model_version"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, target, p): labelled scores with ties, for evaluation operators."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    p = F.floor(F.least(F.col("n_chars").cast("double"), F.lit(4000.0)) / 4.0) / 1000.0
    return j.select(
        F.col("doc_id"),
        F.col("toxic").cast("int").alias("target"),
        p.cast("double").alias("p"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, features array<double>, target) for kNN-based resampling."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        (F.col("label") == 0).cast("int").alias("target"),
    )
