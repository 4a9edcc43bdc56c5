"""P-functions and null rules on hand-written edge frames."""

import datetime as dt

from pyspark.sql import functions as F

from outagelens.functions import columns as P
from outagelens.sources import loaders as L


def test_pad_fips_never_truncates(spark):  # N8
    df = spark.createDataFrame([("1001",), ("01001",), ("1234567",), (None,)], "f string")
    got = [r[0] for r in df.select(P.pad_fips("f")).collect()]
    assert got == ["01001", "01001", "1234567", None]


def test_to_number_coerces_bad_values(spark):  # N10
    df = spark.createDataFrame([("12.5",), ("n/a",), (None,)], "x string")
    assert [r[0] for r in df.select(P.to_number("x")).collect()] == [12.5, 0.0, 0.0]


def test_default_text_and_number(spark):  # P9
    df = spark.createDataFrame([("", None), (None, 0.0), ("A", 3.0)], "s string, x double")
    rows = df.select(P.default_text("s", "Unknown"), P.default_number("x")).collect()
    assert [tuple(r) for r in rows] == [("Unknown", 0.0), ("Unknown", 0.0), ("A", 3.0)]


def test_risk_scales_differ_at_edges(spark):  # P24 vs P25
    ps = [0.5, 0.7, 0.8, 1.0, -0.01, None]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    rows = df.select(P.risk_label("p"), P.risk_bin("p")).collect()
    assert [r[0] for r in rows] == ["Elevated", "High", "Critical", "Critical", "Low", "Low"]
    assert [r[1] for r in rows] == ["Low", "Elevated", "High", "Critical", "nan", "nan"]


def test_season_and_flags(spark):  # P18-P20
    df = spark.createDataFrame([(dt.date(2021, m, 15),) for m in range(1, 13)], "date date")
    x = P.storm_season_quarter(P.season_flags(P.calendar(df, "date")))
    rows = x.orderBy("month").collect()
    assert [r.season for r in rows] == [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 1]
    assert [r.is_summer for r in rows] == [0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0, 0]
    assert [r.quarter for r in rows] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]
    compat = P.season_flags(P.calendar(df, "date"), compat=True).orderBy("month").collect()
    assert [r.is_summer for r in compat] == [0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]  # reference codes spring


def test_weekday_monday_zero(spark):  # P16
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 6),)], "date date")  # Mon, Sat
    rows = P.calendar(df, "date").collect()
    assert [(r.day_of_week, r.is_weekend) for r in rows] == [(0, 0), (5, 1)]


def test_pct_change_guard(spark):  # P30
    df = spark.createDataFrame([(0.0, 5.0), (4.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(P.pct_change("a", "b")).collect()] == [None, 25.0]


def test_time_column_picks_first_nonempty_column(spark):  # P13
    df = spark.createDataFrame([(None, dt.datetime(2020, 1, 1)), (None, None)],
                               "event_began timestamp, start_time timestamp")
    rows = df.select(P.time_column(df, ["event_began", "start_time"]).alias("t")).collect()
    assert rows[0].t == dt.datetime(2020, 1, 1)


def test_year_range_is_pushable(spark, tmp_path):  # P4/P5
    path = str(tmp_path / "t")
    spark.createDataFrame([(dt.datetime(2021, 1, 1),), (dt.datetime(2022, 1, 1),)], "t timestamp") \
        .write.parquet(path)
    df = spark.read.parquet(path).filter(P.year_range("t", 2021))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t" in plan
    assert df.count() == 1


def test_outage_views_null_rules(spark):  # N1 vs N2, N5
    from outagelens import schemas

    rows = [({"county_fips": "01001", "county_name": "", "state": None}, dt.datetime(2020, 1, 1), None, None,
             None, 2.0),
            ({"county_fips": None, "county_name": "X", "state": "S"}, dt.datetime(2020, 1, 1), None, None, 1.0, 1.0),
            ({"county_fips": "01001", "county_name": "A", "state": "S"}, None, None, None, 1.0, 1.0)]
    raw = spark.createDataFrame(rows, schemas.OUTAGES)
    z = L.outages_zero(raw).collect()
    assert len(z) == 1 and z[0].county_name == "Unknown" and z[0].state == "" and z[0].max_customers == 0.0
    r = L.outages_raw(raw.withColumn("event_began", F.col("start_time")))
    assert r.agg(F.avg("max_customers")).first()[0] is None  # N2: nulls skipped, not zero


def test_population_lookup_dedupes(spark):  # J5
    df = spark.createDataFrame([("1001", 5.0), ("01001", 7.0), ("2", 1.0)], "county_fips string, latest_population double")
    got = {r.county_fips: r.latest_population for r in L.population_lookup(df).collect()}
    assert got == {"01001": 7.0, "00002": 1.0}
