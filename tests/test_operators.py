"""Joins, windows, aggregates and evaluation on edge frames (closed ends, empty frames, ties)."""

import datetime as dt


from outagelens.operators import aggregates as A
from outagelens.operators import evaluation as E
from outagelens.operators import joins as J
from outagelens.operators import windows as W

T = dt.datetime(2024, 1, 10, 12, 0, 0)
US = dt.timedelta(microseconds=1)


def test_storm_pairs_closed_both_ends(spark):  # J1
    o = spark.createDataFrame([("00001", T)], "county_fips string, start_time timestamp")
    storms = [T - dt.timedelta(days=7), T - dt.timedelta(days=7) - US, T, T + US]
    s = spark.createDataFrame([("00001", t, f"s{i}") for i, t in enumerate(storms)],
                              "county_fips string, storm_time timestamp, storm_event_type string")
    got = sorted(r.storm_event_type for r in J.storm_pairs(o, s).collect())
    assert got == ["s0", "s2"]


def test_trailing_closed_open_and_empty(spark):  # W5, N6
    ev = [T - dt.timedelta(hours=24), T - dt.timedelta(hours=24) - US, T - US, T]
    e = spark.createDataFrame([("00001", t, 10.0 * (i + 1)) for i, t in enumerate(ev)],
                              "county_fips string, event_time timestamp, max_customers double")
    c = spark.createDataFrame([("00001", T), ("00002", T)], "county_fips string, prediction_time timestamp")
    specs = [W.Trail("n24", "count", 24), W.Trail("s24", "sum", 24, "max_customers"),
             W.Trail("m24", "mean", 24, "max_customers")]
    for chunk in (None, 5):
        got = {r.county_fips: (r.n24, r.s24, r.m24) for r in W.trailing(c, e, specs, chunk_hours=chunk).collect()}
        assert got["00001"] == (2, 40.0, 20.0)  # t-24h and t-1us; not t-24h-1us, not t
        assert got["00002"] == (0, 0.0, 0.0)


def test_trailing_equals_range_join(spark):  # W5 = range join
    from tests.conftest import SF_SMALL
    from outagelens.plans.catalog import QUERIES

    x = QUERIES["w05_trailing"](spark, SF_SMALL)
    y = QUERIES["w05_trailing_small_chunks"](spark, SF_SMALL)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_without_future_event(spark):  # J7
    o = spark.createDataFrame([("00001", T)], "county_fips string, event_time timestamp")
    c = spark.createDataFrame([("00001", T - dt.timedelta(hours=1), 1), ("00001", T - dt.timedelta(hours=1) - US, 1),
                               ("00001", T, 1), ("00002", T, 24)],
                              "county_fips string, prediction_time timestamp, window_hours int")
    kept = J.without_future_event(c, o).collect()
    # [t, t+1h) excludes an event exactly at t+1h; a candidate at the event time is dropped
    assert sorted((r.county_fips, r.prediction_time) for r in kept) == [
        ("00001", T - dt.timedelta(hours=1) - US), ("00001", T - dt.timedelta(hours=1)), ("00002", T)]


def test_latest_per_key_nulls_and_ties(spark):  # W1
    df = spark.createDataFrame([("a", 1, T, 0.1), ("a", 1, None, 0.9), ("a", 1, T, 0.3), ("b", 1, None, 0.2)],
                               "county_fips string, window_hours int, prediction_time timestamp, outage_probability double")
    got = {r.county_fips: r.outage_probability for r in W.latest_per_key(df).collect()}
    assert got == {"a": 0.3, "b": 0.2}


def test_abs_correlations_constant_and_nan(spark):  # A15, N7
    rows = [(1.0, 2.0, 5.0, float("nan")), (2.0, 4.0, 5.0, 1.0), (3.0, 6.5, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "y double, a double, c double, n double")
    got = {r.feature: r.correlation for r in A.abs_correlations(df, "y", ["a", "c", "n"]).collect()}
    assert set(got) == {"a", "n"} and abs(got["n"] - 1.0) < 1e-12


def test_by_region_empty_region_gives_zero(spark):  # A7
    o = spark.createDataFrame([("S1", 10.0), ("S1", None)], "state string, max_customers double")
    regions = spark.createDataFrame([("S1", "R1"), ("S2", "R2")], "state string, region string")
    got = {r.region: tuple(r)[1:] for r in A.by_region(o, regions).collect()}
    assert got == {"R1": (2, 10.0, 10.0), "R2": (0, 0.0, 0.0)}


def test_histogram_last_bucket(spark):  # A29
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (0, 0.999)], "target int, p double")
    got = sorted(tuple(r) for r in A.score_histogram(df).collect())
    assert got == [(0, 1, 1), (0, 50, 1), (1, 50, 1)]


def test_auc_ties_and_single_class(spark):  # E2
    df = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.9), (0, 0.1)], "target int, p double")
    assert abs(E.roc_auc(df).first()[0] - 0.875) < 1e-12
    one = spark.createDataFrame([(0, 0.3), (0, 0.4)], "target int, p double")
    assert E.roc_auc(one).first()[0] == 0.0


def test_pr_curve_and_thresholds(spark):  # E4-E7
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.2)], "target int, p double")
    curve = E.pr_curve(df)
    pts = {r.threshold: (r.precision, r.recall) for r in curve.collect()}
    assert pts[0.9] == (1.0, 0.5) and pts[0.7] == (2 / 3, 1.0) and pts[None] == (1.0, 0.0)
    assert E.best_f1(curve).first().threshold == 0.7
    assert E.at_recall(curve, 0.9).first().threshold == 0.7
    assert E.at_precision(curve, 0.7).first().threshold == 0.9


def test_metrics_zero_division(spark):  # E1 with one class
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "target int, pred int, p double")
    r = E.metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.roc_auc, r.accuracy) == (0.0, 0.0, 0.0, 0.0, 1.0)
    cells = {(c.actual, c.predicted): c.n for c in E.confusion(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_null_keys_grouping_rules(spark):  # N4: null type is a group in A6, dropped in A12
    o = spark.createDataFrame([("S", None, 1.0, 2.0), ("S", "a", 3.0, None), ("S", None, None, 4.0)],
                              "state string, event_type string, max_customers double, duration_hours double")
    by_type = {r.event_type: (r["count"], r.avg_customers, r.avg_duration) for r in A.by_event_type(o).collect()}
    assert by_type == {None: (2, 1.0, 3.0), "a": (1, 3.0, None)}
    top = A.top_event_types(o, k=10).collect()
    assert [(r.state, r.event_type, r["count"]) for r in top] == [("S", "a", 1)]


def test_region_dimension_with_unassigned_state(spark):  # A7: a state in no region is not counted
    o = spark.createDataFrame([("Texas", 5.0), ("District of Columbia", 7.0)], "state string, max_customers double")
    regions = spark.createDataFrame([("Texas", "Southwest"), ("Maine", "Northeast")], "state string, region string")
    got = {r.region: (r.outage_count, r.total_customers_affected) for r in A.by_region(o, regions).collect()}
    assert got == {"Southwest": (1, 5.0), "Northeast": (0, 0.0)}


def test_sum_of_nothing_is_zero(spark):  # N3
    w = spark.createDataFrame([("01001", None, None, None, None)],
                              "county_fips string, damage_property double, injuries double, deaths double, x double")
    r = A.county_weather_profile(w).first()
    assert (r.weather_event_count, r.avg_damage, r.total_injuries, r.total_deaths) == (1, None, 0.0, 0.0)


def test_finer_buckets_same_result(spark):  # J1 / J7 hot-bucket split option
    from tests.conftest import SF_SMALL
    from outagelens.plans.catalog_aggregates import o1, s1
    from outagelens.plans.catalog_joins import _probe_cands
    from outagelens.sources import fixtures as fx
    from outagelens.sources import loaders as L

    a = J.storm_pairs(o1(spark, SF_SMALL), s1(spark, SF_SMALL))
    b = J.storm_pairs(o1(spark, SF_SMALL), s1(spark, SF_SMALL), bucket_hours=5)
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
    o = L.warning_outages(fx.outages_ev(spark, SF_SMALL))
    c = _probe_cands(spark, SF_SMALL)
    x, y = J.without_future_event(c, o), J.without_future_event(c, o, bucket_hours=1)
    assert x.count() == y.count() and x.exceptAll(y).count() == 0
