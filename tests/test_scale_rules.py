"""Cases beyond the fixtures' range: long windows, null labels, huge counts, tiny scores, running sums, safe writes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from outagelens import session
from outagelens.operators import evaluation as E
from outagelens.operators import joins as J
from outagelens.operators import sampling as S
from outagelens.operators import windows as W
from outagelens.sources import sinks

T0 = dt.datetime(2020, 1, 1)


def hours(h):
    return T0 + dt.timedelta(hours=h)


def test_windows_longer_than_a_day_see_their_events(spark):
    cands = spark.createDataFrame([("a", hours(0), 72), ("a", hours(-30), 72), ("a", hours(0), 24), ("b", hours(0), 300)],
                                  "county_fips string, prediction_time timestamp, window_hours int")
    events = spark.createDataFrame([("a", hours(60)), ("b", hours(299))], "county_fips string, event_time timestamp")
    without = {(r[0], r[2], r[1]) for r in J.without_future_event(cands, events).collect()}
    assert without == {("a", 72, hours(-30)), ("a", 24, hours(0))}
    assert J.with_future_event(cands, events).count() == 2
    with pytest.raises(Exception, match="window beyond max_window_hours"):
        J.without_future_event(cands, events, max_window_hours=24).collect()


@pytest.mark.parametrize("closed", [False, True])
def test_running_sums_equal_frames(spark, closed):
    rng = random.Random(3)
    ev = [("ab"[rng.randrange(2)], hours(rng.randrange(0, 400)), rng.choice([None, 0.1, 7.25, 1e6])) for _ in range(400)]
    ca = [("abc"[rng.randrange(3)], hours(rng.randrange(-10, 600)), i) for i in range(300)]
    specs = [W.Trail("n24", "count", 24), W.Trail("n168", "count", 168), W.Trail("s72", "sum", 72, "v"), W.Trail("m24", "mean", 24, "v")]
    out = W.trailing(spark.createDataFrame(ca, "county_fips string, prediction_time timestamp, i int"),
                     spark.createDataFrame(ev, "county_fips string, event_time timestamp, v double"), specs, closed_end=closed).collect()
    assert len(out) == len(ca)
    for r in out:
        def frame(h):
            lo, hi = r["prediction_time"] - dt.timedelta(hours=h), r["prediction_time"]
            return [v for k, t, v in ev if k == r["county_fips"] and lo <= t and (t <= hi if closed else t < hi)]
        held = [v for v in frame(24) if v is not None]
        assert r["n24"] == len(frame(24)) and r["n168"] == len(frame(168))
        assert r["s72"] == pytest.approx(sum(v for v in frame(72) if v is not None), abs=1e-6)
        assert r["m24"] == pytest.approx(sum(held) / len(held) if held else 0.0, abs=1e-6)


def test_small_values_survive_large_ones(spark):
    """A large value that has left the frame, or lies ahead of it, takes nothing from a sum."""
    ev = [("a", hours(1), 1e16), ("a", hours(20), 1.0), ("a", hours(31), 1e16), ("a", hours(70), 0.5)]
    ca = [("a", hours(30)), ("a", hours(30)), ("a", hours(90)), (None, hours(30)), ("a", None)]
    specs = [W.Trail("s24", "sum", 24, "v"), W.Trail("m24", "mean", 24, "v"), W.Trail("lo", "min", 24, "v"), W.Trail("hi", "max", 72, "v"), W.Trail("n", "count", 24)]
    e = spark.createDataFrame(ev, "county_fips string, event_time timestamp, v double")
    c = spark.createDataFrame(ca, "county_fips string, prediction_time timestamp")
    for chunk in (None, 7, 100):
        got = [tuple(r)[2:] for r in W.trailing(c, e, specs, chunk_hours=chunk).orderBy("prediction_time", "county_fips").collect()]
        assert got == [(0.0, 0.0, None, None, 0), (0.0, 0.0, None, None, 0), (1.0, 1.0, 1.0, 1e16, 1), (1.0, 1.0, 1.0, 1e16, 1), (0.5, 0.5, 0.5, 1e16, 1)]


@pytest.mark.parametrize("closed, chunk", [(False, None), (True, 10)])
def test_least_and_largest_equal_frames(spark, closed, chunk):
    rng = random.Random(8)
    ev = [("ab"[rng.randrange(2)], hours(rng.randrange(0, 300)), rng.choice([None, rng.random()])) for _ in range(200)]
    ca = [("ab"[rng.randrange(2)], hours(rng.randrange(-10, 400))) for _ in range(150)]
    specs = [W.Trail("lo", "min", 24, "v"), W.Trail("hi", "max", 72, "v"), W.Trail("s", "sum", 72, "v")]
    for r in W.trailing(spark.createDataFrame(ca, "county_fips string, prediction_time timestamp"),
                        spark.createDataFrame(ev, "county_fips string, event_time timestamp, v double"), specs, chunk_hours=chunk, closed_end=closed).collect():
        def frame(h):
            lo, hi = r["prediction_time"] - dt.timedelta(hours=h), r["prediction_time"]
            return [v for k, t, v in ev if k == r["county_fips"] and lo <= t and (t <= hi if closed else t < hi) and v is not None]
        assert r["lo"] == min(frame(24), default=None) and r["hi"] == max(frame(72), default=None)
        assert r["s"] == pytest.approx(sum(frame(72)), rel=1e-12)


def test_storm_lift_counts_without_pairs(spark):
    o = spark.createDataFrame([("a", hours(h)) for h in range(0, 400, 5)] + [(None, hours(1)), ("b", None)], "county_fips string, start_time timestamp")
    s = spark.createDataFrame([("a", hours(h), "wind" if h % 2 else "hail") for h in range(-200, 400, 7)] + [("b", hours(1), "hail"), ("a", None, "wind")],
                              "county_fips string, storm_time timestamp, storm_event_type string")
    lift = J.storm_lift(o, s)
    pairs = J.storm_pairs(o, s).groupBy("storm_event_type").agg(F.count(F.lit(1)), F.count_distinct("county_fips"))
    assert sorted(map(tuple, lift.collect())) == sorted(map(tuple, pairs.collect()))
    assert "Join" not in lift._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 50, 168])
def test_rank_ranges_expand_to_the_pairs(spark, block):
    """A county with most rows, ties, both closed ends, storms outside all blocks, null keys and times."""
    rng = random.Random(block)
    o = [("a", hours(rng.randrange(0, 300))) for _ in range(120)] + [("b", hours(9)), ("b", hours(9)), (None, hours(9)), ("b", None), ("c", hours(5))]
    s = [("a", hours(rng.randrange(-300, 500)), rng.choice(["wind", "hail"])) for _ in range(60)]
    s += [("b", hours(9), "wind"), ("b", hours(9 - 168), "hail"), ("b", hours(10), "hail"), ("x", hours(1), "wind"), (None, hours(9), "wind"), ("b", None, "wind")] * 2
    o = spark.createDataFrame(o, "county_fips string, start_time timestamp")
    s = spark.createDataFrame(s, "county_fips string, storm_time timestamp, storm_event_type string")
    ranges, ranks = J.storm_ranges(o, s, block_hours=block), J.outage_ranks(o, block_hours=block)
    assert ranges.count() == s.count()
    assert sorted(map(tuple, J.expand_ranges(ranges, ranks).collect())) == sorted(map(tuple, J.storm_pairs(o, s).collect()))
    a = [r["rank"] for r in ranks.filter("county_fips = 'a'").orderBy("start_time", "rank").collect()]
    assert a == list(range(120))


def test_rows_without_a_label_stay(spark):
    df = spark.createDataFrame([(i, [0, 1, None][i % 3]) for i in range(60)], "id long, target int")
    split = S.stratified_split(df, "target", (0.8, 0.2), names=["train", "test"])
    assert split.count() == 60
    assert sorted((r[0] is None, r[1], r[2]) for r in split.groupBy("target", "split").count().collect()) == sorted(
        (c is None, s, n) for c in (0, 1, None) for s, n in (("train", 16), ("test", 4)))
    assert S.class_weights(df).count() == 60
    assert S.undersample(df, ratio=1.0).count() == 60


def test_auc_of_counts_beyond_long_products(spark):
    counts = spark.createDataFrame([(0.5, 4_000_000_000, 4_000_000_000)], "score double, pos long, neg long")
    c = E.cumulative_at_or_above(counts)
    assert c.select("tp", "fp").first() == (4_000_000_000, 4_000_000_000)
    one = E.roc_auc
    orig = E.score_counts
    try:
        E.score_counts = lambda df, label, prob: df
        assert one(counts).first()[0] == 0.5
    finally:
        E.score_counts = orig


def test_scores_close_together_are_spread_over_ranges(spark):
    df = spark.range(20_000).select((F.col("id") / 2e10).alias("score"), F.lit(1).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    ranges = E.in_ranges(df, "score").groupBy("_bk").count()
    assert ranges.agg(F.max("count")).first()[0] < 200
    c = E.cumulative_at_or_above(df)
    assert c.filter(F.col("tp") != 20_000 - F.round(F.col("score") * 2e10)).count() == 0


def test_a_failed_replace_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.range(5), path)
    with pytest.raises(Exception, match="broken"):
        sinks.replace_table(spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path)
    assert sinks.read_table(spark, path).count() == 5
    sinks.replace_table(sinks.read_table(spark, path).filter("id < 2"), path)  # of itself
    assert sinks.read_table(spark, path).count() == 2


def test_readers_survive_replaces(spark, tmp_path):
    """A reader in a loop always finds one whole version, and never an older one after a newer one."""
    import threading

    path, seen, stop = str(tmp_path / "t"), [], threading.Event()
    sinks.replace_table(spark.range(100).withColumn("v", F.lit(0)), path)

    def read():
        while not stop.is_set():
            seen.append(tuple(sinks.read_table(spark, path).agg(F.count("id"), F.min("v"), F.max("v")).first()))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for v in range(1, 21):
            sinks.replace_table(spark.range(100).withColumn("v", F.lit(v)), path)
    finally:
        stop.set()
        reader.join()
    assert len(seen) > 3 and all(n == 100 and lo == hi for n, lo, hi in seen) and [x[1] for x in seen] == sorted(x[1] for x in seen)
    assert sinks.read_table(spark, path).first()["v"] == 20


def test_a_writer_killed_before_the_pointer_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    real = sinks._files

    class Killed(Exception):
        pass

    class NoPointer:
        def __init__(self, fs):
            self.fs = fs

        def create(self, *_):
            raise Killed

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(sinks, "_files", lambda spark, path: (NoPointer(real(spark, path)[0]), real(spark, path)[1]))
    with pytest.raises(Killed):
        sinks.replace_table(spark.range(9), path)
    monkeypatch.undo()
    assert sinks.read_table(spark, path).count() == 3
    sinks.replace_table(spark.range(4), path)
    assert sinks.read_table(spark, path).count() == 4


def test_replaced_versions_go_after_a_while(spark, tmp_path):
    path = tmp_path / "t"
    for n in range(4):
        sinks.replace_table(spark.range(n), str(path), retain_hours=-1.0)
    assert len(list((path / "data").iterdir())) == len(sinks.table_versions(spark, str(path))) == 1
    for n in range(3):
        sinks.replace_table(spark.range(n), str(path))
    assert len(list((path / "data").iterdir())) == 4 and sinks.read_table(spark, str(path)).count() == 2


def test_only_a_missing_table_falls_back(spark, tmp_path):
    snap, primary = str(tmp_path / "snap"), tmp_path / "primary"
    sinks.write_snapshot(spark.range(4), snap)
    assert sinks.read_or_snapshot(spark, str(primary), snap).count() == 4
    primary.mkdir()
    (primary / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        sinks.read_or_snapshot(spark, str(primary), snap).count()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Fake:
        conf = Conf()

        @property
        def sparkContext(self):
            raise RuntimeError

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Fake())


def test_every_nation_has_a_default_region(spark):
    from outagelens.plans import catalog_aggregates as C
    from tests.conftest import SF_SMALL

    nations = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    assert set(C._EVERY_STATE_OF) == {r["n_name"] for r in nations.collect()}
    rows = C.a07_default(spark, SF_SMALL).collect()
    assert len(rows) == 5 and sum(r["outage_count"] for r in rows) == C.ocal_flat(spark, SF_SMALL).filter("state IS NOT NULL").count()
