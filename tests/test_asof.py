"""Hand-checked cases, and all strategies against a fold over raw events in plain Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.definitions import Aggregation, Entity, EventSource, FeatureView, Function, KeyType, ResolutionLadder, Tier, feature_specs
from tidemark.functions.windowing import tile_index
from tidemark.operators import asof, online, tiles
from tidemark.operators.asof import ROW, Semantics, Strategy
from tidemark.sources import events as ev

H, D, M5 = 3600000, 86400000, 300000
T0 = 1786384800000  # 2026-08-10 18:00 UTC
SOURCE = EventSource("raw", "raw", "raw", "happened", "known")
DDL = "k bigint, x double, happened bigint, known bigint"


def view(*aggs, ttl=timedelta(days=21), ladder=None):
    more = {"ladder": ladder} if ladder else {}
    return FeatureView("v", (Entity("k", "k", KeyType.INT64),), SOURCE, aggs, ttl, **more)


HOUR, DAY = timedelta(hours=1), timedelta(days=1)
FULL = view(Aggregation(Function.SUM, (HOUR, DAY), "x"), Aggregation(Function.COUNT, (HOUR, DAY)), Aggregation(Function.AVG, (DAY,), "x"), Aggregation(Function.MIN, (HOUR, DAY), "x"), Aggregation(Function.MAX, (DAY,), "x"))


def fold(rows, v, key, t, known):
    out = {}
    for f in feature_specs(v):
        start = (t - f.window_ms) // f.grid_ms * f.grid_ms
        hit = [x for k, x, e, c in rows if k == key and start <= e < t and (not known or c <= t)]
        xs = [x for x in hit if x is not None]
        fn = f.function
        out[f.name] = float(len(hit)) if fn is Function.COUNT else sum(xs) if fn is Function.SUM else (None if not xs else {Function.AVG: sum(xs) / len(xs), Function.MIN: min(xs), Function.MAX: max(xs)}[fn])
    return out


def answers(spark, rows, v, probes, semantics, strategy, ttl=False):
    e = spark.createDataFrame(rows, DDL)
    p = spark.createDataFrame(probes, f"{ROW} bigint, k bigint, as_of_ms bigint")
    return {r[ROW]: r.asDict() for r in asof.training_features(e, v, p, semantics, strategy, ttl).collect()}


ALL = [(Semantics.KNOWN, Strategy.JOIN), *((Semantics.EVENT_TIME, s) for s in Strategy)]


@pytest.mark.parametrize("semantics, strategy", ALL)
def test_against_fold(spark, semantics, strategy):
    r = random.Random(7)
    rows = [(r.randrange(4), r.choice([None, round(r.uniform(-50, 50), 2)]), e := T0 - r.randrange(3 * D), e + r.choice([0, 5, 100, H, 5 * H])) for _ in range(400)]
    rows += rows[:5]
    probes = [(i, r.randrange(5), T0 - r.randrange(2 * D) // r.choice([1, H]) * r.choice([1, H])) for i in range(60)]
    probes += [(100 + i, rows[i][0], rows[i][2]) for i in range(20)] + [(200 + i, rows[i][0], rows[i][3]) for i in range(20)]
    got = answers(spark, rows, FULL, probes, semantics, strategy)
    assert len(got) == len(probes)
    for i, k, t in probes:
        for name, want in fold(rows, FULL, k, t, semantics is Semantics.KNOWN).items():
            have = got[i][name]
            assert (have is None) == (want is None), (i, name)
            assert want is None or have == pytest.approx(want, rel=1e-9, abs=1e-9), (i, name)


def test_late_event_is_seen_only_by_event_time(spark):
    m = 60000
    rows = [(1, 10.0, T0 - 30 * m, T0 - 30 * m + 1000), (1, 15.0, T0 - 10 * m, T0 - 10 * m + 1000), (1, 1000.0, T0 - 10 * m, T0 + H)]
    k = answers(spark, rows, FULL, [(1, 1, T0)], Semantics.KNOWN, Strategy.JOIN)[1]
    assert (k["x_sum_1h"], k["x_sum_1d"], k["count_1h"], k["x_avg_1d"]) == (25, 25, 2, 12.5)
    e = answers(spark, rows, FULL, [(1, 1, T0)], Semantics.EVENT_TIME, Strategy.FRAME)[1]
    assert (e["x_sum_1h"], e["count_1h"]) == (1025, 3)


def test_boundaries(spark):
    rows = [(1, 7.0, T0 - 60000, T0), (1, 99.0, T0, T0)]
    k = answers(spark, rows, FULL, [(1, 1, T0)], Semantics.KNOWN, Strategy.JOIN, ttl=True)[1]
    assert (k["x_sum_1h"], k["count_1h"], k["last_known_ms"]) == (7, 1, T0 - 60000)


@pytest.mark.parametrize("strategy", list(Strategy))
def test_trailing_edge_snaps_outward_and_unseen_keys_answer(spark, strategy):
    v = view(Aggregation(Function.COUNT, (HOUR,)), Aggregation(Function.AVG, (HOUR,), "x"), ladder=ResolutionLadder((Tier(DAY, HOUR),)))
    t = T0 + 30 * 60000
    got = answers(spark, [(1, 1.0, t - H - 60000, t)], v, [(1, 1, t), (2, 9, t)], Semantics.EVENT_TIME, strategy)
    assert got[1]["count_1h"] == 1 and got[2]["count_1h"] == 0.0 and got[2]["x_avg_1h"] is None


@pytest.mark.parametrize("semantics", list(Semantics))
def test_stale_rows_are_null(spark, semantics):
    v = view(Aggregation(Function.COUNT, (DAY,)), ttl=timedelta(days=7))
    got = answers(spark, [(1, 1.0, T0 - 30 * D, T0 - 30 * D), (2, 1.0, T0 - 7 * D, T0 - 7 * D)], v, [(1, 1, T0), (2, 2, T0), (3, 3, T0)], semantics, Strategy.JOIN, ttl=True)
    assert got[1]["is_fresh"] is False and got[1]["count_1d"] is None and got[1]["last_known_ms"] == T0 - 30 * D
    assert got[2]["is_fresh"] is True and got[2]["count_1d"] == 0.0
    assert got[3]["is_fresh"] is False and got[3]["last_known_ms"] is None


@pytest.mark.parametrize("strategy", list(Strategy))
def test_empty_events_and_probes(spark, strategy):
    assert answers(spark, [], FULL, [(1, 1, T0)], Semantics.EVENT_TIME, strategy)[1]["count_1d"] == 0.0
    assert answers(spark, [(1, 1.0, T0, T0)], FULL, [], Semantics.EVENT_TIME, strategy) == {}


def test_floor_before_the_epoch(spark):
    df = spark.createDataFrame([(-1,), (-300000,), (299999,), (0,)], "ms bigint")
    assert [r[0] for r in df.select(tile_index(F.col("ms"), 300000)).collect()] == [-1, -1, 0, 0]


def test_tiles_survive_storage_and_expiry(spark, tmp_path):
    rows = [(1, 10.0, T0, T0), (1, 20.0, T0 + 60000, T0), (1, 5.0, T0 + 400000, T0), (1, None, T0 + 500000, T0)]
    built = tiles.build_tiles(spark.createDataFrame(rows, DDL), FULL)
    tiles.write_tiles(built, str(tmp_path / "t"))
    back = tiles.read_tiles(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.select(*built.columns).collect()), key=str) == sorted(map(tuple, built.collect()), key=str)
    one = {(r.agg_name, r.tile_index): (r.s0, r.s1) for r in built.filter(f"granularity_ms = {M5}").collect()}
    assert one[("x_sum", T0 // M5)] == (30.0, None) and one[("x_sum", T0 // M5 + 1)] == (5.0, None) and one[("count", T0 // M5 + 1)] == (2.0, None)
    hour = {(r.agg_name): (r.s0, r.s1) for r in built.filter(f"granularity_ms = {H}").collect()}
    assert hour["x_avg"] == (35.0, 3.0) and hour["count"] == (4.0, None)
    assert tiles.expire_tiles(built, FULL, T0 + 2 * D).count() == 0
    assert tiles.expire_tiles(built, FULL, T0 + M5).count() == built.count()


def test_row_ids_and_extra_columns(spark):
    e = spark.createDataFrame([(1, 1.0, T0 - 5, T0)], DDL)
    ts = datetime.fromtimestamp(T0 / 1000, timezone.utc)
    p = spark.createDataFrame([(2, ts, "b"), (1, ts, "a")], "k bigint, as_of_ts timestamp, label string")
    got = asof.training_features(e, FULL, p, Semantics.EVENT_TIME, Strategy.FRAME).orderBy(ROW).collect()
    assert [(r[ROW], r.k, r.label, r.count_1h) for r in got] == [(1, 1, "a", 1.0), (2, 2, "b", None)]
    with pytest.raises(ValueError):
        asof.probe_frame(p.drop("k"), FULL)


def test_online_store_keeps_order(spark):
    v = view(Aggregation(Function.SUM, (HOUR, timedelta(days=7)), "x"), ttl=timedelta(days=7))
    t = T0 + 12 * 60000
    rows = [(1, 10.0, t - 20 * 60000, t), (1, 5.0, t - 10 * 60000, t), (1, 100.0, t - 3 * H, t), (1, 2.5, t - 30000, t)]
    e = spark.createDataFrame(rows, DDL)
    store = online.OnlineStore(tiles.build_tiles(e, v), online.last_seen_tiles(e, v), e)
    got = store.get_online_features(v, [{"k": 9}, {"k": 1}], t)
    assert got == [{"x_sum_1h": None, "x_sum_7d": None}, {"x_sum_1h": 17.5, "x_sum_7d": 117.5}]
    assert store.get_online_features(v, [], t) == []
    with pytest.raises(KeyError):
        store.get_online_features(v, [{}], t)


def test_events_dataframe_checks(spark, tmp_path):
    good = {"event_id": "1", "event_type": "watch", "user_id": "u", "video_id": "v", "event_ts": 5, "created_ts": 6, "watch_seconds": 1.0, "liked": 0, "shared": 0}
    df = ev.events_dataframe(spark, [good])
    assert df.select(F.unix_millis("event_ts")).first()[0] == 5
    with pytest.raises(ValueError):
        ev.events_dataframe(spark, [good | {"created_ts": 4}])
    with pytest.raises(TypeError):
        ev.events_dataframe(spark, [good | {"event_ts": datetime(2026, 1, 1)}])
    source = EventSource("raw", "raw", "raw")
    for replace, n in ((True, 1), (True, 1), (False, 2)):
        ev.write_events(df, str(tmp_path / "e"), source, replace)
        assert ev.read_events(spark, str(tmp_path / "e")).count() == n
