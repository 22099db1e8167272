import json

import pytest

from tidemark import streaming
from tidemark.operators import skew, tiles
from tidemark.plans import catalog, views

T0 = 1786384800000
BASE = {"kind": "watch", "user_id": 1, "item_id": 1, "created_ms": T0, "liked": 0, "shared": 0, "event_type": "view"}


def topic(tmp_path, *files):
    at = tmp_path / "topic"
    at.mkdir(exist_ok=True)
    for i, rows in enumerate(files):
        (at / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(at)


def event(i, ms, x):
    return BASE | {"event_id": i, "event_ms": ms, "watch_seconds": x}


def test_landing_restarts_without_duplicates(spark, tmp_path):
    at = topic(tmp_path, [event(1, T0, 1.0), event(2, T0, None)], [event(3, T0 + 1, 2.0)])
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        streaming.land_events(spark, streaming.source(spark, at), catalog.WIRE, out, ck)
    assert spark.read.parquet(out).count() == 3


def test_tiles_late_events_and_redelivery(spark, tmp_path):
    first = [event(1, T0, 10.0), event(2, T0 + 60000, 20.0), event(3, T0 + 400000, 5.0)]
    late = [event(4, T0 - 30 * 86400000, 7.0)]
    at = topic(tmp_path, first, late, late)
    view, hour = views.USER_ENGAGEMENT, 3600000
    streaming.keep_tiles(spark, streaming.source(spark, at), catalog.WIRE, [view], str(tmp_path / "o"), str(tmp_path / "c"))
    kept = streaming.current_tiles(spark, str(tmp_path / "o"), view, hour)
    got = {(r.agg_name, r.tile_index): (r.s0, r.s1) for r in streaming.long_tiles(kept, view, hour).collect()}
    assert got[("watch_seconds_sum", T0 // hour)] == (35.0, None) and got[("watch_seconds_avg", T0 // hour)] == (35.0, 3.0)
    assert got[("count", (T0 - 30 * 86400000) // hour)] == (2.0, None)  # delivered twice, counted twice
    states = streaming.stored_state(spark, str(tmp_path / "c"))
    assert states.filter(f"key._grid = {hour}").count() == 2


def test_compaction_keeps_reads_and_restarts(spark, tmp_path):
    day, view, hour = 86400000, views.USER_ENGAGEMENT, 3600000
    batches = [[event(1, T0 - 40 * day, 1.0), event(2, T0, 2.0)], [event(3, T0, 3.0)], [event(4, T0 - 3 * day, 4.0)], [event(5, T0 + 1, 5.0)]]
    at, out, ck = topic(tmp_path, *batches), str(tmp_path / "o"), str(tmp_path / "c")
    run = lambda: streaming.keep_tiles(spark, streaming.source(spark, at), catalog.WIRE, [view], out, ck)
    read = lambda: {r["_tile"]: r["watch_seconds_sum_0"] for r in streaming.current_tiles(spark, out, view, hour).collect()}
    run()
    before = read()
    assert before == {T0 // hour: 10.0, (T0 - 40 * day) // hour: 1.0, (T0 - 3 * day) // hour: 4.0}
    streaming.compact(spark, out)
    assert read() == before
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["batch=3", "upto=2"]
    topic(tmp_path, *batches, [event(6, T0, 6.0)], [event(7, T0, 7.0)])
    run()
    streaming.compact(spark, out, [view], T0)
    assert read() == {T0 // hour: 23.0, (T0 - 3 * day) // hour: 4.0}
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["batch=5", "upto=4"]


def test_an_interrupted_compaction_is_ignored(spark, tmp_path):
    view, hour = views.USER_ENGAGEMENT, 3600000
    at, out = topic(tmp_path, [event(1, T0, 1.0)], [event(2, T0, 2.0)], [event(3, T0, 3.0)]), str(tmp_path / "o")
    streaming.keep_tiles(spark, streaming.source(spark, at), catalog.WIRE, [view], out, str(tmp_path / "c"))
    (tmp_path / "o" / "upto=1").mkdir()
    (tmp_path / "o" / "upto=1" / "part-0.parquet").write_text("half")
    for _ in range(2):
        assert [r["watch_seconds_sum_0"] for r in streaming.current_tiles(spark, out, view, hour).collect()] == [6.0]
        streaming.compact(spark, out)


def test_expired_state_is_dropped(spark, tmp_path):
    view = views.USER_ENGAGEMENT
    keep = streaming.retention(view)
    files = [[event(1, T0, 1.0)], [event(2, T0 + 3 * keep, 2.0)], [event(3, T0 + 3 * keep + 1, 4.0)], [event(4, T0, 8.0)]]
    out, ck = str(tmp_path / "o"), str(tmp_path / "c")
    for n in range(1, 5):
        at = topic(tmp_path, *files[:n])
        streaming.keep_tiles(spark, streaming.source(spark, at), catalog.WIRE, [view], out, ck, expire=True)
    assert streaming.stored_state(spark, ck).count() == len(tiles.by_grid(view))
    got = {r["_tile"]: r["watch_seconds_sum_0"] for r in streaming.current_tiles(spark, out, view, 3600000).collect()}
    assert got == {T0 // 3600000: 1.0, (T0 + 3 * keep) // 3600000: 6.0}


def test_one_source_for_one_consumer(spark):
    with pytest.raises(ValueError):
        streaming.tile_updates(spark.createDataFrame([], catalog.WIRE), [views.USER_DAY, views.CUSTOMER_ORDERS])


def test_impressions_count_but_measure_nothing(spark, tmp_path):
    rows = [event(1, T0, None) | {"kind": "impression"}]
    parsed = streaming.parse(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"), catalog.WIRE)
    got = {r.agg_name for r in tiles.build_tiles(parsed, views.USER_ENGAGEMENT).collect()}
    assert "count" in got and not any(n.startswith("watch") for n in got)


def test_log(spark, tmp_path):
    entry = lambda i, f: {"log_id": str(i), "view_name": "v", "view_version": 1, "entity_keys": {"k": "1"}, "request_ts_ms": T0, "served_at_ms": T0 + 1, "features": f}
    at = topic(tmp_path, [entry(1, {"a": 1.0, "b": None, "c": 2.0}), entry(2, {"a": 1.0})], [entry(3, {"a": 3.0})])
    streaming.land_log(spark, streaming.source(spark, at), str(tmp_path / "o"), str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert len(rows) == 5 and [r.value for r in rows if r.feature_name == "b"] == [None]
    assert skew.LOG_DDL
