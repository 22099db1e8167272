from datetime import timedelta as td

import pytest

from tidemark.definitions import Aggregation, DefinitionError, Entity, EventSource, FeatureView, Function, Registry, ResolutionLadder, Tier, feature_specs, tile_specs, window_label
from tidemark.definitions import DEFAULT_LADDER as LADDER
from tidemark.plans import views

SOURCE = EventSource("events", "events", "events")
USER = Entity("user", "user_id")
COUNT = Aggregation(Function.COUNT, (td(hours=1),))


@pytest.mark.parametrize("window, label", [(td(hours=1), "1h"), (td(days=1), "1d"), (td(days=7), "7d"), (td(minutes=5), "5m"), (td(hours=48), "2d"), (td(minutes=90), "90m"), (td(seconds=1), "1s")])
def test_labels(window, label):
    assert window_label(window) == label


@pytest.mark.parametrize("window, grid", [(td(minutes=5), td(minutes=5)), (td(hours=1), td(minutes=5)), (td(hours=12), td(minutes=5)), (td(hours=13), td(hours=1)), (td(days=7), td(hours=1)), (td(days=21), td(hours=1))])
def test_ladder(window, grid):
    assert LADDER.granularity(window) == grid


@pytest.mark.parametrize("window", [td(days=22), td(minutes=7), td(0)])
def test_ladder_refuses(window):
    with pytest.raises(DefinitionError):
        LADDER.granularity(window)


def test_tile_cap():
    with pytest.raises(DefinitionError):
        ResolutionLadder((Tier(td(days=7), td(minutes=5)),)).granularity(td(days=7))


@pytest.mark.parametrize(
    "make",
    [
        lambda: Entity("User", "user_id"),
        lambda: Entity("user", "1d"),
        lambda: EventSource("e", "e", "t", "ts", "ts"),
        lambda: EventSource("e", "e", " "),
        lambda: Aggregation(Function.SUM, (td(hours=1),)),
        lambda: Aggregation(Function.COUNT, (td(hours=1),), "x"),
        lambda: Aggregation(Function.SUM, (), "x"),
        lambda: Aggregation(Function.SUM, (td(hours=1), td(minutes=60)), "x"),
        lambda: Aggregation(Function.SUM, (td(milliseconds=1500),), "x"),
        lambda: Aggregation("median", (td(hours=1),), "x"),
        lambda: ResolutionLadder(()),
        lambda: ResolutionLadder((Tier(td(days=1), td(hours=1)), Tier(td(days=1), td(hours=2)))),
        lambda: FeatureView("v", (), SOURCE, (COUNT,), td(days=1)),
        lambda: FeatureView("v", (USER, USER), SOURCE, (COUNT,), td(days=1)),
        lambda: FeatureView("v", (USER,), SOURCE, (), td(days=1)),
        lambda: FeatureView("v", (USER,), SOURCE, (COUNT, COUNT), td(days=1)),
        lambda: FeatureView("v", (USER,), SOURCE, (COUNT,), td(minutes=1)),
        lambda: FeatureView("v", (USER,), SOURCE, (COUNT,), td(days=1), version=0),
        lambda: Registry(()),
    ],
)
def test_refused(make):
    with pytest.raises(DefinitionError):
        make()


def test_registry():
    a = FeatureView("a", (USER,), SOURCE, (COUNT,), td(days=1))
    with pytest.raises(DefinitionError):
        Registry((a, FeatureView("a", (USER,), SOURCE, (COUNT,), td(days=1), version=2)))
    with pytest.raises(DefinitionError):
        Registry((a, FeatureView("b", (Entity("user", "uid"),), SOURCE, (COUNT,), td(days=1))))
    r = Registry((a,))
    assert r.view_for_feature("a:count_1h") is a
    for bad in ("a", "a:", "b:count_1h", "a:count_2h", ":count_1h"):
        with pytest.raises(DefinitionError):
            r.view_for_feature(bad)


def test_specs():
    f = {x.name: (x.window_ms, x.grid_ms) for x in feature_specs(views.USER_ENGAGEMENT)}
    assert len(f) == 8 and f["count_1h"] == (3600000, 300000) and f["count_1d"] == (86400000, 3600000)
    t = {(x.basename, x.grid_ms): x.retention_ms for x in tile_specs(views.USER_ENGAGEMENT)}
    assert t[("watch_seconds_sum", 3600000)] == 7 * 86400000 and t[("watch_seconds_sum", 300000)] == 3600000


def test_definitions_do_not_import_spark():
    import subprocess
    import sys

    code = "import sys, tidemark.definitions; assert not any(m.startswith('pyspark') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
