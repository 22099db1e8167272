from pyspark.sql import functions as F

from tidemark.definitions import EventSource, FeatureView
from tidemark.operators import experiments
from tidemark.operators.asof import ROW
from tidemark.plans import views
from tidemark.sources import events as ev

T0 = 1786384800000
SOURCE = EventSource("raw", "raw", "raw", "event_ts", "created_ts")
BY_USER = views.USER_DAY.__class__("u", (views.Entity("user", "user_id", views.KeyType.STRING),), SOURCE, views.USER_DAY.aggregations, views.DAY)


def probes(events):
    rows = events.filter("event_type = 'impression'")
    return rows.select(F.substring("event_id", 2, 20).cast("long").alias(ROW), "user_id", F.unix_millis("event_ts").alias("as_of_ms"))


def test_sweep(spark):
    assert isinstance(BY_USER, FeatureView)
    make = lambda tail: ev.generate_events(spark, 3000, 40, 30, T0, days=2, late=0.5, tail_ms=tail)
    some = experiments.run_lateness_sweep(make, (1, 3_600_000), BY_USER, probes, F.col("event_type") == "watch", rows=300)
    prompt, late = (p.result for p in some)
    assert some[0].max_lateness_ms < some[1].p99_lateness_ms <= 21_600_000
    assert prompt.entity_rows == late.entity_rows == 300 and late.train_rows + late.test_rows == 300
    assert 0 < late.label_rate < 1 and late.features_compared == len(BY_USER.feature_names)
    assert late.rows_with_any_difference > prompt.rows_with_any_difference
    assert set(late.scores) == {("leaky", "leaky"), ("leaky", "strict"), ("strict", "strict")}
    assert all(x is None or 0 <= x <= 1 for x in late.scores.values())


def test_no_probes(spark):
    e = ev.generate_events(spark, 50, 5, 5, T0, days=1)
    got = experiments.run_leakage_experiment(e, BY_USER, probes(e).limit(0), F.col("event_type") == "watch")
    assert got.entity_rows == 0 and got.scores == {} and got.rows_with_any_difference == 0
