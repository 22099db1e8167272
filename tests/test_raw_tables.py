"""Catalog tables of raw events, the seeded generator, and busy days."""

from pyspark.sql import functions as F

from tidemark.definitions import EventSource
from tidemark.sources import events as ev

RAW = EventSource("raw", "raw", "raw")
START = 1_785_542_400_000  # 2026-08-01


def test_raw_table_is_pruned_by_day(spark, tmp_path):
    df = ev.generate_events(spark, 3000, 50, 200, START)
    ev.create_raw_table(spark, "raw_events_t", str(tmp_path / "raw"))
    ev.create_raw_table(spark, "raw_events_t", str(tmp_path / "raw"))
    ev.append_events(df, "raw_events_t", RAW)
    ev.append_events(df.limit(0), "raw_events_t", RAW)
    try:
        table = spark.table("raw_events_t")
        assert table.count() == 3000 and table.columns[-1] == "event_day"
        probes = spark.createDataFrame([(START + 3 * 86_400_000,)], "as_of_ms bigint")
        near = ev.within(table, probes, 86_400_000)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_day" in plan.replace("\n", " ")
        assert 0 < near.count() < 3000
        assert sorted(r.event_id for r in table.select("event_id").collect()) == sorted(f"e{i}" for i in range(3000))
    finally:
        spark.sql("DROP TABLE raw_events_t")


def test_a_busy_day_is_written_by_several_tasks(spark, tmp_path):
    df = ev.generate_events(spark, 4000, 50, 200, START, days=1).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ev.write_events(df, str(tmp_path / "one"), RAW)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "one").rglob("*.parquet"))) >= 3


def test_generated_events(spark):
    make = lambda seed: ev.generate_events(spark, 20_000, 400, 1500, START, seed=seed)
    one = make(1).cache()
    assert sorted(map(str, one.limit(50).collect())) == sorted(map(str, make(1).limit(50).collect()))
    assert one.exceptAll(make(2)).count() > 19_000
    share = {r.event_type: r["count"] / 20_000 for r in one.groupBy("event_type").count().collect()}
    for kind, want in zip(("impression", "watch", "like", "share", "follow"), (0.60, 0.30, 0.06, 0.03, 0.01)):
        assert abs(share[kind] - want) < 0.02
    late = (F.unix_millis("created_ts") - F.unix_millis("event_ts")).alias("d")
    delays = [r.d for r in one.select(late).collect()]
    assert min(delays) >= 0 and max(delays) <= 21_600_000 and 0.03 < sum(d > 250 for d in delays) / 20_000 < 0.07
    users = sorted((r["count"] for r in one.groupBy("user_id").count().collect()), reverse=True)
    assert users[0] > 10 * users[len(users) // 2] or users[0] > 400
    assert one.filter("(event_type = 'watch') != (watch_seconds IS NOT NULL)").count() == 0
