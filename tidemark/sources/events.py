"""Event tables: schemas, loading, and events derived from the test data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..definitions import EventSource
from ..functions.windowing import to_millis

RAW_DDL = "event_id STRING, event_type STRING, user_id STRING, video_id STRING, event_ts TIMESTAMP, created_ts TIMESTAMP, watch_seconds DOUBLE, liked INT, shared INT"
#: The same on the wire: both times are epoch milliseconds.
WIRE_DDL = RAW_DDL.replace("TIMESTAMP", "BIGINT")
EVENT_TYPES = ("impression", "watch", "like", "share", "follow")


def events_dataframe(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Raw events of Python dicts with epoch-millisecond times; known before it happened is an error."""
    for r in rows:
        for k in ("event_ts", "created_ts"):
            if isinstance(r[k], datetime):
                raise TypeError(f"{k} must be epoch milliseconds, which have no zone to guess")
        if r["created_ts"] < r["event_ts"]:
            raise ValueError(f"event {r['event_id']} is known before it happened")
    names = [c.split()[0] for c in WIRE_DDL.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], WIRE_DDL)
    return df.withColumns({c: F.timestamp_millis(c) for c in ("event_ts", "created_ts")})


def _by_day(df: DataFrame, source: EventSource) -> DataFrame:
    """With event_day, in ranges of day and time: a busy day is spread over several tasks and files."""
    day = F.to_date(F.timestamp_millis(to_millis(F.col(source.event_time), df.schema[source.event_time])))
    return df.withColumn("event_day", day).repartitionByRange("event_day", source.event_time).sortWithinPartitions("event_day", source.event_time)


def create_raw_table(spark: SparkSession, name: str, path: str) -> None:
    """A catalog table of raw events in Parquet, partitioned by event day, unless it is there already."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RAW_DDL}, event_day DATE) USING parquet PARTITIONED BY (event_day) LOCATION '{path}'")


def append_events(df: DataFrame, name: str, source: EventSource) -> None:
    """Adds events to a table of create_raw_table; new days become partitions of the catalog."""
    names = [c.split()[0] for c in RAW_DDL.split(", ")]
    _by_day(df, source).select(*names, "event_day").write.insertInto(name)


def write_events(df: DataFrame, path: str, source: EventSource, replace: bool = True) -> None:
    """Parquet partitioned by event day, sorted by event time within files; replaces or appends."""
    out = _by_day(df, source)
    out.write.mode("overwrite" if replace else "append").option("compression", "zstd").partitionBy("event_day").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def normal(events: DataFrame, source: EventSource) -> DataFrame:
    """Adds _event_ms and _known_ms by the source's own columns; other columns stay."""
    ms = lambda c: to_millis(F.col(c), events.schema[c])
    return events.withColumn("_event_ms", ms(source.event_time)).withColumn("_known_ms", ms(source.known_time))


def within(events: DataFrame, probes: DataFrame, longest_ms: int, column: str = "event_day") -> DataFrame:
    """Only the event days that the probes' windows can touch, so that day partitions are pruned. One
    row of bounds comes to the driver."""
    if column not in events.columns:
        return events
    lo, hi = probes.agg(F.min("as_of_ms"), F.max("as_of_ms")).first()
    if lo is None:
        return events.limit(0)
    day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
    return events.filter(F.col(column).between(day(lo - 2 * longest_ms), day(hi)))


def generate_events(spark: SparkSession, rows: int, users: int, videos: int, start_ms: int, days: int = 10, seed: int = 1, late: float = 0.05, tail_ms: int = 60_000, cap_ms: int = 21_600_000) -> DataFrame:
    """Seeded raw events: kinds in the proportions .60, .30, .06, .03, .01, Zipf keys (exponents 0.8 for
    users, 1.1 for videos), a share `late` known after a Pareto delay (1.5, from tail_ms, up to cap_ms), the
    others within 250 ms. Every value is a hash of the row's number, so reruns agree on any cluster."""

    def uniform(tag: str) -> Column:
        return (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(tag)), 11).cast("double") + 0.5) / float(1 << 53)

    def zipf(tag: str, n: int, s: float) -> Column:
        # inverse of the integral of x ** -s over 1 .. n + 1
        return F.least(F.lit(n), F.floor(F.pow((float(n + 1) ** (1 - s) - 1) * uniform(tag) + 1, F.lit(1 / (1 - s))))).cast("string")

    u = uniform("kind")
    kind = F.when(u < 0.6, "impression").when(u < 0.9, "watch").when(u < 0.96, "like").when(u < 0.99, "share").otherwise("follow")
    event_ms = (F.lit(start_ms) + F.floor(uniform("time") * (days * 86_400_000))).cast("long")
    tail = F.least(F.lit(float(cap_ms)), tail_ms * F.pow(uniform("tail"), F.lit(-1 / 1.5)))
    delay = F.floor(F.when(uniform("late") < late, tail).otherwise(uniform("prompt") * 250)).cast("long")
    df = spark.range(rows).withColumns({"event_type": kind, "event_ms": event_ms, "delay": delay})
    return df.select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"),
        "event_type",
        zipf("user", users, 0.8).alias("user_id"),
        zipf("video", videos, 1.1).alias("video_id"),
        F.timestamp_millis("event_ms").alias("event_ts"),
        F.timestamp_millis(F.col("event_ms") + F.col("delay")).alias("created_ts"),
        F.when(F.col("event_type") == "watch", F.round(uniform("seconds") * 300, 3)).alias("watch_seconds"),
        (F.col("event_type") == "like").cast("int").alias("liked"),
        (F.col("event_type") == "share").cast("int").alias("shared"),
    )


# ---- the test data as events -------------------------------------------------------------------

KINDS = {"view": "watch", "click": "like", "purchase": "share", "error": "impression", "signup": "follow"}


def event_millis() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def engagement(spark: SparkSession, sf_dir: str, lateness: int = 1) -> DataFrame:
    """events.parquet as engagement events. Arrival times are derived: one event in twenty is late by up
    to six hours (times `lateness`), the rest by up to 250 ms."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    eid = F.col("event_id")
    late = F.lit(60000).cast("long") + (eid * 7919) % 21540000
    delay = F.when(eid % 20 == 0, late * lateness).otherwise((eid * 31) % 251) if lateness else (eid * 31) % 251
    kind = F.col("event_type")
    named = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in KINDS.items()])
    return e.select(
        "event_id",
        named.alias("kind"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        event_millis().alias("event_ms"),
        (event_millis() + delay).alias("created_ms"),
        F.when(kind == "view", F.col("value")).alias("watch_seconds"),
        (kind == "click").cast("int").alias("liked"),
        (kind == "purchase").cast("int").alias("shared"),
        F.col("event_type"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to answer for: after late events, on the hour, exactly at an event, and between."""
    e = engagement(spark, sf_dir).filter("event_id % 5 = 0")
    ms = F.col("event_ms")
    k = F.col("event_id") % 20
    as_of = F.when(k == 0, ms + 1800000).when(k == 5, ms - F.pmod(ms, F.lit(3600000).cast("long"))).when(k == 15, ms).otherwise(ms + 420000)
    return e.select(F.col("event_id").alias("entity_row_id"), "user_id", "item_id", "event_type", as_of.alias("as_of_ms"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders.parquet as events of customers, one in twenty known up to sixty days late."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    late = F.when(F.col("o_orderkey") % 20 == 0, 1 + F.col("o_orderkey") % 60).otherwise(0).cast("long")
    return o.select("o_orderkey", "o_custkey", ms.alias("event_ms"), (ms + late * 86400000).alias("created_ms"), "o_totalprice")


def order_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_events(spark, sf_dir).filter("o_orderkey % 3 = 0")
    return o.select(F.col("o_orderkey").alias("entity_row_id"), "o_custkey", (F.col("event_ms") + 43200000).alias("as_of_ms"))
