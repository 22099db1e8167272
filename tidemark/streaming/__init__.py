"""Structured Streaming: landing of raw events, tile states, and the log of served vectors.

Three independent queries, each with its checkpoint. One tile query serves all views of a source. Late
events fold into the tile of their event time, however late, unless `expire` bounds state by retention. Sources are directories of JSON lines with the shape of a message's
value; where the Kafka connector is on the class path, `source` reads a topic instead."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..definitions import FeatureView, Function, tile_specs
from ..functions import states
from ..functions.windowing import retention_start, tile_index
from ..operators.skew import LOG_DDL, explode_log
from ..operators.tiles import by_grid
from ..sources.events import normal


def source(spark: SparkSession, at: str, kafka: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """A stream of message values: from JSON-lines files below `at`, or from topic `at` of a broker."""
    if kafka:
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", kafka).option("subscribe", at).option("startingOffsets", "earliest")
        return stream.load().select(F.col("value").cast("string").alias("value"))
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(at)


def parse(values: DataFrame, ddl: str) -> DataFrame:
    return values.select(F.from_json("value", ddl).alias("m")).select("m.*")


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", continuous: str | None = None):
    """Run foreachBatch over what is there and stop, or with `continuous` (a trigger interval) go on.
    Batches are numbered and rewritten whole on a retry, so that output is exactly once."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    query = writer.start()
    if not continuous:
        query.awaitTermination()
    return query


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its own, replaced if the batch is run again."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")

    return write


def land_events(spark: SparkSession, values: DataFrame, ddl: str, path: str, checkpoint: str, dedup: tuple[str, str] | None = None, **how):
    """Raw events to a table. dedup = (id column, delay): repeated ids within that delay are dropped,
    by a watermark; it must exceed any real lateness, or late events are lost."""
    rows = parse(values, ddl)
    if dedup:
        key, delay = dedup
        rows = rows.withColumn("_at", F.timestamp_millis("event_ms")).withWatermark("_at", delay).dropDuplicatesWithinWatermark([key]).drop("_at")
    return drain(rows, checkpoint, batch_sink(path), **how)


def retention(view: FeatureView) -> int:
    """Milliseconds after which no read needs a tile of the view."""
    return max(t.retention_ms + t.grid_ms for t in tile_specs(view))


def _folds(views: Sequence[FeatureView]) -> dict[tuple[Function, str | None], str]:
    """The distinct aggregates of several views, and names for their states."""
    found = {(t.function, t.column) for view in views for t in tile_specs(view)}
    return {f: f"_{f[0].name.lower()}_{f[1] or ''}" for f in sorted(found, key=lambda f: (f[0].name, f[1] or ""))}


def _entity(view: FeatureView) -> Column:
    return F.to_json(F.struct(*view.join_keys))


def tile_updates(events: DataFrame, views: Sequence[FeatureView], expire: bool = False) -> DataFrame:
    """Streaming tile states of all grids of several views over one source, in one aggregation: an event
    fans out to (view, entity, grid, tile). With `expire`, state and events older than every view's
    retention are dropped, by a watermark; without, late events fold into their tile, however late."""
    source = views[0].source
    if any(v.source != source for v in views):
        raise ValueError("one consumer reads one source")
    rows = normal(events, source)
    at = [F.struct(F.lit(v.name).alias("_view"), _entity(v).alias("_entity"), F.lit(g).cast("long").alias("_grid"), tile_index(F.col("_event_ms"), g).alias("_tile")) for v in views for g in by_grid(v)]
    keys = ["_view", "_entity", "_grid", "_tile"]
    if expire:
        # a tile's end is the event time by which the watermark passes it
        keep = max(retention(v) for v in views)
        rows = rows.withColumn("_at", F.timestamp_millis("_event_ms")).withWatermark("_at", f"{keep} milliseconds")
        longest = max(g for v in views for g in by_grid(v))
        rows = rows.withColumn("_window", F.window("_at", f"{longest} milliseconds"))
        keys = ["_window", *keys]
    columns = {"_event_ms", *(c for _, c in _folds(views) if c), *(["_window"] if expire else [])}
    rows = rows.select(*sorted(columns), F.explode(F.array(*at)).alias("_to")).select(*sorted(columns), "_to.*")
    aggs = []
    for (function, column), name in _folds(views).items():
        s0, s1 = states.lift(function, column)
        aggs += [s0.alias(f"{name}_0"), s1.alias(f"{name}_1")]
    return rows.groupBy(*keys).agg(*aggs, F.max("_event_ms").alias("last_event_ms")).drop("_window")


def keep_tiles(spark: SparkSession, values: DataFrame, ddl: str, views: Sequence[FeatureView], path: str, checkpoint: str, expire: bool = False, **how):
    """Keeps tile states of all views' grids: changed tiles of each batch, in update mode. State lies in
    RocksDB, so it may exceed the executors' heaps; redelivered messages count again (at-least-once
    sources)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return drain(tile_updates(parse(values, ddl), views, expire), checkpoint, batch_sink(path), mode="update", **how)


_STATE = ["_view", "_entity", "_grid", "_tile"]


def _folders(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest whole compaction below `path`, and the batches after it."""
    fs, root = _files(spark, path)
    listed = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    whole = [int(n.removeprefix("upto=")) for n in listed if n.startswith("upto=") and fs.exists(_path(spark, f"{path}/{n}/_SUCCESS"))]
    upto = max(whole, default=None)
    batches = sorted(int(n.removeprefix("batch=")) for n in listed if n.startswith("batch=") and fs.exists(_path(spark, f"{path}/{n}/_SUCCESS")))
    return upto, [n for n in batches if upto is None or n > upto]


def _path(spark: SparkSession, at: str):
    return spark._jvm.org.apache.hadoop.fs.Path(at)


def _files(spark: SparkSession, path: str):
    root = _path(spark, path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _updates(spark: SparkSession, path: str, upto: int | None, batches: list[int]) -> DataFrame:
    folders = ([(f"{path}/upto={upto}", upto)] if upto is not None else []) + [(f"{path}/batch={n}", n) for n in batches]
    # one scan of all folders; a row's batch is read from its file's name
    rows = spark.read.parquet(*[f for f, _ in folders])
    return rows.withColumn("_batch", F.regexp_extract(F.input_file_name(), "/(?:batch|upto)=([0-9]+)/", 1).cast("long"))


def _newest(rows: DataFrame) -> DataFrame:
    """Updates of a tile keep their order by batch, so the newest wins by a maximum combined before the
    shuffle."""
    rest = [c for c in rows.columns if c not in (*_STATE, "_batch")]
    return rows.groupBy(*_STATE).agg(F.max_by(F.struct(*rest), "_batch").alias("s")).select(*_STATE, "s.*")


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each tile, from the last compaction and the batches after it."""
    upto, batches = _folders(spark, path)
    if upto is None and not batches:
        raise FileNotFoundError(f"no batch was written to {path}")
    return _newest(_updates(spark, path, upto, batches))


def current_tiles(spark: SparkSession, path: str, view: FeatureView, grid_ms: int) -> DataFrame:
    """The view's tiles on one grid, wide: keys, _tile, (basename_0, basename_1), last_event_ms."""
    ddl = ", ".join(f"{e.join_key} {e.key_type.value}" for e in view.entities)
    mine = current_states(spark, path).filter((F.col("_view") == view.name) & (F.col("_grid") == grid_ms))
    names = _folds([view])
    cols = [F.col(f"{names[t.function, t.column]}_{i}").alias(f"{t.basename}_{i}") for t in by_grid(view)[grid_ms] for i in (0, 1)]
    return mine.withColumn("_key", F.from_json("_entity", ddl)).select("_key.*", "_tile", *cols, "last_event_ms")


def compact(spark: SparkSession, path: str, views: Sequence[FeatureView] = (), as_of_ms: int | None = None) -> None:
    """Folds all batches but the newest into one table of current states, and deletes what it replaces; with
    `as_of_ms`, leaves out the tiles of `views` that no read as of then or later needs. The newest batch
    stays, since a restart may write it again. Interrupted anywhere it can be run again: a compaction counts
    once its _SUCCESS file is there, and folders that it covers are no longer read. A reader that began
    before must end before the deletion."""
    upto, batches = _folders(spark, path)
    if len(batches) < 2:
        return
    last = batches[-2]
    rows = _newest(_updates(spark, path, upto, batches[:-1]))
    if as_of_ms is not None:
        kept = F.lit(True)
        for v in views:
            for g, specs in by_grid(v).items():
                first = retention_start(F.lit(as_of_ms).cast("long"), max(t.retention_ms for t in specs), g)
                kept = kept & ~((F.col("_view") == v.name) & (F.col("_grid") == g) & (F.col("_tile") < first))
        rows = rows.filter(kept)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/upto={last}")
    fs, root = _files(spark, path)
    for s in fs.listStatus(root):
        kind, _, n = s.getPath().getName().partition("=")
        if (kind == "batch" and int(n) <= last) or (kind == "upto" and int(n) < last):
            fs.delete(s.getPath(), True)


def long_tiles(wide: DataFrame, view: FeatureView, grid_ms: int) -> DataFrame:
    """Wide states as rows of the tile table."""
    entries = [F.struct(F.lit(t.basename).alias("agg_name"), F.col(f"{t.basename}_0").alias("s0"), F.col(f"{t.basename}_1").alias("s1")) for t in by_grid(view)[grid_ms]]
    g = F.lit(grid_ms).cast("long")
    long = wide.select(*view.join_keys, "_tile", F.explode(F.array(*entries)).alias("e")).filter("e.s0 IS NOT NULL")
    return long.select(*view.join_keys, "e.agg_name", g.alias("granularity_ms"), F.col("_tile").alias("tile_index"), F.timestamp_millis(F.col("_tile") * g).alias("tile_start"), "e.s0", "e.s1")


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state itself, read from the query's checkpoint."""
    return spark.read.format("statestore").load(checkpoint)


def land_log(spark: SparkSession, values: DataFrame, path: str, checkpoint: str, **how):
    """Logged vectors to the long table: one row for each feature, null values kept."""
    return drain(explode_log(parse(values, LOG_DDL)), checkpoint, batch_sink(path), **how)
