"""Tiles: partial-aggregate states by key, aggregation, grid and tile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..definitions import FeatureView, TileSpec, tile_specs
from ..functions import states
from ..functions.windowing import retention_start, tile_index
from ..sources.events import normal


def by_grid(view: FeatureView) -> dict[int, list[TileSpec]]:
    out: dict[int, list[TileSpec]] = {}
    for t in tile_specs(view):
        out.setdefault(t.grid_ms, []).append(t)
    return dict(sorted(out.items()))


def wide_tiles(events: DataFrame, view: FeatureView, grid_ms: int) -> DataFrame:
    """One row for each key and tile: keys, _tile, and (basename_0, basename_1) for all aggregations of
    the grid. One aggregation, combined before the shuffle."""
    aggs = []
    for t in by_grid(view)[grid_ms]:
        s0, s1 = states.lift(t.function, t.column)
        aggs += [s0.alias(f"{t.basename}_0"), s1.alias(f"{t.basename}_1")]
    return normal(events, view.source).groupBy(*view.join_keys, tile_index(F.col("_event_ms"), grid_ms).alias("_tile")).agg(*aggs)


def build_tiles(events: DataFrame, view: FeatureView) -> DataFrame:
    """The tile table, long: keys, agg_name, granularity_ms, tile_index, tile_start, s0, s1. Aggregations
    that nothing contributed to have no tile."""
    parts = []
    for grid, specs in by_grid(view).items():
        entries = [F.struct(F.lit(t.basename).alias("agg_name"), F.col(f"{t.basename}_0").alias("s0"), F.col(f"{t.basename}_1").alias("s1")) for t in specs]
        long = wide_tiles(events, view, grid).select(*view.join_keys, "_tile", F.explode(F.array(*entries)).alias("e")).filter("e.s0 IS NOT NULL")
        g = F.lit(grid).cast("long")
        parts.append(long.select(*view.join_keys, "e.agg_name", g.alias("granularity_ms"), F.col("_tile").alias("tile_index"), F.timestamp_millis(F.col("_tile") * g).alias("tile_start"), "e.s0", "e.s1"))
    return reduce(DataFrame.unionByName, parts)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Parquet by grid and day, sorted by key within files; whole rebuild."""
    out = tiles.withColumn("tile_day", F.to_date("tile_start"))
    keys = tiles.columns[: tiles.columns.index("agg_name")]
    out = out.repartitionByRange("granularity_ms", "tile_day", *keys).sortWithinPartitions("granularity_ms", "tile_day", *keys, "tile_index")
    out.write.mode("overwrite").option("compression", "zstd").partitionBy("granularity_ms", "tile_day").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("granularity_ms", F.col("granularity_ms").cast("long")).drop("tile_day")


def expire_tiles(tiles: DataFrame, view: FeatureView, as_of_ms: int) -> DataFrame:
    """Tiles that some read as of as_of_ms or later may still need."""
    keep = F.lit(False)
    for t in tile_specs(view):
        start = retention_start(F.lit(as_of_ms).cast("long"), t.retention_ms, t.grid_ms)
        keep = keep | ((F.col("agg_name") == t.basename) & (F.col("granularity_ms") == t.grid_ms) & (F.col("tile_index") >= start))
    return tiles.filter(keep)
