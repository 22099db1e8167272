"""Online reads: vectors from kept tile states and the recent events of each key.

State is what the streams keep: the tile table with, for each key and tile of the finest grid, the
newest event (agg LAST), and the raw events of the tile in progress. A read is a batch lookup join;
freshness follows the offline rule, newest event before T."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..definitions import FeatureView, feature_specs
from ..functions.windowing import tile_index
from ..sources.events import normal
from .asof import ROW, Strategy, tiled_features
from .tiles import by_grid

LAST = "last_event_ms"


def last_seen_tiles(events: DataFrame, view: FeatureView) -> DataFrame:
    """(keys, tile_index, last_event_ms) on the finest grid."""
    g = min(by_grid(view))
    e = normal(events, view.source)
    return e.groupBy(*view.join_keys, tile_index(F.col("_event_ms"), g).alias("tile_index")).agg(F.max("_event_ms").alias(LAST))


def online_vectors(tiles: DataFrame, last: DataFrame, recent: DataFrame, view: FeatureView, requests: DataFrame) -> DataFrame:
    """requests: row id, keys, as_of_ms. Adds last_known_ms, is_fresh and the features, null where stale
    or never seen. `recent` must hold the events of every tile that a request falls in."""
    values = tiled_features(recent, view, requests, Strategy.RANGE, tiles)
    g = min(by_grid(view))
    rows = requests.select(ROW, *view.join_keys, "as_of_ms", tile_index(F.col("as_of_ms"), g).alias("_tile"))
    # the last tile before each request's, in one pass over a key's tiles and requests
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    asked = rows.select(*view.join_keys, F.col("_tile").alias("_at"), F.lit(0).alias("_kind"), ROW, none(LAST, last.schema[LAST].dataType))
    told = last.select(*view.join_keys, F.col("tile_index").alias("_at"), F.lit(1).alias("_kind"), none(ROW, rows.schema[ROW].dataType), LAST)
    told = told.join(rows.select(*view.join_keys).distinct(), list(view.join_keys), "left_semi")
    so_far = Window.partitionBy(*view.join_keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = asked.unionByName(told).withColumn("_a", F.max(LAST).over(so_far)).filter("_kind = 0").select(ROW, "_a")
    e = normal(recent, view.source).withColumn("_tile", tile_index(F.col("_event_ms"), g)).select(*view.join_keys, "_tile", "_event_ms")
    head = rows.join(e, [*view.join_keys, "_tile"]).filter("_event_ms < as_of_ms").groupBy(ROW).agg(F.max("_event_ms").alias("_b"))
    out = requests.join(values, ROW).join(whole, ROW, "left").join(head, ROW, "left").withColumn("last_known_ms", F.greatest("_a", "_b"))
    out = out.withColumn("is_fresh", F.coalesce(F.col("as_of_ms") - F.col("last_known_ms") <= view.ttl_ms, F.lit(False)))
    return out.select(*requests.columns, "last_known_ms", "is_fresh", *[F.when(F.col("is_fresh"), F.col(f.name)).alias(f.name) for f in feature_specs(view)])


class OnlineStore:
    """Answers for lists of entities, in order, from the state tables."""

    def __init__(self, tiles: DataFrame, last: DataFrame, recent: DataFrame):
        self.tiles, self.last, self.recent = tiles, last, recent

    def get_online_features(self, view: FeatureView, entities: list[dict], as_of_ms: int | None = None) -> list[dict]:
        """One dict of features for each entity, as of now unless told; a missing key is an error of the caller."""
        as_of_ms = int(time.time() * 1000) if as_of_ms is None else as_of_ms
        if not entities:
            return []
        for e in entities:
            missing = [k for k in view.join_keys if k not in e]
            if missing:
                raise KeyError(f"entity lacks {missing}")
        ddl = f"{ROW} BIGINT, " + ", ".join(f"{x.join_key} {x.key_type.value}" for x in view.entities) + ", as_of_ms BIGINT"
        rows = [(i, *(e[k] for k in view.join_keys), as_of_ms) for i, e in enumerate(entities)]
        got = online_vectors(self.tiles, self.last, self.recent, view, self.tiles.sparkSession.createDataFrame(rows, ddl))
        by = {r[ROW]: {n: r[n] for n in view.feature_names} for r in got.collect()}
        return [by[i] for i in range(len(entities))]
