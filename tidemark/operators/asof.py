"""Windowed features as of each probe row, under two semantics and four interchangeable strategies.

EVENT_TIME: an event counts if it happened before T. KNOWN: and if it was known at T.

JOIN    probes and raw events meet on key and time bucket; all features are conditional aggregates of
        one join. The only strategy for KNOWN, whose predicate tiles cannot answer.
FRAME   tiles and probes in one order by key: a window's whole tiles are a constant RANGE frame, its
        head a running frame inside one tile. No range join, all functions; for heavy keys.
PREFIX  running sums over tiles, read at both ends of each window; MIN and MAX go by RANGE.
RANGE   probes join the long tile table on key, aggregation, grid and a range of tiles.
"""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..definitions import FeatureSpec, FeatureView, feature_specs
from ..functions import states
from ..functions.windowing import align_down, effective_start, tile_bounds, tile_index, to_millis, visible_from
from ..sources.events import normal, within
from .numbering import number_rows
from .tiles import build_tiles, by_grid, wide_tiles

ROW = "entity_row_id"


class Semantics(Enum):
    EVENT_TIME = "event_time"
    KNOWN = "known"


class Strategy(Enum):
    JOIN = "join"
    FRAME = "frame"
    PREFIX = "prefix"
    RANGE = "range"


def probe_frame(probes: DataFrame, view: FeatureView) -> DataFrame:
    """Adds as_of_ms from as_of_ts if need be, and a row id in the order of keys and time. A row id that
    the caller gives must be unique. Other columns pass through."""
    missing = [k for k in view.join_keys if k not in probes.columns]
    if missing:
        raise ValueError(f"probes lack the join keys {missing}")
    if "as_of_ms" not in probes.columns:
        probes = probes.withColumn("as_of_ms", to_millis(F.col("as_of_ts"), probes.schema["as_of_ts"]))
    if ROW not in probes.columns:
        probes = number_rows(probes, [*view.join_keys, "as_of_ms"], ROW)
    return probes


def _bare(probes: DataFrame, view: FeatureView) -> DataFrame:
    return probes.select(ROW, *view.join_keys, "as_of_ms")


def longest_window(view: FeatureView) -> int:
    return max(f.window_ms + f.grid_ms for f in feature_specs(view))


# ---- JOIN ---------------------------------------------------------------------------------------


def join_features(events: DataFrame, view: FeatureView, probes: DataFrame, semantics: Semantics) -> DataFrame:
    """(row id, features). Time buckets are as wide as the longest window, so a probe meets at most
    three of them and a heavy key is spread over time; adaptive execution splits what is still hot."""
    specs = feature_specs(view)
    reach = longest_window(view)
    e = normal(within(events, probes, reach), view.source)
    columns = sorted({f.column for f in specs if f.column})
    e = e.select(*view.join_keys, "_event_ms", "_known_ms", *columns).withColumn("_bucket", tile_index(F.col("_event_ms"), reach))
    p = _bare(probes, view)
    start = F.least(*[effective_start(F.col("as_of_ms"), f.window_ms, f.grid_ms) for f in specs]) if len(specs) > 1 else effective_start(F.col("as_of_ms"), specs[0].window_ms, specs[0].grid_ms)
    p = p.withColumn("_start", start)
    p = p.withColumn("_bucket", F.explode(F.sequence(tile_index(F.col("_start"), reach), tile_index(F.col("as_of_ms"), reach))))
    on = [p[k] == e[k] for k in view.join_keys] + [p["_bucket"] == e["_bucket"], e["_event_ms"] >= p["_start"], e["_event_ms"] < p["as_of_ms"]]
    if semantics is Semantics.KNOWN:
        on.append(e["_known_ms"] <= p["as_of_ms"])
    met = p.join(e, reduce(Column.__and__, on), "left").drop(*(e[k] for k in view.join_keys)).drop(e["_bucket"])
    aggs = []
    for f in specs:
        inside = F.col("_event_ms") >= effective_start(F.col("as_of_ms"), f.window_ms, f.grid_ms)
        s0, s1 = states.lift(f.function, f.column, inside)
        aggs.append(states.finalize(f.function, s0, s1).alias(f.name))
    return met.groupBy(ROW).agg(*aggs)


# ---- tiles and head -----------------------------------------------------------------------------


def head_states(events: DataFrame, view: FeatureView, probes: DataFrame, grid_ms: int) -> DataFrame:
    """(row id, basename_0, basename_1, ...): states of the events in the tile that T is in, before T.
    An equi-join on key and tile."""
    e = normal(events, view.source).withColumn("_tile", tile_index(F.col("_event_ms"), grid_ms))
    specs = by_grid(view)[grid_ms]
    columns = sorted({t.column for t in specs if t.column})
    e = e.select(*view.join_keys, "_tile", "_event_ms", *columns)
    p = _bare(probes, view).withColumn("_tile", tile_index(F.col("as_of_ms"), grid_ms))
    met = p.join(e, [*view.join_keys, "_tile"]).filter("_event_ms < as_of_ms")
    aggs = []
    for t in specs:
        s0, s1 = states.lift(t.function, t.column)
        aggs += [s0.alias(f"{t.basename}_0"), s1.alias(f"{t.basename}_1")]
    return met.groupBy(ROW).agg(*aggs)


def _finish(view: FeatureView, specs: list[FeatureSpec], tiles: DataFrame, head: DataFrame) -> DataFrame:
    """tiles: (row id, feature_0, feature_1); head: (row id, basename_0, basename_1); merged and final."""
    h = head.select(F.col(ROW).alias("_h"), *[F.col(c).alias(f"_h_{c}") for c in head.columns if c != ROW])
    out = tiles.join(h, tiles[ROW] == h["_h"], "left")
    values = []
    for f in specs:
        pairs = [(F.col(f"{f.name}_0"), F.col(f"{f.name}_1")), (F.col(f"_h_{f.basename}_0"), F.col(f"_h_{f.basename}_1"))]
        values.append(states.finalize(f.function, *states.merge(f.function, pairs)).alias(f.name))
    return out.select(ROW, *values)


def _frame_grid(events: DataFrame, view: FeatureView, probes: DataFrame, grid_ms: int, specs: list[FeatureSpec]) -> DataFrame:
    keys = list(view.join_keys)
    probe = _bare(probes, view)
    tiles = wide_tiles(events, view, grid_ms)
    both = tiles.unionByName(probe.select(*keys, ROW, tile_index(F.col("as_of_ms"), grid_ms).alias("_tile")), allowMissingColumns=True)
    cols = []
    for f in specs:
        w = Window.partitionBy(*keys).orderBy("_tile").rangeBetween(-(f.window_ms // grid_ms), -1)
        s0, s1 = states.combine(f.function, F.col(f"{f.basename}_0"), F.col(f"{f.basename}_1"), lambda a, w=w: a.over(w))
        cols += [s0.alias(f"{f.name}_0"), s1.alias(f"{f.name}_1")]
    whole = both.select(ROW, *cols).filter(F.col(ROW).isNotNull())
    e = normal(events, view.source)
    measured = sorted({f.column for f in specs if f.column})
    e = e.select(*keys, tile_index(F.col("_event_ms"), grid_ms).alias("_tile"), F.col("_event_ms").alias("_ms"), F.lit(True).alias("_event"), *measured)
    p = probe.select(*keys, ROW, tile_index(F.col("as_of_ms"), grid_ms).alias("_tile"), F.col("as_of_ms").alias("_ms"))
    w = Window.partitionBy(*keys, "_tile").orderBy("_ms").rangeBetween(Window.unboundedPreceding, -1)
    cols = []
    for t in by_grid(view)[grid_ms]:
        s0, s1 = states.lift(t.function, t.column, F.col("_event"), lambda a: a.over(w))
        cols += [s0.alias(f"{t.basename}_0"), s1.alias(f"{t.basename}_1")]
    head = e.unionByName(p, allowMissingColumns=True).select(ROW, *cols).filter(F.col(ROW).isNotNull())
    return _finish(view, specs, whole, head)


def _prefix_grid(events: DataFrame, view: FeatureView, probes: DataFrame, grid_ms: int, specs: list[FeatureSpec]) -> DataFrame:
    keys = list(view.join_keys)
    tiles = wide_tiles(events, view, grid_ms).withColumn("_is_tile", F.lit(1))
    ends = []
    for k, f in enumerate(specs):
        lo, hi = tile_bounds(F.col("as_of_ms"), f.window_ms, grid_ms)
        ends += [F.struct(lo.alias("_tile"), F.lit(k).alias("_f"), F.lit(-1).alias("_sign")), F.struct(hi.alias("_tile"), F.lit(k).alias("_f"), F.lit(1).alias("_sign"))]
    # a probe sorts before the tile of equal index, so that it reads the sum of earlier tiles
    reads = _bare(probes, view).select(ROW, *keys, F.explode(F.array(*ends)).alias("e")).select(ROW, *keys, "e._tile", "e._f", "e._sign", F.lit(0).alias("_is_tile"))
    w = Window.partitionBy(*keys).orderBy("_tile", "_is_tile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = sorted({f.basename for f in specs})
    run = [F.sum(f"{n}_{i}").over(w).alias(f"_run_{n}_{i}") for n in names for i in (0, 1)]
    seen = tiles.unionByName(reads, allowMissingColumns=True).select(ROW, "_f", "_sign", *run).filter(F.col(ROW).isNotNull())
    aggs = []
    for k, f in enumerate(specs):
        mine = lambda i, k=k, f=f: F.sum(F.when(F.col("_f") == k, F.col("_sign") * F.coalesce(F.col(f"_run_{f.basename}_{i}"), F.lit(0.0))))
        aggs += [mine(0).alias(f"{f.name}_0"), mine(1).alias(f"{f.name}_1")]
    return _finish(view, specs, seen.groupBy(ROW).agg(*aggs), head_states(events, view, probes, grid_ms))


def feature_grid(probes: DataFrame, view: FeatureView) -> DataFrame:
    """One row for each probe and feature, with the window's bounds."""
    rows = []
    for f in feature_specs(view):
        lo, hi = tile_bounds(F.col("as_of_ms"), f.window_ms, f.grid_ms)
        g = F.lit(f.grid_ms).cast("long")
        rows.append(
            F.struct(
                F.lit(f.name).alias("feature_name"),
                F.lit(f.basename).alias("agg_name"),
                g.alias("granularity_ms"),
                lo.alias("lo"),
                hi.alias("hi"),
                effective_start(F.col("as_of_ms"), f.window_ms, f.grid_ms).alias("eff_start"),
                align_down(F.col("as_of_ms"), f.grid_ms).alias("head_lo"),
            )
        )
    return _bare(probes, view).select(ROW, *view.join_keys, "as_of_ms", F.explode(F.array(*rows)).alias("g")).select(ROW, *view.join_keys, "as_of_ms", "g.*")


def range_states(tiles: DataFrame, view: FeatureView, probes: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """(row id, feature_0, feature_1, ...) from the long tile table. Rows without tiles stay, null. Blocks of
    tiles are as long as an aggregation's longest window, so that a window meets at most two of them and
    a heavy key is spread over time."""
    names = [f.name for f in specs]
    longest: dict[tuple[str, int], int] = {}
    for f in specs:
        on = (f.basename, f.grid_ms)
        longest[on] = max(longest.get(on, 1), f.window_ms // f.grid_ms)
    length = F.coalesce(*[F.when((F.col("agg_name") == n) & (F.col("granularity_ms") == g), F.lit(w)) for (n, g), w in longest.items()])
    block = lambda t: F.floor(F.col(t) / F.col("_length")).cast("long")
    grid = feature_grid(probes, view).filter(F.col("feature_name").isin(names)).withColumn("_length", length)
    grid = grid.withColumn("_block", F.explode(F.sequence(block("lo"), F.floor((F.col("hi") - 1) / F.col("_length")).cast("long"))))
    kept = tiles.withColumn("_length", length).filter("_length IS NOT NULL").withColumn("_block", block("tile_index")).drop("_length")
    met = grid.join(kept, [*view.join_keys, "agg_name", "granularity_ms", "_block"]).filter("tile_index >= lo AND tile_index < hi")
    aggs = []
    for f in specs:
        mine = lambda c, f=f: F.when(F.col("feature_name") == f.name, F.col(c))
        s0, s1 = states.combine(f.function, mine("s0"), mine("s1"))
        aggs += [s0.alias(f"{f.name}_0"), s1.alias(f"{f.name}_1")]
    found = met.groupBy(ROW).agg(*aggs)
    return probes.select(ROW).join(found, ROW, "left")


def tiled_features(events: DataFrame, view: FeatureView, probes: DataFrame, strategy: Strategy, tiles: DataFrame | None = None) -> DataFrame:
    """(row id, features) under EVENT_TIME by FRAME, PREFIX or RANGE; RANGE may read a stored tile table."""
    parts = []
    for grid_ms in by_grid(view):
        specs = [f for f in feature_specs(view) if f.grid_ms == grid_ms]
        if strategy is Strategy.FRAME:
            parts.append(_frame_grid(events, view, probes, grid_ms, specs))
            continue
        summed = [f for f in specs if f.function.invertible and strategy is Strategy.PREFIX]
        others = [f for f in specs if f not in summed]
        if summed:
            parts.append(_prefix_grid(events, view, probes, grid_ms, summed))
        if others:
            found = range_states(tiles if tiles is not None else build_tiles(events, view), view, probes, others)
            parts.append(_finish(view, others, found, head_states(events, view, probes, grid_ms)))
    return reduce(lambda a, b: a.join(b, ROW), parts)


# ---- freshness and training sets ----------------------------------------------------------------


def entity_freshness(events: DataFrame, view: FeatureView, probes: DataFrame, semantics: Semantics) -> DataFrame:
    """(row id, last_known_ms, is_fresh): the newest event before T (KNOWN: and known at T). Events and
    probes in one order by key and visibility, a running maximum; no join."""
    keys = list(view.join_keys)
    e = normal(events, view.source)
    seen = visible_from(F.col("_event_ms"), F.col("_known_ms")) if semantics is Semantics.KNOWN else F.col("_event_ms") + 1
    e = e.groupBy(*keys, seen.alias("_at")).agg(F.max("_event_ms").alias("_event_ms")).withColumn("_kind", F.lit(0))
    p = _bare(probes, view).select(ROW, *keys, F.col("as_of_ms").alias("_at"), F.lit(1).alias("_kind"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = e.unionByName(p, allowMissingColumns=True).withColumn("last_known_ms", F.max("_event_ms").over(w))
    fresh = F.coalesce(F.col("_at") - F.col("last_known_ms") <= view.ttl_ms, F.lit(False))
    return both.filter(F.col(ROW).isNotNull()).select(ROW, "last_known_ms", fresh.alias("is_fresh"))


def training_features(events: DataFrame, view: FeatureView, probes: DataFrame, semantics: Semantics = Semantics.KNOWN, strategy: Strategy = Strategy.FRAME, apply_ttl: bool = True) -> DataFrame:
    """The point-in-time training set: the probes' columns, [last_known_ms, is_fresh], features. With
    apply_ttl all features of a stale row are null. KNOWN always goes by JOIN."""
    rows = probe_frame(probes, view)
    if semantics is Semantics.KNOWN or strategy is Strategy.JOIN:
        values = join_features(events, view, rows, semantics)
    else:
        values = tiled_features(events, view, rows, strategy)
    out = rows.join(values, ROW)
    if not apply_ttl:
        return out
    fresh = entity_freshness(events, view, rows, semantics)
    kept = [c for c in rows.columns]
    return out.join(fresh, ROW).select(*kept, "last_known_ms", "is_fresh", *[F.when(F.col("is_fresh"), F.col(n)).alias(n) for n in view.feature_names])


def backfill_features(events: DataFrame, view: FeatureView, probes: DataFrame, strategy: Strategy = Strategy.FRAME) -> DataFrame:
    """Event-time features without staleness rules."""
    return training_features(events, view, probes, Semantics.EVENT_TIME, strategy, apply_ttl=False)


def known_features(events: DataFrame, view: FeatureView, probes: DataFrame) -> DataFrame:
    """Strictly known features, long: row id, feature_name, value."""
    values = join_features(events, view, probe_frame(probes, view), Semantics.KNOWN)
    return values.unpivot(ROW, list(view.feature_names), "feature_name", "value")
