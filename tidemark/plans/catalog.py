"""The library's queries by name, and the SQL that checks them.

Values are rounded where sums of doubles may differ in their last places: sums to 4, averages to 6
places. Times are given as epoch milliseconds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..definitions import FeatureView, Function, feature_specs, tile_specs
from ..functions.windowing import align_down, effective_start, retention_start, tile_bounds
from ..operators import asof, leakage, numbering, online, skew, statistics, tiles
from ..operators.asof import ROW, Semantics, Strategy
from ..sources import events as ev
from ..sources.session import materialize, scratch
from . import oracle as o
from . import views as v

EVENT, KNOWN = Semantics.EVENT_TIME, Semantics.KNOWN
HOUR_MS, DAY_MS = 3600000, 86400000
SAMPLE = 400
_HASH = "((entity_row_id * 2654435761) % 4294967296)"


def tidy(df: DataFrame, view: FeatureView) -> DataFrame:
    """Rounded features; adding zero turns -0.0 into 0.0."""
    places = {f.name: {Function.SUM: 4, Function.AVG: 6}.get(f.function) for f in feature_specs(view)}
    return df.select(*[F.round(F.col(c), places[c]).__add__(F.lit(0.0)).alias(c) if places.get(c) else F.col(c) for c in df.columns])


def bare(df: DataFrame, view: FeatureView) -> DataFrame:
    """Row id, keys, time, [freshness], features."""
    fresh = [c for c in ("last_known_ms", "is_fresh") if c in df.columns]
    return df.select(ROW, *view.join_keys, "as_of_ms", *fresh, *view.feature_names)


def vectors(spark, sf_dir, view, semantics, strategy, ttl, late: int = 1) -> DataFrame:
    e, p = ev.engagement(spark, sf_dir, late), ev.probes(spark, sf_dir)
    return asof.training_features(e, view, p, semantics, strategy, apply_ttl=ttl)


def _plain(view, semantics=EVENT, strategy=Strategy.FRAME, ttl=False):
    return lambda spark, sf_dir: tidy(bare(vectors(spark, sf_dir, view, semantics, strategy, ttl), view), view)


# ---- sources and arithmetic ---------------------------------------------------------------------


def q_raw_events(spark, sf_dir):
    return ev.engagement(spark, sf_dir)


def q_arrival_order(spark, sf_dir):
    e = ev.engagement(spark, sf_dir).select("event_id", "created_ms")
    return numbering.number_rows(e, ["created_ms", "event_id"], "arrival_rank")


def q_row_ids(spark, sf_dir):
    p = ev.probes(spark, sf_dir).select("user_id", "as_of_ms", F.col(ROW).alias("probe_id"))
    return numbering.number_rows(p, ["user_id", "as_of_ms", "probe_id"], ROW)


def q_window_bounds(spark, sf_dir):
    p = ev.probes(spark, sf_dir)
    t = F.col("as_of_ms")
    cols = []
    for name, w, g in (("1h", HOUR_MS, 300000), ("1d", DAY_MS, HOUR_MS), ("7d", 7 * DAY_MS, HOUR_MS)):
        lo, hi = tile_bounds(t, w, g)
        cols += [effective_start(t, w, g).alias(f"eff_start_{name}"), align_down(t, g).alias(f"head_lo_{name}"), lo.alias(f"lo_{name}"), hi.alias(f"hi_{name}")]
    return p.select(ROW, "as_of_ms", *cols)


def q_retention(spark, sf_dir):
    p = ev.probes(spark, sf_dir).select(ROW, "as_of_ms")
    cols = [F.struct(F.lit(t.basename).alias("agg_name"), F.lit(t.grid_ms).cast("long").alias("granularity_ms"), retention_start(F.col("as_of_ms"), t.retention_ms, t.grid_ms).alias("first_tile")) for t in tile_specs(v.USER_ENGAGEMENT)]
    return p.select(ROW, F.explode(F.array(*cols)).alias("r")).select(ROW, "r.*")


def q_feature_grid(spark, sf_dir):
    return asof.feature_grid(ev.probes(spark, sf_dir), v.USER_ENGAGEMENT)


def _tiles_out(df: DataFrame) -> DataFrame:
    s0 = F.when(F.col("agg_name").endswith("_max"), F.col("s0")).otherwise(F.round("s0", 4) + 0.0)
    return df.withColumn("tile_start_ms", F.unix_millis("tile_start")).drop("tile_start").withColumn("s0", s0)


def q_tiles_user(spark, sf_dir):
    return _tiles_out(tiles.build_tiles(ev.engagement(spark, sf_dir), v.USER_ENGAGEMENT))


def q_tiles_item(spark, sf_dir):
    return _tiles_out(tiles.build_tiles(ev.engagement(spark, sf_dir), v.ITEM_ENGAGEMENT))


def q_head_state(spark, sf_dir):
    h = asof.head_states(ev.engagement(spark, sf_dir), v.USER_ENGAGEMENT, ev.probes(spark, sf_dir), HOUR_MS)
    return h.select(ROW, (F.round("watch_seconds_sum_0", 4) + 0.0).alias("watch_seconds_sum"), F.col("count_0").alias("n"), F.col("watch_seconds_avg_1").alias("n_watched"), F.col("liked_sum_0").alias("liked_sum"))


def q_rollup(spark, sf_dir):
    """From a stored tile table: written, read back, merged with heads."""
    e, p, view = ev.engagement(spark, sf_dir), ev.probes(spark, sf_dir), v.USER_ENGAGEMENT
    path = scratch(spark, "tiles")
    tiles.write_tiles(tiles.build_tiles(e, view), path)
    values = asof.tiled_features(e, view, p, Strategy.RANGE, tiles.read_tiles(spark, path))
    return tidy(bare(p.join(values, ROW), view), view)


# ---- as-of features -----------------------------------------------------------------------------


def q_orders_minmax(spark, sf_dir):
    e, p = ev.order_events(spark, sf_dir), ev.order_probes(spark, sf_dir)
    return tidy(bare(asof.backfill_features(e, v.CUSTOMER_ORDERS, p), v.CUSTOMER_ORDERS), v.CUSTOMER_ORDERS)


def q_orders_known(spark, sf_dir):
    e, p = ev.order_events(spark, sf_dir), ev.order_probes(spark, sf_dir)
    return tidy(bare(asof.training_features(e, v.CUSTOMER_ORDERS, p, KNOWN), v.CUSTOMER_ORDERS), v.CUSTOMER_ORDERS)


def _freshness(semantics):
    return lambda spark, sf_dir: asof.entity_freshness(ev.engagement(spark, sf_dir), v.USER_DAY, ev.probes(spark, sf_dir), semantics)


# ---- leakage ------------------------------------------------------------------------------------


def _labelled(spark, sf_dir):
    e, p = ev.engagement(spark, sf_dir), ev.probes(spark, sf_dir).select(ROW, "user_id", "as_of_ms")
    return leakage.label_rows(e, v.USER_ENGAGEMENT, p, HOUR_MS * 6, F.col("kind") == "watch")


def q_label_sample(spark, sf_dir):
    e, p = ev.engagement(spark, sf_dir), ev.probes(spark, sf_dir).select(ROW, "user_id", "as_of_ms")
    return leakage.label_rows(e, v.USER_ENGAGEMENT, leakage.sample_rows(p, SAMPLE), HOUR_MS * 6, F.col("kind") == "watch")


def _differences(spark, sf_dir, late: int = 1):
    strict, leaky = (vectors(spark, sf_dir, v.USER_ENGAGEMENT, s, Strategy.FRAME, True, late) for s in (KNOWN, EVENT))
    return leakage.vector_differences(strict, leaky, v.USER_ENGAGEMENT)


def _rates(spark, sf_dir, late: int = 1):
    r = leakage.disagreement_rates(_differences(spark, sf_dir, late), v.USER_ENGAGEMENT)
    return r.select("rows", *[F.round(c, 9).alias(c) for c in r.columns if c != "rows"])


def q_leak_training_set(spark, sf_dir):
    strict = bare(vectors(spark, sf_dir, v.USER_ENGAGEMENT, KNOWN, Strategy.JOIN, True), v.USER_ENGAGEMENT)
    return tidy(strict.join(_labelled(spark, sf_dir).select(ROW, "label"), ROW), v.USER_ENGAGEMENT)


def q_temporal_split(spark, sf_dir):
    return leakage.temporal_split(ev.probes(spark, sf_dir).select(ROW, "as_of_ms"))


def q_auc(spark, sf_dir):
    """How well each strict feature alone ranks the labels; ranks tie where values are equal."""
    view = v.USER_ENGAGEMENT
    rows = materialize(tidy(bare(vectors(spark, sf_dir, view, KNOWN, Strategy.JOIN, True), view), view).join(_labelled(spark, sf_dir).select(ROW, "label"), ROW), "scored")
    parts = [statistics.auc(rows, n, "label").select(F.lit(n).alias("feature_name"), F.round("auc", 9).alias("auc")) for n in ("count_1h", "count_1d", "watch_seconds_sum_7d")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_leak_auc(spark, sf_dir):
    labels = leakage.temporal_split(_labelled(spark, sf_dir)).select(ROW, "label", "is_train")
    sets = {s: materialize(bare(vectors(spark, sf_dir, v.USER_ENGAGEMENT, s, Strategy.FRAME, True), v.USER_ENGAGEMENT).join(labels, ROW), "auc") for s in (KNOWN, EVENT)}
    return leakage.auc_table(sets[KNOWN], sets[EVENT], v.USER_ENGAGEMENT)


def q_lateness_quantiles(spark, sf_dir):
    e = ev.engagement(spark, sf_dir).select("kind", (F.col("created_ms") - F.col("event_ms")).alias("lateness_ms"))
    return statistics.nearest_rank(e, "lateness_ms", "kind")


def q_lateness_sweep(spark, sf_dir):
    parts = [_rates(spark, sf_dir, late).withColumn("scale", F.lit(late)) for late in (0, 1, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- serving log and skew -----------------------------------------------------------------------


def _served_entries(spark, sf_dir, view=v.USER_ENGAGEMENT) -> DataFrame:
    """Event-time vectors as served; count_1d lacks its head on every second probe. A window as of the
    start of T's tile is exactly the window as of T without its head."""
    e, p = ev.engagement(spark, sf_dir), ev.probes(spark, sf_dir).select(ROW, "user_id", "as_of_ms")
    whole = asof.training_features(e, view, p, EVENT, Strategy.FRAME)
    cut = asof.backfill_features(e, view, p.withColumn("as_of_ms", align_down(F.col("as_of_ms"), HOUR_MS)), Strategy.FRAME)
    cut = cut.select(ROW, F.col("count_1d").alias("_cut"))
    rows = whole.join(cut, ROW)
    # alternate probes by a hash bit, since ids are multiples of five
    half = (F.col(ROW) / 5).cast("long") % 2 == 0
    served = F.when(half & F.col("is_fresh"), F.col("_cut")).otherwise(F.col("count_1d"))
    rows = rows.withColumn("count_1d", served)
    features = F.map_from_arrays(F.array(*[F.lit(n) for n in view.feature_names]), F.array(*[F.col(n) for n in view.feature_names]))
    return rows.select(
        F.concat(F.lit("log-"), F.col(ROW).cast("string")).alias("log_id"),
        F.lit(view.name).alias("view_name"),
        F.lit(view.version).alias("view_version"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("entity_keys"),
        F.col("as_of_ms").alias("request_ts_ms"),
        (F.col("as_of_ms") + 7).alias("served_at_ms"),
        features.alias("features"),
    )


def _log(spark, sf_dir) -> DataFrame:
    return skew.explode_log(_served_entries(spark, sf_dir))


def _log_out(df: DataFrame) -> DataFrame:
    return df.select("log_id", "view_name", "view_version", F.col("entity_keys")["user_id"].alias("user_id"), F.unix_millis("request_ts").alias("request_ts_ms"), F.unix_millis("served_at_ts").alias("served_at_ms"), "feature_name", (F.round("value", 4) + 0.0).alias("value"))


def q_serving_log_explode(spark, sf_dir):
    return _log_out(_log(spark, sf_dir))


def q_served_pivot(spark, sf_dir):
    return tidy(skew.served_wide(_log(spark, sf_dir), v.USER_ENGAGEMENT), v.USER_ENGAGEMENT)


def q_entity_frame(spark, sf_dir):
    return skew.entity_frame(skew.served_wide(_log(spark, sf_dir), v.USER_ENGAGEMENT), v.USER_ENGAGEMENT)


def _pairs(spark, sf_dir) -> DataFrame:
    log = materialize(_log(spark, sf_dir), "log")
    return skew.compared(ev.engagement(spark, sf_dir), v.USER_ENGAGEMENT, log)


def q_skew_buckets(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("feature_name", "bucket").agg(F.count(F.lit(1)).alias("n"))


def q_skew_report(spark, sf_dir):
    r = skew.skew_report(materialize(_pairs(spark, sf_dir), "pairs"))
    return r.select("feature_name", "rows", *skew.BUCKETS, *[F.round(c, 6).alias(c) for c in ("mismatch_rate", "null_rate_delta")])


def _sides(spark, sf_dir):
    e = ev.engagement(spark, sf_dir).filter("watch_seconds IS NOT NULL").select("user_id", "event_id", F.col("watch_seconds").alias("x"), (F.col("user_id") % 3).alias("g"))
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


def q_psi(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return statistics.population_stability_index(a, b, "x", ["g"]).select("g", F.round("psi", 6).alias("psi"))


def q_ks(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return statistics.ks_statistic(a, b, "x", ["g"]).select("g", F.round("ks", 9).alias("ks"))


def q_latency_stats(spark, sf_dir):
    e = ev.engagement(spark, sf_dir).select((F.col("created_ms") - F.col("event_ms")).cast("double").alias("ms"))
    return statistics.latency_summary(e, "ms").select("count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median", "p90", "p99", "mad")])


# ---- streaming and online -----------------------------------------------------------------------

WIRE = "event_id BIGINT, kind STRING, user_id BIGINT, item_id BIGINT, event_ms BIGINT, created_ms BIGINT, watch_seconds DOUBLE, liked INT, shared INT, event_type STRING"


def _topic(spark, df: DataFrame, files: int = 3) -> str:
    """Messages as JSON lines in a few files, which a stream reads one after another."""
    path = scratch(spark, "topic")
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).repartition(files).write.text(path)
    return path


def q_stream_landing(spark, sf_dir):
    values = streaming.source(spark, _topic(spark, ev.engagement(spark, sf_dir)))
    out, checkpoint = scratch(spark, "landed"), scratch(spark, "checkpoint")
    for _ in range(2):  # a restart on the same checkpoint adds nothing
        streaming.land_events(spark, values, WIRE, out, checkpoint)
    return spark.read.parquet(out).drop("batch")


def _streamed(spark, topic: str, *views: FeatureView) -> str:
    out = scratch(spark, "tiles")
    streaming.keep_tiles(spark, streaming.source(spark, topic), WIRE, views, out, scratch(spark, "checkpoint"))
    return out


def _long_streamed(spark, path: str, view: FeatureView) -> DataFrame:
    parts = [streaming.long_tiles(streaming.current_tiles(spark, path, view, g), view, g) for g in tiles.by_grid(view)]
    return reduce(DataFrame.unionByName, parts)


def q_stream_tiles(spark, sf_dir):
    path = _streamed(spark, _topic(spark, ev.engagement(spark, sf_dir)), v.USER_ENGAGEMENT)
    return _tiles_out(_long_streamed(spark, path, v.USER_ENGAGEMENT))


def q_stream_fanout(spark, sf_dir):
    """One consumer, two views with different keys."""
    path = _streamed(spark, _topic(spark, ev.engagement(spark, sf_dir)), v.USER_ENGAGEMENT, v.ITEM_ENGAGEMENT)
    out = []
    for view in (v.USER_ENGAGEMENT, v.ITEM_ENGAGEMENT):
        (key,) = view.join_keys
        rows = _tiles_out(_long_streamed(spark, path, view))
        out.append(rows.withColumn(key, F.col(key).cast("string")).withColumnRenamed(key, "entity").withColumn("view_name", F.lit(view.name)))
    return out[0].unionByName(out[1])


def q_stream_expiry(spark, sf_dir):
    """Tiles after a compaction that expires as of the newest event. The newest batch has the newest
    events and is not compacted, so it is expired on reading."""
    e, view = ev.engagement(spark, sf_dir), v.USER_ENGAGEMENT
    path = _streamed(spark, _topic(spark, e), view)
    now = e.agg(F.max("event_ms")).first()[0]
    streaming.compact(spark, path, [view], now)
    return _tiles_out(tiles.expire_tiles(_long_streamed(spark, path, view), view, now))


def q_stream_feature_log(spark, sf_dir):
    values = streaming.source(spark, _topic(spark, _served_entries(spark, sf_dir)))
    out = scratch(spark, "log")
    streaming.land_log(spark, values, out, scratch(spark, "checkpoint"))
    return _log_out(spark.read.parquet(out).drop("batch"))


def q_stream_redelivery(spark, sf_dir):
    """Every message twice: tile counts double, and landing with a long enough delay keeps one each."""
    e, view = ev.engagement(spark, sf_dir), v.USER_ENGAGEMENT
    topic = _topic(spark, e.unionByName(e))
    path = _streamed(spark, topic, view)
    counted = [streaming.current_tiles(spark, path, view, g).agg(F.sum("count_0").cast("long").alias("counted")).select(F.lit(f"tiles_{g}").alias("sink"), "counted") for g in tiles.by_grid(view)]
    out = scratch(spark, "landed")
    streaming.land_events(spark, streaming.source(spark, topic), WIRE, out, scratch(spark, "checkpoint"), dedup=("event_id", "60 days"))
    once = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("counted"))
    return reduce(DataFrame.unionByName, [*counted, once.select(F.lit("landed").alias("sink"), "counted")])


def q_online_vector(spark, sf_dir):
    """Vectors read from streamed tile states and raw heads, staleness applied."""
    e, p, view = ev.engagement(spark, sf_dir), ev.probes(spark, sf_dir).select(ROW, "user_id", "as_of_ms"), v.USER_DAY
    topic = _topic(spark, e)
    path = _streamed(spark, topic, view)
    long = materialize(_long_streamed(spark, path, view), "tiles")
    last = streaming.current_tiles(spark, path, view, min(tiles.by_grid(view))).select("user_id", F.col("_tile").alias("tile_index"), "last_event_ms")
    return tidy(bare(online.online_vectors(long, last, e, view, p), view), view)


_QUERIES = {
    "q_pit_join": _plain(v.USER_ENGAGEMENT, strategy=Strategy.JOIN),
    "q_pit_prefix": _plain(v.USER_ENGAGEMENT, strategy=Strategy.PREFIX),
    "q_pit_range": _plain(v.USER_ENGAGEMENT, strategy=Strategy.RANGE),
    "q_pit_frame": _plain(v.USER_ENGAGEMENT),
    "q_pit_item": _plain(v.ITEM_ENGAGEMENT),
    "q_pit_item_prefix": _plain(v.ITEM_ENGAGEMENT, strategy=Strategy.PREFIX),
    "q_composite_key": _plain(v.USER_KIND),
    "q_pit_known": _plain(v.USER_ENGAGEMENT, KNOWN),
    "q_pit_item_known": _plain(v.ITEM_ENGAGEMENT, KNOWN),
    "q_freshness_known": _freshness(KNOWN),
    "q_freshness_event": _freshness(EVENT),
    "q_training_known": _plain(v.USER_ENGAGEMENT, KNOWN, ttl=True),
    "q_training_event": _plain(v.USER_ENGAGEMENT, EVENT, ttl=True),
    "q_training_known_1d": _plain(v.USER_DAY, KNOWN, ttl=True),
    "q_training_event_1d": _plain(v.USER_DAY, EVENT, ttl=True),
    "q_leak_row_diff": _differences,
    "q_leak_rates": _rates,
}
for _f in (q_raw_events, q_arrival_order, q_row_ids, q_window_bounds, q_retention, q_feature_grid, q_tiles_user, q_tiles_item, q_head_state, q_rollup, q_orders_minmax, q_orders_known, q_label_sample, q_leak_training_set, q_temporal_split, q_auc, q_leak_auc, q_lateness_quantiles, q_lateness_sweep, q_serving_log_explode, q_served_pivot, q_entity_frame, q_skew_buckets, q_skew_report, q_psi, q_ks, q_latency_stats, q_stream_landing, q_stream_tiles, q_stream_fanout, q_stream_expiry, q_stream_feature_log, q_stream_redelivery, q_online_vector):
    _QUERIES[_f.__name__] = _f


def queries():
    return dict(_QUERIES)


# ---- SQL ----------------------------------------------------------------------------------------

_U = ("user_id",)
_FLAGS = [name for name, *_ in o.USER]


def _differs(a: str, b: str) -> str:
    return f"({a} IS DISTINCT FROM {b} AND ({a} IS NULL OR {b} IS NULL OR abs({a} - {b}) > 1e-9 * greatest(abs({a}), 1.0)))"


def _training(specs, ttl, known, keys=_U) -> tuple[str, str]:
    return o.features(specs, keys, known=known), o.freshness(keys, ttl, known=known)


def _gated(specs, ttl, known, body="{gated}", *more, late=1):
    vec, fresh = _training(specs, ttl, known)
    return o.with_(f"vec AS ({vec})", f"fr AS ({fresh})", *more, body=body.format(gated=o.gated("vec", "fr", specs, _U)), late=late)


def _diff_ctes() -> list[str]:
    out = []
    for tag, known in (("k", True), ("t", False)):
        vec, fresh = _training(o.USER, 7 * o.D, known)
        out += [f"vec_{tag} AS ({vec})", f"fr_{tag} AS ({fresh})", f"g_{tag} AS ({o.gated(f'vec_{tag}', f'fr_{tag}', o.USER, _U)})"]
    flags = ", ".join(f"{_differs(f'g_k.{n}', f'g_t.{n}')} AS {n}" for n in _FLAGS)
    any_ = " OR ".join(_differs(f"g_k.{n}", f"g_t.{n}") for n in _FLAGS)
    return [*out, f"diff AS (SELECT entity_row_id, {flags}, ({any_}) AS any_differs FROM g_k JOIN g_t USING (entity_row_id))"]


def _rates_sql(extra: str = "") -> str:
    cols = ", ".join(f"round(count(CASE WHEN {n} THEN 1 END) / CAST(count(*) AS DOUBLE), 9) AS {n}" for n in [*_FLAGS, "any_differs"])
    return f"SELECT count(*) AS rows, {cols}{extra} FROM diff"


_LABEL = f"SELECT p.entity_row_id, p.user_id, p.as_of_ms, CAST(count(e.event_id) > 0 AS INTEGER) AS label FROM {{p}} p LEFT JOIN engagement e ON e.user_id = p.user_id AND e.kind = 'watch' AND e.event_ms > p.as_of_ms AND e.event_ms <= p.as_of_ms + {6 * o.H} GROUP BY p.entity_row_id, p.user_id, p.as_of_ms"


def _auc_sql(names: tuple[str, ...]) -> str:
    """Ranks with ties halved, from the sum of the positives' ranks."""
    one = lambda n: f"SELECT '{n}' AS feature_name, round((sum(CASE WHEN label = 1 THEN k END) - np * (np + 1) / 2.0) / nullif(np * nn, 0), 9) AS auc FROM (SELECT label, rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0 AS k, CAST(sum(label) OVER () AS DOUBLE) AS np, CAST(sum(1 - label) OVER () AS DOUBLE) AS nn FROM scored WHERE {n} IS NOT NULL) GROUP BY np, nn"
    scored = "scored AS (SELECT g.*, l.label FROM ({gated}) g JOIN lab l USING (entity_row_id))"
    vec, fresh = _training(o.USER, 7 * o.D, True)
    gated = o.gated("vec", "fr", o.USER, _U)
    return o.with_(f"vec AS ({vec})", f"fr AS ({fresh})", f"lab AS ({_LABEL.format(p='probes')})", scored.format(gated=gated), body=" UNION ALL ".join(one(n) for n in names))


def _served_ctes() -> list[str]:
    vec, fresh = _training(o.USER, 7 * o.D, False)
    cut = o.features(o.USER, _U, without_head=("count_1d",))
    cols = ", ".join(f"g.{n}" if n != "count_1d" else "CASE WHEN (g.entity_row_id // 5) % 2 = 0 AND g.is_fresh THEN c.count_1d ELSE g.count_1d END AS count_1d" for n in _FLAGS)
    return [f"vec AS ({vec})", f"fr AS ({fresh})", f"gt AS ({o.gated('vec', 'fr', o.USER, _U)})", f"ct AS ({cut})", f"served AS (SELECT g.entity_row_id, g.user_id, g.as_of_ms, {cols} FROM gt g JOIN ct c USING (entity_row_id))"]


def _log_sql() -> str:
    return " UNION ALL ".join(f"SELECT 'log-' || entity_row_id AS log_id, 'user_engagement' AS view_name, 1 AS view_version, CAST(user_id AS VARCHAR) AS user_id, as_of_ms AS request_ts_ms, as_of_ms + 7 AS served_at_ms, '{n}' AS feature_name, round({n}, 4) + 0.0 AS value FROM served" for n in _FLAGS)


def _pair_ctes() -> list[str]:
    vec, fresh = _training(o.USER, 7 * o.D, True)
    same = lambda a, b: f"coalesce(abs({a} - {b}) <= greatest(1e-6 * greatest(abs({a}), abs({b})), 1e-9), false)"
    long = " UNION ALL ".join(f"SELECT '{n}' AS feature_name, s.{n} AS served, t.{n} AS tiled, k.{n} AS known FROM served s JOIN gt t USING (entity_row_id) JOIN kt k USING (entity_row_id)" for n in _FLAGS)
    bucket = f"CASE WHEN served IS NULL AND tiled IS NULL THEN 'match' WHEN served IS NULL OR tiled IS NULL THEN 'one_side_null' WHEN {same('served', 'tiled')} THEN 'match' WHEN {same('tiled', 'known')} THEN 'partial_head_tile' ELSE 'late_arriving_data' END"
    return [*_served_ctes(), f"kv AS ({vec})", f"kf AS ({fresh})", f"kt AS ({o.gated('kv', 'kf', o.USER, _U)})", f"long AS ({long})", f"pairs AS (SELECT *, {bucket} AS bucket FROM long)"]


_SIDES = "s AS (SELECT user_id % 3 AS g, watch_seconds AS v, event_id % 2 = 0 AS a FROM engagement WHERE watch_seconds IS NOT NULL)"


def oracle_sql():
    p3 = (("1h", o.H, o.M5), ("1d", o.D, o.H), ("7d", 7 * o.D, o.H))
    bounds = ", ".join(f"((as_of_ms - {w}) // {g}) * {g} AS eff_start_{n}, (as_of_ms // {g}) * {g} AS head_lo_{n}, (as_of_ms - {w}) // {g} AS lo_{n}, as_of_ms // {g} AS hi_{n}" for n, w, g in p3)
    base = lambda name, col: "count" if col is None else f"{col}_{name}"
    longest: dict = {}
    for _, fn, col, w, g in o.USER:
        longest[(base(fn, col), g)] = max(w, longest.get((base(fn, col), g), 0))
    retention = " UNION ALL ".join(f"SELECT entity_row_id, '{b}' AS agg_name, CAST({g} AS BIGINT) AS granularity_ms, (as_of_ms - {w}) // {g} AS first_tile FROM probes" for (b, g), w in longest.items())
    grid = " UNION ALL ".join(
        f"SELECT entity_row_id, user_id, as_of_ms, '{n}' AS feature_name, '{base(fn, col)}' AS agg_name, CAST({g} AS BIGINT) AS granularity_ms, (as_of_ms - {w}) // {g} AS lo, as_of_ms // {g} AS hi, ((as_of_ms - {w}) // {g}) * {g} AS eff_start, (as_of_ms // {g}) * {g} AS head_lo FROM probes"
        for n, fn, col, w, g in o.USER
    )
    head = f"SELECT p.entity_row_id, round(sum(e.watch_seconds), 4) + 0.0 AS watch_seconds_sum, CAST(count(*) AS DOUBLE) AS n, CAST(nullif(count(e.watch_seconds), 0) AS DOUBLE) AS n_watched, CAST(sum(e.liked) AS DOUBLE) AS liked_sum FROM probes p JOIN engagement e ON e.user_id = p.user_id AND e.event_ms // {o.H} = p.as_of_ms // {o.H} AND e.event_ms < p.as_of_ms GROUP BY p.entity_row_id"
    user = o.with_(body=o.features(o.USER, _U))
    item = o.with_(body=o.features(o.ITEM, ("item_id",)))
    sample = f"sampled AS (SELECT * FROM probes ORDER BY {_HASH}, entity_row_id LIMIT {SAMPLE})"
    out = {
        "q_raw_events": o.with_(body="SELECT event_id, kind, user_id, item_id, event_ms, created_ms, watch_seconds, liked, shared, event_type FROM engagement"),
        "q_arrival_order": o.with_(body="SELECT event_id, created_ms, row_number() OVER (ORDER BY created_ms, event_id) AS arrival_rank FROM engagement"),
        "q_row_ids": o.with_(body="SELECT user_id, as_of_ms, entity_row_id AS probe_id, row_number() OVER (ORDER BY user_id, as_of_ms, probes.entity_row_id) AS entity_row_id FROM probes"),
        "q_window_bounds": o.with_(body=f"SELECT entity_row_id, as_of_ms, {bounds} FROM probes"),
        "q_retention": o.with_(body=retention),
        "q_feature_grid": o.with_(body=grid),
        "q_tiles_user": o.with_(body=o.tiles(o.USER, "user_id")),
        "q_tiles_item": o.with_(body=o.tiles(o.ITEM, "item_id")),
        "q_head_state": o.with_(body=head),
        "q_rollup": user,
        "q_pit_join": user,
        "q_pit_prefix": user,
        "q_pit_range": user,
        "q_pit_frame": user,
        "q_pit_item": item,
        "q_pit_item_prefix": item,
        "q_orders_minmax": f"WITH {o.ORDERS} " + o.features(o.ORDER, ("o_custkey",), "oe", "op"),
        "q_orders_known": f"WITH {o.ORDERS}, vec AS ({o.features(o.ORDER, ('o_custkey',), 'oe', 'op', known=True)}), fr AS ({o.freshness(('o_custkey',), 728 * o.D, 'oe', 'op', known=True)}) " + o.gated("vec", "fr", o.ORDER, ("o_custkey",)),
        "q_composite_key": o.with_(body=o.features(o.USER, ("user_id", "event_type"))),
        "q_pit_known": o.with_(body=o.features(o.USER, _U, known=True)),
        "q_pit_item_known": o.with_(body=o.features(o.ITEM, ("item_id",), known=True)),
        "q_freshness_known": o.with_(body=o.freshness(_U, o.D, known=True)),
        "q_freshness_event": o.with_(body=o.freshness(_U, o.D)),
        "q_training_known": _gated(o.USER, 7 * o.D, True),
        "q_training_event": _gated(o.USER, 7 * o.D, False),
        "q_training_known_1d": _gated(o.DAY_USER, o.D, True),
        "q_training_event_1d": _gated(o.DAY_USER, o.D, False),
        "q_label_sample": o.with_(sample, body=_LABEL.format(p="sampled")),
        "q_leak_row_diff": o.with_(*_diff_ctes(), body="SELECT * FROM diff"),
        "q_leak_rates": o.with_(*_diff_ctes(), body=_rates_sql()),
        "q_leak_training_set": _gated(o.USER, 7 * o.D, True, "SELECT g.*, l.label FROM ({gated}) g JOIN lab l USING (entity_row_id)", f"lab AS ({_LABEL.format(p='probes')})"),
        "q_auc": _auc_sql(("count_1h", "count_1d", "watch_seconds_sum_7d")),
        "q_temporal_split": o.with_("r AS (SELECT *, row_number() OVER (ORDER BY as_of_ms, entity_row_id) AS k, count(*) OVER () AS n FROM probes)", "s AS (SELECT min(as_of_ms) AS split_ms FROM r WHERE k >= n * 0.7)", body="SELECT entity_row_id, as_of_ms, split_ms, as_of_ms < split_ms AS is_train FROM probes, s"),
        "q_lateness_quantiles": o.with_("r AS (SELECT kind, created_ms - event_ms AS x, row_number() OVER (PARTITION BY kind ORDER BY created_ms - event_ms) - 1 AS k, count(*) OVER (PARTITION BY kind) AS n FROM engagement)", body="SELECT kind, max(CASE WHEN k = n // 2 THEN x END) AS p50, max(CASE WHEN k = least(n - 1, CAST(floor(CAST(n AS DOUBLE) * 0.99) AS BIGINT)) THEN x END) AS p99, max(x) AS max FROM r GROUP BY kind"),
        "q_lateness_sweep": " UNION ALL ".join(f"SELECT * FROM ({o.with_(*_diff_ctes(), body=_rates_sql(f', {late} AS scale'), late=late) if late else _never_late()})" for late in (0, 1, 4)),
        "q_serving_log_explode": o.with_(*_served_ctes(), body=_log_sql()),
        "q_stream_feature_log": o.with_(*_served_ctes(), body=_log_sql()),
        "q_served_pivot": o.with_(*_served_ctes(), body="SELECT 'log-' || entity_row_id AS log_id, user_id, as_of_ms, " + ", ".join(_FLAGS) + " FROM served"),
        "q_entity_frame": o.with_(body="SELECT DISTINCT user_id, as_of_ms FROM probes"),
        "q_skew_buckets": o.with_(*_pair_ctes(), body="SELECT feature_name, bucket, count(*) AS n FROM pairs GROUP BY feature_name, bucket"),
        "q_skew_report": o.with_(*_pair_ctes(), body="SELECT feature_name, count(*) AS rows, " + ", ".join(f"count(CASE WHEN bucket = '{b}' THEN 1 END) AS {b}" for b in skew.BUCKETS) + ", round(count(CASE WHEN bucket <> 'match' THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS mismatch_rate, round(count(CASE WHEN served IS NULL THEN 1 END) / CAST(count(*) AS DOUBLE) - count(CASE WHEN tiled IS NULL THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS null_rate_delta FROM pairs GROUP BY feature_name"),
        "q_psi": o.with_(_SIDES, "r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM s)", "q AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS i)", "edges AS (SELECT DISTINCT r.g, r.v FROM r, q WHERE r.k = CAST(floor((q.i / 10.0::DOUBLE) * (r.n - 1)) AS BIGINT))", "binned AS (SELECT s.g, s.a, (SELECT count(*) FROM edges e WHERE e.g = s.g AND e.v < s.v) AS bin FROM s)", "c AS (SELECT g, bin, count(CASE WHEN a THEN 1 END) AS na, count(CASE WHEN NOT a THEN 1 END) AS nb FROM binned GROUP BY g, bin)", "t AS (SELECT g, sum(na) AS ta, sum(nb) AS tb FROM c GROUP BY g)", "h AS (SELECT c.g, ta, tb, greatest(na / CAST(ta AS DOUBLE), 1e-6) AS x, greatest(nb / CAST(tb AS DOUBLE), 1e-6) AS y FROM c JOIN t USING (g))", body="SELECT g, CASE WHEN max(ta + tb) >= 20 THEN round(sum((y - x) * ln(y / x)), 6) END AS psi FROM h GROUP BY g"),
        "q_ks": o.with_(_SIDES, "c AS (SELECT g, v, count(CASE WHEN a THEN 1 END) AS na, count(CASE WHEN NOT a THEN 1 END) AS nb FROM s GROUP BY g, v)", "f AS (SELECT g, sum(na) OVER w / CAST(sum(na) OVER (PARTITION BY g) AS DOUBLE) AS fa, sum(nb) OVER w / CAST(sum(nb) OVER (PARTITION BY g) AS DOUBLE) AS fb FROM c WINDOW w AS (PARTITION BY g ORDER BY v))", body="SELECT g, round(max(abs(fa - fb)), 9) AS ks FROM f GROUP BY g"),
        "q_latency_stats": o.with_("l AS (SELECT CAST(created_ms - event_ms AS DOUBLE) AS ms FROM engagement)", "m AS (SELECT quantile_cont(ms, 0.5) AS med FROM l)", "d AS (SELECT quantile_cont(abs(ms - med), 0.5) AS mad FROM l, m)", body='SELECT count(*) AS "count", round(min(ms), 6) AS "min", round(max(ms), 6) AS "max", round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.99), 6) AS p99, (SELECT round(mad, 6) FROM d) AS mad FROM l'),
        "q_stream_redelivery": f"SELECT 'tiles_{o.M5}' AS sink, 2 * count(*) AS counted FROM events UNION ALL SELECT 'tiles_{o.H}', 2 * count(*) FROM events UNION ALL SELECT 'landed', count(*) FROM events",
        "q_online_vector": _gated(o.DAY_USER, o.D, False),
    }
    first = " OR ".join(f"(agg_name = '{b}' AND granularity_ms = {g} AND tile_index >= (now - {w}) // {g})" for (b, g), w in longest.items())
    out["q_stream_expiry"] = f"SELECT t.* FROM ({out['q_tiles_user']}) t, (SELECT max(epoch_us(ts) // 1000) AS now FROM events) WHERE {first}"
    one = lambda view, key: f"SELECT '{view}' AS view_name, CAST({key} AS VARCHAR) AS entity, * EXCLUDE ({key}) FROM ({out[f'q_tiles_{key[:4]}']})"
    out["q_stream_fanout"] = f"{one('user_engagement', 'user_id')} UNION ALL BY NAME {one('item_engagement', 'item_id')}"
    return out | {"q_stream_landing": out["q_raw_events"], "q_stream_tiles": out["q_tiles_user"]}


def _never_late() -> str:
    """Scale 0: every event is known within 250 ms."""
    s = o.with_(*_diff_ctes(), body=_rates_sql(", 0 AS scale"))
    return s.replace("CASE WHEN event_id % 20 = 0 THEN (60000 + (event_id * 7919) % 21540000) * 1 ELSE (event_id * 31) % 251 END", "(event_id * 31) % 251")
