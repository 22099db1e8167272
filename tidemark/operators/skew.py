"""Skew between served vectors and recomputed ones, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..definitions import FeatureView
from .asof import ROW, Semantics, Strategy, training_features
from .numbering import number_rows
from .statistics import close, ks_of, psi_of, sides

REL, ABS = 1e-6, 1e-9
MATCH, ONE_SIDE, HEAD, LATE = "match", "one_side_null", "partial_head_tile", "late_arriving_data"
BUCKETS = (MATCH, ONE_SIDE, HEAD, LATE)
LOG_DDL = "log_id STRING, view_name STRING, view_version INT, entity_keys MAP<STRING, STRING>, request_ts_ms BIGINT, served_at_ms BIGINT, features MAP<STRING, DOUBLE>"


def build_log_entry(view: FeatureView, log_id: str, entity: dict, features: dict, request_ms: int, served_ms: int) -> dict:
    """A served vector as logged: exactly the view's features, all its keys, extra entity fields dropped."""
    if set(features) != set(view.feature_names):
        raise ValueError(f"features {sorted(set(features) ^ set(view.feature_names))} are missing or unknown")
    missing = [k for k in view.join_keys if k not in entity]
    if missing:
        raise ValueError(f"entity lacks {missing}")
    if served_ms < request_ms:
        raise ValueError("served before it was asked for")
    keys = {k: str(entity[k]) for k in view.join_keys}
    return {"log_id": log_id, "view_name": view.name, "view_version": view.version, "entity_keys": keys, "request_ts_ms": request_ms, "served_at_ms": served_ms, "features": dict(features)}


def explode_log(entries: DataFrame) -> DataFrame:
    """Log entries to one row for each feature; null values stay."""
    cols = ["log_id", "view_name", "view_version", "entity_keys"]
    long = entries.select(*cols, F.timestamp_millis("request_ts_ms").alias("request_ts"), F.timestamp_millis("served_at_ms").alias("served_at_ts"), F.explode("features").alias("feature_name", "value"))
    return long


def served_wide(log: DataFrame, view: FeatureView, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """log_id, keys, as_of_ms, features: the long log, turned by conditional maxima."""
    ms = F.unix_millis("request_ts")
    rows = log.filter((F.col("view_name") == view.name) & (F.col("view_version") == view.version))
    if from_ms is not None:
        rows = rows.filter(F.col("request_ts") >= F.timestamp_millis(F.lit(from_ms)))
    if to_ms is not None:
        rows = rows.filter(F.col("request_ts") <= F.timestamp_millis(F.lit(to_ms)))
    keys = [F.max(F.col("entity_keys")[e.join_key]).cast(e.key_type.value).alias(e.join_key) for e in view.entities]
    values = [F.max(F.when(F.col("feature_name") == n, F.col("value"))).alias(n) for n in view.feature_names]
    return rows.groupBy("log_id").agg(*keys, F.max(ms).alias("as_of_ms"), *values)


def entity_frame(served: DataFrame, view: FeatureView) -> DataFrame:
    return served.select(*view.join_keys, "as_of_ms").dropDuplicates()


def classify(served: Column, tiled: Column, known: Column) -> Column:
    """Why a served value differs: see the truth table in the tests."""
    same = lambda a, b: F.coalesce(close(a, b, REL, ABS), F.lit(False))
    return (
        F.when(served.isNull() & tiled.isNull(), MATCH)
        .when(served.isNull() | tiled.isNull(), ONE_SIDE)
        .when(same(served, tiled), MATCH)
        .when(same(tiled, known), HEAD)
        .otherwise(LATE)
    )


def compared(events: DataFrame, view: FeatureView, log: DataFrame, strategy: Strategy = Strategy.FRAME, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """One row for each served value: log_id, feature_name, served, tiled, known, bucket."""
    served = served_wide(log, view, from_ms, to_ms)
    on = [*view.join_keys, "as_of_ms"]
    probes = number_rows(entity_frame(served, view), on, ROW)
    names = view.feature_names
    vectors = {}
    for tag, semantics in (("tiled", Semantics.EVENT_TIME), ("known", Semantics.KNOWN)):
        v = training_features(events, view, probes, semantics, strategy)
        vectors[tag] = v.select(*on, F.struct(*names).alias(tag))
    rows = served.select("log_id", *on, F.struct(*names).alias("served")).join(vectors["tiled"], on).join(vectors["known"], on)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature_name"), *[F.col(t)[n].alias(t) for t in ("served", "tiled", "known")]) for n in names]))
    out = rows.select("log_id", each.alias("f")).select("log_id", "f.*")
    return out.withColumn("bucket", classify(F.col("served"), F.col("tiled"), F.col("known")))


def skew_report(pairs: DataFrame) -> DataFrame:
    """One row for each feature: counts by bucket, mismatch rate, change of null rate, PSI and KS."""
    n = F.count(F.lit(1))
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    report = pairs.groupBy("feature_name").agg(
        n.alias("rows"),
        *counts,
        (F.count_if(F.col("bucket") != MATCH) / n).alias("mismatch_rate"),
        (F.count_if(F.col("served").isNull()) / n - F.count_if(F.col("tiled").isNull()) / n).alias("null_rate_delta"),
    )
    served, tiled = (pairs.select("feature_name", F.col(c).alias("x")) for c in ("served", "tiled"))
    both = sides(tiled, served, "x", ["feature_name"])
    psi, ks = psi_of(both, ["feature_name"]), ks_of(both, ["feature_name"])
    return report.join(psi, "feature_name", "left").join(ks, "feature_name", "left")


def detect_skew(events: DataFrame, view: FeatureView, log: DataFrame, **how) -> DataFrame:
    return skew_report(compared(events, view, log, **how))


def worst(pairs: DataFrame) -> DataFrame:
    """The most frequent fault of each feature, if it has any."""
    bad = pairs.filter(F.col("bucket") != MATCH).groupBy("feature_name", "bucket").count()
    w = Window.partitionBy("feature_name").orderBy(F.desc("count"), "bucket")
    return bad.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
