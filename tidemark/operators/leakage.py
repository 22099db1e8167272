"""What leakage from late data costs: labels, disagreement of vectors, split, and model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..definitions import FeatureView
from ..sources.events import normal
from .asof import ROW
from .statistics import auc

REL = 1e-9
SPLIT = 0.7


def label_rows(events: DataFrame, view: FeatureView, probes: DataFrame, horizon_ms: int, positive: Column) -> DataFrame:
    """Adds label: 1 if a `positive` event of the entity lies in (T, T + horizon]. The join meets in
    time buckets of the horizon, so a heavy key is spread."""
    bucket = lambda ms: F.floor(ms / F.lit(horizon_ms)).cast("long")
    e = normal(events, view.source).filter(positive).select(*view.join_keys, F.col("_event_ms"), bucket(F.col("_event_ms")).alias("_bucket"))
    p = probes.select(ROW, *view.join_keys, "as_of_ms", F.explode(F.array(bucket(F.col("as_of_ms")), bucket(F.col("as_of_ms")) + 1)).alias("_bucket"))
    inside = (F.col("_event_ms") > F.col("as_of_ms")) & (F.col("_event_ms") <= F.col("as_of_ms") + horizon_ms)
    hits = p.join(e, [*view.join_keys, "_bucket"]).filter(inside).select(ROW).distinct()
    return probes.join(hits.withColumn("_hit", F.lit(1)), ROW, "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def sample_rows(probes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n probes in the order of a multiplicative hash of their ids; no matter how rows are dealt."""
    h = F.pmod((F.col(ROW) + seed) * F.lit(2654435761).cast("long"), F.lit(4294967296).cast("long"))
    return probes.orderBy(h, ROW).limit(n)


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality: one null, or apart by more than a relative tolerance."""
    apart = F.abs(a - b) > REL * F.greatest(F.abs(a), F.lit(1.0))
    return ~a.eqNullSafe(b) & (a.isNull() | b.isNull() | apart)


def vector_differences(strict: DataFrame, leaky: DataFrame, view: FeatureView) -> DataFrame:
    """One row for each probe: for each feature whether the two vectors differ, and whether any does."""
    names = view.feature_names
    b = leaky.select(F.col(ROW).alias("_r"), F.struct(*names).alias("_b"))
    flags = [differs(F.col(n), F.col("_b")[n]).alias(n) for n in names]
    out = strict.join(b, strict[ROW] == b["_r"]).select(ROW, *flags)
    any_ = F.lit(False)
    for n in names:
        any_ = any_ | F.col(n)
    return out.withColumn("any_differs", any_)


def disagreement_rates(differences: DataFrame, view: FeatureView) -> DataFrame:
    """One row: rows, and the share of rows in which each feature, and any, differs; null without rows."""
    n = F.count(F.lit(1))
    flags = [*view.feature_names, "any_differs"]
    return differences.agg(n.alias("rows"), *[(F.count_if(F.col(c)) / F.nullif(n, F.lit(0))).alias(c) for c in flags])


def temporal_split(rows: DataFrame, share: float = SPLIT) -> DataFrame:
    """Adds split_ms, the share's quantile, and is_train: as_of_ms before it. One number comes to the driver."""
    at = rows.agg(F.percentile_approx("as_of_ms", share, 1_000_000)).first()[0]
    return rows.withColumn("split_ms", F.lit(at).cast("long")).withColumn("is_train", F.col("as_of_ms") < F.lit(at).cast("long"))


def auc_table(strict: DataFrame, leaky: DataFrame, view: FeatureView) -> DataFrame:
    """strict, leaky: rows with features, label and is_train. Exact AUC of logistic regression for three
    pairs of (trained on, scored on); null where a model or a score lacks one of the labels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assemble = VectorAssembler(inputCols=list(view.feature_names), outputCol="vector")
    ready = {tag: assemble.transform(df.fillna(0.0, list(view.feature_names))).select("vector", "label", "is_train").cache() for tag, df in (("strict", strict), ("leaky", leaky))}
    out = []
    try:
        for trained, scored in (("leaky", "leaky"), ("leaky", "strict"), ("strict", "strict")):
            train = ready[trained].filter("is_train")
            if train.select("label").distinct().count() < 2:
                out.append((trained, scored, None))
                continue
            model = LogisticRegression(featuresCol="vector", labelCol="label", maxIter=50, regParam=0.01).fit(train)
            tested = model.transform(ready[scored].filter("NOT is_train")).select("label", vector_to_array("probability")[1].alias("_score"))
            out.append((trained, scored, auc(tested, "_score", "label").first()["auc"]))
    finally:
        for df in ready.values():
            df.unpersist()
    return strict.sparkSession.createDataFrame(out, "trained_on string, scored_on string, auc double")
