"""Whole leakage experiments: labels, both vectors, their disagreement, and model scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..definitions import FeatureView
from ..sources.events import normal
from ..sources.session import materialize
from .asof import ROW, Semantics, Strategy, training_features
from .leakage import SPLIT, auc_table, disagreement_rates, label_rows, sample_rows, temporal_split, vector_differences
from .statistics import nearest_rank

HORIZON_MS = 3_600_000
ROWS = 20_000


@dataclass(frozen=True)
class LeakageResult:
    """What one experiment found; `scores` is by (trained on, scored on)."""

    entity_rows: int
    train_rows: int
    test_rows: int
    label_rate: float
    features_compared: int
    rows_with_any_difference: int
    per_feature_difference_rate: dict[str, float]
    scores: dict[tuple[str, str], float | None]


@dataclass(frozen=True)
class SweepPoint:
    scale: int
    p50_lateness_ms: int | None
    p99_lateness_ms: int | None
    max_lateness_ms: int | None
    result: LeakageResult


def run_leakage_experiment(events: DataFrame, view: FeatureView, probes: DataFrame, positive: Column, horizon_ms: int = HORIZON_MS, rows: int = ROWS, seed: int = 0, share: float = SPLIT, strategy: Strategy = Strategy.FRAME) -> LeakageResult:
    """`rows` probes are sampled and labelled (a `positive` event within the horizon), joined to strictly
    known and to event-time vectors, compared, split by time at one point for both, and scored. Only
    counts, rates and scores come to the driver."""
    drawn = sample_rows(probes.select(ROW, *view.join_keys, "as_of_ms"), rows, seed)
    labelled = materialize(temporal_split(materialize(label_rows(events, view, drawn, horizon_ms, positive), "labels"), share), "split")
    asked = labelled.select(ROW, *view.join_keys, "as_of_ms")
    extra = labelled.select(ROW, "label", "is_train")
    sets = {s: materialize(training_features(events, view, asked, s, strategy), "vectors") for s in (Semantics.KNOWN, Semantics.EVENT_TIME)}
    rates = disagreement_rates(vector_differences(sets[Semantics.KNOWN], sets[Semantics.EVENT_TIME], view), view).first()
    n = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("train"), F.sum("label").alias("positive")).first()
    scores = auc_table(sets[Semantics.KNOWN].join(extra, ROW), sets[Semantics.EVENT_TIME].join(extra, ROW), view) if n["n"] else None
    return LeakageResult(
        entity_rows=n["n"],
        train_rows=n["train"],
        test_rows=n["n"] - n["train"],
        label_rate=n["positive"] / n["n"] if n["n"] else 0.0,
        features_compared=len(view.feature_names),
        rows_with_any_difference=round((rates["any_differs"] or 0.0) * rates["rows"]),
        per_feature_difference_rate={f: rates[f] or 0.0 for f in view.feature_names},
        scores={(r.trained_on, r.scored_on): r.auc for r in scores.collect()} if scores is not None else {},
    )


def run_lateness_sweep(generate: Callable[[int], DataFrame], scales: Iterable[int], view: FeatureView, probes: Callable[[DataFrame], DataFrame], positive: Column, **how) -> list[SweepPoint]:
    """One experiment for each scale of lateness, over events that `generate(scale)` makes anew, with the
    quantiles of the lateness seen in them."""
    points = []
    for scale in scales:
        events = materialize(generate(scale), "events")
        late = normal(events, view.source).select((F.col("_known_ms") - F.col("_event_ms")).alias("late"))
        seen = nearest_rank(late, "late").select("p50", "p99", "max")
        q = seen.first() or (None, None, None)
        points.append(SweepPoint(scale, *q, run_leakage_experiment(events, view, probes(events), positive, **how)))
    return points
