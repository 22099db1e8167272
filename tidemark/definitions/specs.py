"""What a view compiles to: one spec for each feature, one for each distinct tile series."""

from __future__ import annotations

from dataclasses import dataclass

from .model import FeatureView, Function, millis


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    basename: str
    function: Function
    column: str | None
    window_ms: int
    grid_ms: int


@dataclass(frozen=True)
class TileSpec:
    basename: str
    function: Function
    column: str | None
    grid_ms: int
    retention_ms: int


def feature_specs(view: FeatureView) -> tuple[FeatureSpec, ...]:
    return tuple(FeatureSpec(a.feature_name(w), a.basename, a.function, a.column, millis(w), millis(view.ladder.granularity(w))) for a in view.aggregations for w in a.windows)


def tile_specs(view: FeatureView) -> tuple[TileSpec, ...]:
    """All windows of an aggregation on a grid share its tiles, kept as long as the longest needs."""
    longest: dict[tuple, int] = {}
    for f in feature_specs(view):
        key = (f.basename, f.function, f.column, f.grid_ms)
        longest[key] = max(longest.get(key, 0), f.window_ms)
    return tuple(TileSpec(*key, retention) for key, retention in longest.items())
