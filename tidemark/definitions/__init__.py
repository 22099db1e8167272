"""Declarative feature views. Plain Python: nothing here imports Spark.

A view is (entity keys) x (function, column, trailing windows) over one event source with two
timestamps. Definitions validate themselves when made and compile to plain specs.
"""

from .model import (
    DEFAULT_LADDER,
    Aggregation,
    DefinitionError,
    Entity,
    EventSource,
    FeatureView,
    Function,
    KeyType,
    Registry,
    ResolutionLadder,
    Tier,
    window_label,
)
from .specs import FeatureSpec, TileSpec, feature_specs, tile_specs

__all__ = [
    "DEFAULT_LADDER",
    "Aggregation",
    "DefinitionError",
    "Entity",
    "EventSource",
    "FeatureSpec",
    "FeatureView",
    "Function",
    "KeyType",
    "Registry",
    "ResolutionLadder",
    "Tier",
    "TileSpec",
    "feature_specs",
    "tile_specs",
    "window_label",
]
