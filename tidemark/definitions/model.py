"""Entities, aggregations, resolution ladders, sources, views and the registry."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta
from enum import Enum

MAX_TILES = 512
_NAME = re.compile(r"[a-z][a-z0-9_]*")
_UNITS = (("d", 86400), ("h", 3600), ("m", 60), ("s", 1))


class DefinitionError(ValueError):
    """A definition that cannot be right."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise DefinitionError(message)


def _named(what: str, name: str) -> None:
    _require(isinstance(name, str) and _NAME.fullmatch(name) is not None, f"{what} {name!r} must match [a-z][a-z0-9_]*")


def millis(t: timedelta) -> int:
    return t // timedelta(milliseconds=1)


def window_label(window: timedelta) -> str:
    """The window in its coarsest exact unit: 24 h is 1d, 90 min is 90m."""
    seconds = window // timedelta(seconds=1)
    _require(window > timedelta(0) and window == timedelta(seconds=seconds), f"window {window} must be a positive number of whole seconds")
    return next(f"{seconds // size}{unit}" for unit, size in _UNITS if seconds % size == 0)


class KeyType(Enum):
    STRING = "string"
    INT64 = "bigint"


class Function(Enum):
    SUM = "sum"
    COUNT = "count"
    MIN = "min"
    MAX = "max"
    AVG = "avg"

    @property
    def invertible(self) -> bool:
        """Whether a window's state is a difference of two running states."""
        return self not in (Function.MIN, Function.MAX)


@dataclass(frozen=True)
class Entity:
    name: str
    join_key: str
    key_type: KeyType = KeyType.STRING

    def __post_init__(self):
        _named("entity", self.name)
        _named("join key", self.join_key)


@dataclass(frozen=True)
class EventSource:
    """Where events are: a table, a topic, and the columns that say when an event happened and when it
    became known. Both columns are honoured everywhere."""

    name: str
    table: str
    topic: str
    event_time: str = "event_ts"
    known_time: str = "created_ts"

    def __post_init__(self):
        for what, x in (("source", self.name), ("table", self.table), ("event time column", self.event_time), ("known time column", self.known_time)):
            _named(what, x)
        _require(self.event_time != self.known_time, "event time and known time must be two columns")
        _require(bool(self.topic and self.topic.strip()), "a source needs a topic")


@dataclass(frozen=True)
class Aggregation:
    function: Function
    windows: tuple[timedelta, ...]
    column: str | None = None

    def __post_init__(self):
        _require(isinstance(self.function, Function), f"{self.function!r} is no mergeable function")
        _require(bool(self.windows), "an aggregation needs a window")
        _require(len(set(self.windows)) == len(self.windows), "an aggregation repeats a window")
        _require((self.column is None) == (self.function is Function.COUNT), "a column is for every function but count")
        if self.column is not None:
            _named("column", self.column)
        for w in self.windows:
            window_label(w)

    @property
    def basename(self) -> str:
        return "count" if self.column is None else f"{self.column}_{self.function.value}"

    def feature_name(self, window: timedelta) -> str:
        return f"{self.basename}_{window_label(window)}"


@dataclass(frozen=True)
class Tier:
    """Windows up to `upto` are tiled at `granularity`."""

    upto: timedelta
    granularity: timedelta


@dataclass(frozen=True)
class ResolutionLadder:
    tiers: tuple[Tier, ...]
    max_tiles: int = MAX_TILES

    def __post_init__(self):
        _require(bool(self.tiers), "a ladder needs a tier")
        for t in self.tiers:
            _require(t.upto > timedelta(0) and t.granularity > timedelta(0), "bounds and granularities must be positive")
        for a, b in zip(self.tiers, self.tiers[1:]):
            _require(a.upto < b.upto, "a ladder's bounds must ascend")

    def granularity(self, window: timedelta) -> timedelta:
        _require(window > timedelta(0), f"window {window} must be positive")
        tier = next((t for t in self.tiers if window <= t.upto), None)
        _require(tier is not None, f"window {window} is beyond the ladder")
        g = tier.granularity
        _require(window % g == timedelta(0), f"window {window} is no multiple of its granularity {g}")
        _require(window // g <= self.max_tiles, f"window {window} takes over {self.max_tiles} tiles of {g}")
        return g


DEFAULT_LADDER = ResolutionLadder((Tier(timedelta(hours=12), timedelta(minutes=5)), Tier(timedelta(days=21), timedelta(hours=1))))


@dataclass(frozen=True)
class FeatureView:
    name: str
    entities: tuple[Entity, ...]
    source: EventSource
    aggregations: tuple[Aggregation, ...]
    ttl: timedelta
    version: int = 1
    ladder: ResolutionLadder = DEFAULT_LADDER

    def __post_init__(self):
        _named("view", self.name)
        _require(self.version >= 1, "versions begin at 1")
        _require(bool(self.entities), "a view needs an entity")
        _require(len(set(self.join_keys)) == len(self.entities), "a view repeats a join key")
        _require(bool(self.aggregations), "a view needs an aggregation")
        names = self.feature_names
        _require(len(set(names)) == len(names), "a view repeats a feature name")
        longest = max(w for a in self.aggregations for w in a.windows)
        _require(self.ttl > timedelta(0), "ttl must be positive")
        _require(self.ttl >= longest, "ttl is shorter than the longest window")
        for a in self.aggregations:
            for w in a.windows:
                self.ladder.granularity(w)

    @property
    def join_keys(self) -> tuple[str, ...]:
        return tuple(e.join_key for e in self.entities)

    @property
    def feature_names(self) -> tuple[str, ...]:
        return tuple(a.feature_name(w) for a in self.aggregations for w in a.windows)

    @property
    def ttl_ms(self) -> int:
        return millis(self.ttl)

    @property
    def tile_table(self) -> str:
        return f"tiles_{self.name}_v{self.version}"


@dataclass(frozen=True)
class Registry:
    views: tuple[FeatureView, ...]

    def __post_init__(self):
        _require(bool(self.views), "a registry needs a view")
        names = [v.name for v in self.views]
        _require(len(set(names)) == len(names), "two views, or two versions of one view, share a name")
        known: dict[str, Entity] = {}
        for e in (e for v in self.views for e in v.entities):
            _require(known.setdefault(e.name, e) == e, f"entity {e.name} is defined in two ways")

    def view(self, name: str, version: int | None = None) -> FeatureView:
        for v in self.views:
            if v.name == name and version in (None, v.version):
                return v
        raise DefinitionError(f"no view {name!r}" + (f" of version {version}" if version else ""))

    def view_for_feature(self, qualified: str) -> FeatureView:
        """The view of `view:feature`."""
        name, colon, feature = qualified.partition(":")
        _require(bool(name and colon and feature), f"{qualified!r} is not view:feature")
        view = self.view(name)
        _require(feature in view.feature_names, f"view {name} has no feature {feature!r}")
        return view
