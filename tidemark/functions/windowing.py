"""Window arithmetic on epoch milliseconds, as Columns.

For a window W on a grid g (W a multiple of g), as of T: whole tiles [(T - W) div g, T div g), and the
head [(T div g) * g, T). The trailing edge snaps outward to the grid; T itself is excluded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, TimestampNTZType, TimestampType


def to_millis(column: Column, field: StructField) -> Column:
    """Epoch milliseconds of a column: long already, or a timestamp (one without zone is UTC)."""
    if isinstance(field.dataType, LongType):
        return column
    if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
        return F.unix_millis(column.cast("timestamp"))
    raise TypeError(f"{field.name} is neither BIGINT milliseconds nor a timestamp")


def tile_index(ms: Column, grid_ms: int) -> Column:
    """Floor division, also before 1970, where integer division would truncate."""
    g = F.lit(grid_ms).cast("long")
    return F.call_function("div", ms - F.pmod(ms, g), g)


def align_down(ms: Column, grid_ms: int) -> Column:
    return ms - F.pmod(ms, F.lit(grid_ms).cast("long"))


def effective_start(as_of: Column, window_ms: int, grid_ms: int) -> Column:
    return align_down(as_of - F.lit(window_ms).cast("long"), grid_ms)


def tile_bounds(as_of: Column, window_ms: int, grid_ms: int) -> tuple[Column, Column]:
    """First tile of the window, and the tile that the head is in."""
    return tile_index(as_of - F.lit(window_ms).cast("long"), grid_ms), tile_index(as_of, grid_ms)


def retention_start(as_of: Column, retention_ms: int, grid_ms: int) -> Column:
    """Least tile that a read as of `as_of` or later may need."""
    return tile_index(as_of - F.lit(retention_ms).cast("long"), grid_ms)


def visible_from(event_ms: Column, known_ms: Column) -> Column:
    """Least T at which an event is before T and known at T; turns two conditions into one order."""
    return F.greatest(event_ms + F.lit(1).cast("long"), known_ms)
