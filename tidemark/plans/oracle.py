"""DuckDB SQL that recomputes the queries by brute force, independently of the engine's plans."""

from __future__ import annotations

ENGAGEMENT = """ev AS (SELECT *, epoch_us(ts)//1000 AS ems FROM events),
engagement AS (SELECT event_id,
  CASE event_type WHEN 'view' THEN 'watch' WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'share' WHEN 'error' THEN 'impression' WHEN 'signup' THEN 'follow' END AS kind,
  user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item_id, ems AS event_ms,
  ems + CASE WHEN event_id % 20 = 0 THEN (60000 + (event_id * 7919) % 21540000) * {late} ELSE (event_id * 31) % 251 END AS created_ms,
  CASE WHEN event_type = 'view' THEN value END AS watch_seconds,
  CAST(event_type = 'click' AS INTEGER) AS liked, CAST(event_type = 'purchase' AS INTEGER) AS shared, event_type FROM ev)"""

PROBES = """probes AS (SELECT event_id AS entity_row_id, user_id, item_id, event_type,
  CASE event_id % 20 WHEN 0 THEN event_ms + 1800000 WHEN 5 THEN (event_ms // 3600000) * 3600000 WHEN 15 THEN event_ms ELSE event_ms + 420000 END AS as_of_ms
  FROM engagement WHERE event_id % 5 = 0)"""

ORDERS = """oe AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate)//1000 AS event_ms,
  epoch_us(o_orderdate)//1000 + CASE WHEN o_orderkey % 20 = 0 THEN 1 + o_orderkey % 60 ELSE 0 END * 86400000 AS created_ms, o_totalprice FROM orders),
op AS (SELECT o_orderkey AS entity_row_id, o_custkey, event_ms + 43200000 AS as_of_ms FROM oe WHERE o_orderkey % 3 = 0)"""

H, D = 3600000, 86400000
M5 = 300000
#: (feature, function, column, window, grid)
USER = (
    ("watch_seconds_sum_1h", "sum", "watch_seconds", H, M5),
    ("watch_seconds_sum_1d", "sum", "watch_seconds", D, H),
    ("watch_seconds_sum_7d", "sum", "watch_seconds", 7 * D, H),
    ("count_1h", "count", None, H, M5),
    ("count_1d", "count", None, D, H),
    ("liked_sum_1d", "sum", "liked", D, H),
    ("liked_sum_7d", "sum", "liked", 7 * D, H),
    ("watch_seconds_avg_1d", "avg", "watch_seconds", D, H),
)
ITEM = (
    ("watch_seconds_sum_1h", "sum", "watch_seconds", H, M5),
    ("watch_seconds_sum_1d", "sum", "watch_seconds", D, H),
    ("shared_sum_1h", "sum", "shared", H, M5),
    ("shared_sum_1d", "sum", "shared", D, H),
    ("watch_seconds_max_1d", "max", "watch_seconds", D, H),
)
DAY_USER = tuple(f for f in USER if f[3] <= D)
ORDER = (
    ("o_totalprice_min_364d", "min", "o_totalprice", 364 * D, D),
    ("o_totalprice_max_364d", "max", "o_totalprice", 364 * D, D),
    ("o_totalprice_sum_728d", "sum", "o_totalprice", 728 * D, 7 * D),
    ("count_364d", "count", None, 364 * D, D),
)


def value(fn: str, col: str | None, w: int, g: int, head: bool = True) -> str:
    inside = f"e.event_ms >= ((p.as_of_ms - {w}) // {g}) * {g}" + ("" if head else f" AND e.event_ms < (p.as_of_ms // {g}) * {g}")
    if fn == "count":
        return f"CAST(count(CASE WHEN {inside} THEN 1 END) AS DOUBLE)"
    x = f"CASE WHEN {inside} THEN CAST(e.{col} AS DOUBLE) END"
    return {"sum": f"round(coalesce(sum({x}), 0.0), 4) + 0.0", "avg": f"round(avg({x}), 6) + 0.0", "min": f"min({x})", "max": f"max({x})"}[fn]


def features(specs, keys, events="engagement", probes="probes", known=False, without_head=()) -> str:
    """One row for each probe: row id, keys, as_of_ms, features, by a range join over raw events."""
    on = " AND ".join(f"e.{k} = p.{k}" for k in keys)
    reach = max(w + g for _, _, _, w, g in specs)
    cols = ", ".join(f"{value(fn, col, w, g, name not in without_head)} AS {name}" for name, fn, col, w, g in specs)
    ks = ", ".join(f"p.{k}" for k in keys)
    seen = "AND e.created_ms <= p.as_of_ms" if known else ""
    return f"SELECT p.entity_row_id, {ks}, p.as_of_ms, {cols} FROM {probes} p LEFT JOIN {events} e ON {on} AND e.event_ms < p.as_of_ms AND e.event_ms >= p.as_of_ms - {reach} {seen} GROUP BY p.entity_row_id, {ks}, p.as_of_ms"


def freshness(keys, ttl, events="engagement", probes="probes", known=False) -> str:
    on = " AND ".join(f"e.{k} = p.{k}" for k in keys)
    seen = "AND e.created_ms <= p.as_of_ms" if known else ""
    return f"SELECT p.entity_row_id, max(e.event_ms) AS last_known_ms, coalesce(p.as_of_ms - max(e.event_ms) <= {ttl}, false) AS is_fresh FROM {probes} p LEFT JOIN {events} e ON {on} AND e.event_ms < p.as_of_ms {seen} GROUP BY p.entity_row_id, p.as_of_ms"


def gated(vectors: str, fresh: str, specs, keys) -> str:
    ks = ", ".join(f"v.{k}" for k in keys)
    cols = ", ".join(f"CASE WHEN f.is_fresh THEN v.{name} END AS {name}" for name, *_ in specs)
    return f"SELECT v.entity_row_id, {ks}, v.as_of_ms, f.last_known_ms, f.is_fresh, {cols} FROM {vectors} v JOIN {fresh} f USING (entity_row_id)"


def with_(*ctes: str, body: str, late: int = 1) -> str:
    return "WITH " + ",\n".join([ENGAGEMENT.format(late=late), PROBES, *ctes]) + "\n" + body


def tiles(specs, key: str) -> str:
    """The long tile table."""
    parts, seen = [], set()
    for _, fn, col, _, g in specs:
        base = "count" if col is None else f"{col}_{fn}"
        if (base, g) in seen:
            continue
        seen.add((base, g))
        s0 = {"count": "CAST(count(*) AS DOUBLE)", "sum": f"round(sum(CAST({col} AS DOUBLE)), 4) + 0.0", "avg": f"round(sum(CAST({col} AS DOUBLE)), 4) + 0.0", "min": f"min({col})", "max": f"max({col})"}[fn]
        s1 = f"CAST(count({col}) AS DOUBLE)" if fn == "avg" else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT {key}, '{base}' AS agg_name, CAST({g} AS BIGINT) AS granularity_ms, event_ms // {g} AS tile_index, (event_ms // {g}) * {g} AS tile_start_ms, {s0} AS s0, {s1} AS s1 FROM engagement GROUP BY {key}, event_ms // {g}" + (f" HAVING count({col}) > 0" if col else ""))
    return "\nUNION ALL\n".join(parts)
