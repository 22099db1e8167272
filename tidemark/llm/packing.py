"""Packing documents into sequences of at most WINDOW tokens.

A document's ids are cut into full windows and one rest. The histogram of piece lengths is bounded by
the window, so it is planned on the driver: non-negative least squares over shallow combinations of
lengths that fill a window exactly gives how often each is used; rounded down and held to what the
histogram has, they take most pieces, and what is left is packed greedily, longest first. Pieces find
their places by ordinals among pieces of equal length; ids never move.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialize, trim
from .tokens import MEMO, encoder, public_path, slices

WINDOW = 2048
END_ID = 1
#: Combinations of three lengths that are tried, for each first length.
TRIPLES = 12
SWEEPS = 40


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", memo: int = MEMO) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, part, ord): pieces of each row's ids. `part` is the
    task that made a piece and `ord` its number among that task's pieces of equal length; both hold
    only for the table they are written to. `memo` bounds the pieces a worker remembers. Null text has the end id alone."""
    from pyspark import TaskContext

    rows = docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "ord"]
    schema = StructType([StructField(id_col, rows.schema["_id"].dataType), *(StructField(n, LongType()) for n in names[1:5]), StructField("part", IntegerType()), StructField("ord", LongType())])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc = encoder(public_path(tokenizer), "word", "ids", memo)
        part = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for b in batches:
            trim()
            texts = b.column(1).fill_null("")
            src, rest = [], [[], [], [], [], []]
            for lo, hi in slices(texts):
                ids, bounds = enc.word_ids(texts.slice(lo, hi - lo))
                raw, bounds = ids.astype("<u4", copy=False).tobytes(), bounds.tolist()
                for k, (a, z) in enumerate(zip(bounds, bounds[1:]), lo):
                    n = z - a + 1
                    for at in range(0, n, window):
                        length = min(window, n - at)
                        piece = raw[4 * (a + at) : 4 * min(a + at + length, z)]
                        crc = zlib.crc32(end, zlib.crc32(piece)) if at + length == n else zlib.crc32(piece)
                        src.append(k)
                        for c, v in zip(rest, (at, length, crc, n, seen[length])):
                            c.append(v)
                        seen[length] += 1
            cols = [pa.array(c, pa.int64()) for c in rest]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(src, pa.int64())), *cols[:4], pa.array([part] * len(src), pa.int32()), cols[4]], names=names)

    return rows.mapInArrow(cut, schema)


def nonnegative_least_squares(columns: list[list[tuple[int, int]]], goal: np.ndarray, sweeps: int = SWEEPS) -> list[float]:
    """min |A x - goal| over x >= 0 by cyclic coordinate descent. A column is a list of (row, times)."""
    rest, x = goal.astype(float).tolist(), [0.0] * len(columns)
    norm = [sum(m * m for _, m in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = sum(m * rest[i] for i, m in c) / norm[j]
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                for i, m in c:
                    rest[i] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, times)], repeats), each at most a window, that use up the histogram exactly."""
    have = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        have[length] = n
    out: list[tuple[list[tuple[int, int]], int]] = []

    def use(pattern, repeats):
        if repeats > 0:
            out.append((pattern, int(repeats)))
            for length, m in pattern:
                have[length] -= m * repeats

    use([(window, 1)], have[window])
    columns = {}
    present = np.flatnonzero(have)
    for a in present.tolist():
        b = window - a
        if 0 < b and have[b]:
            columns[tuple(sorted((a, b)))] = None
        others = present[(present >= a) & (window - a - present >= present)]
        others = others[have[window - a - others] > 0]
        # spread over the range, so that short and long lengths alike take part
        for b in others[np.unique(np.linspace(0, len(others) - 1, TRIPLES).astype(int))].tolist() if len(others) else []:
            columns[tuple(sorted((a, b, window - a - b)))] = None
    combos = [[(length, key.count(length)) for length in sorted(set(key))] for key in columns]
    times = nonnegative_least_squares(combos, have)
    for x, pattern in sorted(zip(times, combos), key=lambda t: (-t[0], t[1])):
        if x >= 0.5:
            use(pattern, min(round(x), *(have[length] // m for length, m in pattern)))
    # greedy: the longest that is left, then again and again the longest that still fits
    left = [k for k in range(1, window) if have[k]]
    while left:
        pattern, gap, k = [], window, len(left) - 1
        while k >= 0 and gap > 0:
            length = left[k]
            m = min(int(have[length]), gap // length)
            if m:
                pattern.append((length, m))
                gap -= m * length
            k -= 1
            while k >= 0 and left[k] > gap:
                k -= 1
        use(pattern, min(have[length] // m for length, m in pattern))
        left = [k for k in left if have[k]]
    return out


def _slots(patterns) -> dict[str, np.ndarray]:
    """For each length, which ordinals go to which sequences and offset; sorted by (length, first)."""
    given: dict[int, int] = {}
    rows, base = [], 0
    for pattern, repeats in patterns:
        offset = 0
        for length, m in pattern:
            for _ in range(m):
                first = given.get(length, 0)
                rows.append((length, first, base, offset))
                given[length] = first + repeats
                offset += length
        base += repeats
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"key": a[:, 0] * (1 << 44) + a[:, 1], "first": a[:, 1], "base": a[:, 2], "offset": a[:, 3]}


def pack_documents(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", **tokenizing) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece. Repeated
    rows are separate documents; an empty table gives no rows."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, window=window, id_col=id_col, **tokenizing), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # at most `window` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_slots(plan(histogram, window)))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("part", "length", ahead.alias("ahead"))
    placed = pieces.join(bases, ["part", "length"]).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("ahead") + F.col("ord")).alias("_n"))
    out = placed.withColumnRenamed("_n", "sequence_id").withColumn("offset", F.lit(0).cast("long")).schema

    def place(batches):
        s = shared.value
        for b in batches:
            length, n = np.asarray(b.column(2)), np.asarray(b.column(5))
            k = np.searchsorted(s["key"], length * (1 << 44) + n, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(s["base"][k] + n - s["first"][k], pa.int64()), pa.array(s["offset"][k], pa.int64())], names=out.names)

    return placed.mapInArrow(place, out)
